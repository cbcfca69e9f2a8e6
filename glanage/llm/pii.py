"""PII: format-preserving Feistel pseudonyms.

Values are recognised, validated, read as a number of a finite domain,
permuted there by a keyed Feistel network, and written back in their own
format. The permutation depends on the key and the kind only, so equal values
get equal pseudonyms in every document and stay linked, different ones stay
different, and the holder of the key can undo it.

kind    validated by                        domain that is permuted
email   shape                               letters and digits of the local part
iban    mod-97 check                        the account part; check digits are computed anew
phone   shape; ten national digits, or 9 to the digits of the national number
        15 with a country code, or 0 and
        four pairs and one digit
ssn     shape, ranges in use                the nine digits, within those ranges
card    13 to 19 digits, Luhn               all digits but the last, which is computed anew
ipv4    four numbers to 255                 the 32 bits
date    calendar                            days of a month after the 12th, or up to it, from 1900 to 2099
key     cloud key, or hex after a key word  letters and digits

A domain of N values is permuted on the least even number of bits that holds N;
results of N or more are permuted again until one is below it (cycle walking),
which keeps it a permutation of the domain. Separators and letter case stay.
Where a value has notations (dates; phone numbers with and without country or
trunk code; hex digits in upper or lower case), all of them go through one
permutation, so they stay linked. That is why dates after the 12th are a domain
of their own: only they can be written month first and still be read back.
A local part of one or two letters has only 26 or 676 values: its pseudonym
links, but hides little from who holds a list of all of them.

Cases: a null text stays null and an empty one empty; texts are scanned whole;
the leftmost of overlapping finds wins, and of two that begin together the
first in the table above; ties can't arise. Rows repeated in the input give
equal outputs. What looks like a value but fails its check is left alone. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import calendar
import datetime
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glanage.llm.common import mapped

#: Used where no key is given; production names its own.
DEMO_KEY = b"glanage demonstration key"
ROUNDS = 8
KINDS = ("email", "iban", "phone", "ssn", "card", "ipv4", "date", "key")

#: Patterns begin with what they need, not with a look-behind: edges are checked on the few finds.
PATTERNS = {
    "email": re.compile(r"@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "card": re.compile(r"[0-9]{13,19}(?![0-9])|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}(?![0-9])"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
    "phone": re.compile(
        r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
        r"|\+[1-9][0-9]{0,2}(?:[ .-]?(?:\(0?[0-9]{1,4}\)|[0-9]{1,4})){2,7}(?![0-9])|0[1-9](?:([ .-])[0-9]{2})(?:\1[0-9]{2}){3}(?![0-9]|[ .-][0-9])"
    ),
    "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "ipv4": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    "date": re.compile(r"[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}(?![0-9])|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4}(?![0-9])"),
    "key": re.compile(r"A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])|(?i:password|passwd|secret|token|api[_-]?key)\s*[=:]\s*\"?([0-9A-Fa-f]{16,64})(?![0-9A-Za-z])"),
}
_BEFORE = {"card": "-.", "ipv4": ".", "ssn": "-", "phone": "+(", "date": "-/."}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Country codes of one and of two digits, as fixed values; the others have three.
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def permute(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of range(size), or its inverse."""
    if size < 2:
        return value
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            seen = left if back else right
            f = int.from_bytes(hashlib.blake2b(bytes([r]) + seen.to_bytes(width, "big") + tweak, key=key[:64], digest_size=width).digest(), "big") & mask
            left, right = (right ^ f, left) if back else (right, left ^ f)
        value = left << half | right
        if value < size:
            return value


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def permute_text(text: str, key: bytes, tweak: bytes, back: bool = False, classes: tuple[str, ...] = _CLASSES, accepts: Callable[[str], bool] = lambda x: True) -> str:
    """Permutes the strings that have a character of the same class at each place, and of these those that ``accepts`` holds for."""
    sets = [next((c for c in classes if x in c), "") for x in text]
    number, size = 0, 1
    for x, c in zip(text, sets, strict=True):
        if c:
            number, size = number * len(c) + c.index(x), size * len(c)
    while True:
        rest = number = permute(number, size, key, tweak + b"/%d" % size, back)
        out = []
        for x, c in zip(reversed(text), reversed(sets), strict=True):
            if c:
                rest, at = divmod(rest, len(c))
                x = c[at]
            out.append(x)
        if accepts(found := "".join(reversed(out))):
            return found


def luhn_digit(body: str) -> str:
    """The digit that completes ``body`` to a number that passes the Luhn check."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(body)))
    return str(-total % 10)


def _digits_into(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _email(local: str, key: bytes, back: bool) -> str:
    return permute_text(local, key, b"email", back)


def _emails(text: str, key: bytes, back: bool) -> Iterator[tuple[int, int, str]]:
    """Start, stop and pseudonym of each address: domains are found first, local parts by going back from there."""
    end = 0
    for m in PATTERNS["email"].finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        while start < m.start() and not text[start].isalnum():
            start += 1
        if start < m.start() and not (start and text[start - 1].isalnum()):
            yield start, m.end(), _email(text[start : m.start()], key, back) + m[0]
        end = m.end()


def _shorter(found: str, least: int) -> Iterator[str]:
    """The find, then the find without its last groups: another number may stand right behind."""
    while sum(c.isalnum() for c in found) >= least:
        yield found
        if not (m := re.search(r"[ -][A-Z0-9]+$", found)):
            return
        found = found[: m.start()]


def _card(m: re.Match, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"[ -]", "", m[0])
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = permute_text(digits[:-1], key, b"card", back)
    return _digits_into(m[0], body + luhn_digit(body))


def _mod97(country: str, account: str, check: str) -> int:
    return int("".join(str(int(c, 36)) for c in account + country + check)) % 97


def _iban(m: re.Match, key: bytes, back: bool) -> tuple[str, int] | None:
    for found in _shorter(m[0], 15):
        flat = found.replace(" ", "")
        country, check, account = flat[:2], flat[2:4], flat[4:]
        if _mod97(country, account, check) == 1:
            account = permute_text(account, key, b"iban" + country.encode(), back)
            new = iter(country + f"{98 - _mod97(country, account, '00'):02d}" + account)
            return "".join(c if c == " " else next(new) for c in found), len(found)
    return None


def _national(digits: str, key: bytes, back: bool) -> str:
    """A national number; the first digit of one that isn't of ten digits is never 0."""
    if len(digits) == 10 or digits[0] == "0":
        return permute_text(digits, key, b"phone", back)
    least = 10 ** (len(digits) - 1)
    return str(least + permute(int(digits) - least, 9 * least, key, b"phone/%d" % len(digits), back))


def _phone(m: re.Match, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"[^0-9]", "", m[0])
    if m[1]:
        front = "0"
    elif m[0][0] == "+":
        if not 9 <= len(digits) <= 15:
            return None
        front = next((digits[:n] for n in (1, 2) if digits[:n] in CODES), digits[:3])
        if "(0" in m[0] and digits[len(front)] == "0":  # a trunk code in brackets
            front += "0"
    else:
        front = digits[:-10]
    if len(digits) - len(front) < 5:
        return None
    return _digits_into(m[0], front + _national(digits[len(front) :], key, back))


def _ssn(m: re.Match, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, m[0].split("-"))
    if not (1 <= area <= 899 and area != 666 and group and serial):
        return None
    area -= 2 if area > 666 else 1
    n = permute((area * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, b"ssn", back)
    n, serial = divmod(n, 9999)
    area, group = divmod(n, 99)
    return f"{area + (2 if area >= 665 else 1):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ipv4(m: re.Match, key: bytes, back: bool) -> str | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, b"ipv4", back)
    return ".".join(map(str, n.to_bytes(4, "big")))


#: Days over 12 in all months before the given one, from January 1900.
_LATE = list(itertools.accumulate((calendar.monthrange(1900 + i // 12, i % 12 + 1)[1] - 12 for i in range(2400)), initial=0))


def _other_day(y: int, mo: int, d: int, key: bytes, back: bool) -> tuple[int, int, int]:
    """The date that stands for this one: days up to the 12th and later ones are permuted among themselves."""
    month = (y - 1900) * 12 + mo - 1
    if d <= 12:
        month, d = divmod(permute(month * 12 + d - 1, 2400 * 12, key, b"date-early", back), 12)
        return month // 12 + 1900, month % 12 + 1, d + 1
    n = permute(_LATE[month] + d - 13, _LATE[-1], key, b"date-late", back)
    month = bisect.bisect_right(_LATE, n) - 1
    return month // 12 + 1900, month % 12 + 1, n - _LATE[month] + 13


def _date(m: re.Match, key: bytes, back: bool) -> str | None:
    """Year first, or day first where that is a date, else month first."""
    mark = m[1] or m[2]
    a, b, c = m[0].split(mark)
    notations = [(a, b, c, "ymd")] if m[1] else [(c, b, a, "dmy"), (c, a, b, "mdy")]
    for y, mo, d, order in notations:
        try:
            datetime.date(int(y), int(mo), int(d))
        except ValueError:
            continue
        if not 1900 <= int(y) <= 2099:
            return None
        year, month, day = _other_day(int(y), int(mo), int(d), key, back)
        # A part of one digit may need two; then it takes them.
        parts = {"y": str(year), "m": f"{month:0{len(mo)}d}", "d": f"{day:0{len(d)}d}"}
        return mark.join(parts[x] for x in order)
    return None


_HEX = "0123456789abcdef"


def _hex(text: str, key: bytes, back: bool) -> str:
    """Hex digits in the case they are in; of digits alone only digits come, and of others never digits alone."""
    low, high = text != text.upper(), text != text.lower()
    if low and high:
        return permute_text(text, key, b"hex", back, ("0123456789", "abcdef", "ABCDEF"))
    if not low and not high:
        return permute_text(text, key, b"hex", back, ("0123456789",))
    new = permute_text(text.lower(), key, b"hex", back, (_HEX,), lambda x: not x.isdigit())
    return new.upper() if high else new


def _key(m: re.Match, key: bytes, back: bool) -> str | None:
    if not m[1]:
        return m[0][:4] + permute_text(m[0][4:], key, b"key", back, ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",))
    at = m.start(1) - m.start()
    return m[0][:at] + _hex(m[1], key, back) + m[0][at + len(m[1]) :]


#: Each gives the pseudonym, and where it takes less than the whole find, how much; None if the value fails its check.
_MAKERS: dict[str, Callable[[re.Match, bytes, bool], str | tuple[str, int] | None]] = {"card": _card, "iban": _iban, "phone": _phone, "ssn": _ssn, "ipv4": _ipv4, "date": _date, "key": _key}
#: What a text must contain for a pattern to be tried.
_NEEDS = {"email": "@", "ipv4": ".", "ssn": "-"}
_DIGIT = re.compile(r"[0-9@]|A[KS]IA")


def pseudonymise(text: str | None, key: bytes = DEMO_KEY, back: bool = False) -> tuple[str | None, list[str]]:
    """The text with every value replaced, and the kinds of the values in order."""
    if not text or not _DIGIT.search(text):
        return text, []
    found = []
    for rank, kind in enumerate(KINDS):
        if _NEEDS.get(kind, "") not in text:
            continue
        if kind == "email":
            found += [(start, rank, stop, new) for start, stop, new in _emails(text, key, back)]
            continue
        pattern, at = PATTERNS[kind], 0
        while m := pattern.search(text, at):
            before = text[m.start() - 1] if m.start() else " "
            new = None if before.isalnum() or before in _BEFORE.get(kind, "") else _MAKERS[kind](m, key, back)
            if new is None:  # go on behind the run of characters that this find began in
                at = m.start() + 1
                while at < len(text) and text[at - 1].isalnum() and text[at].isalnum() and text[at].isascii():
                    at += 1
            else:
                new, size = new if isinstance(new, tuple) else (new, len(m[0]))
                at = m.start() + size
                found.append((m.start(), rank, at, new))
    found.sort()
    out, kinds, end = [], [], 0
    for start, rank, stop, new in found:
        if start >= end:
            out += [text[end:start], new]
            kinds.append(KINDS[rank])
            end = stop
    return "".join([*out, text[end:]]), kinds


def pseudonyms(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """All columns of documents with the text replaced, and kinds, an array with one entry per value."""
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields) + ", kinds array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            new = [pseudonymise(t, key) for t in b["text"]]
            yield b.assign(text=pd.Series([t for t, _ in new], index=b.index, dtype=object), kinds=pd.Series([k for _, k in new], index=b.index, dtype=object))

    found = mapped(docs, run, schema)
    return found.withColumn("n_chars", F.when(F.size("kinds") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonyms(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "text", "n_chars", F.size("kinds").cast("long").alias("n_values"), F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("kinds"))


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal values in the texts; keeps every document."""
    return pseudonyms(docs).select("doc_id", "text", "lang", "source", "n_chars")
