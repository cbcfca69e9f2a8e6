"""Text normalisation and tokenisation as Column functions; nothing here leaves the JVM."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Articles and contractions left out of indexes, as fixed values and in order.
ARTICLES = ("le", "la", "les", "un", "une", "des", "du", "de la", "de l’", "de", "d'", "l’", "l'", "au", "aux", "à la", "à l’")
_ALONE = tuple(a for a in ARTICLES if " " not in a)
#: Signs that become blanks before a title or text is indexed, as fixed values.
INDEX_SIGNS = '.,?:\n"!'


def clean(text: Column, signs: str = string.punctuation) -> Column:
    """Lower case, with the given signs deleted (not blanked): ``l'eau`` becomes ``leau``."""
    return F.lower(F.translate(text, signs, ""))


def clean_markup(text: Column) -> Column:
    """Like clean, but the signs of tags stay."""
    return clean(text, "".join(c for c in string.punctuation if c not in '/<>"'))


def clean_light(text: Column) -> Column:
    """Lower case without full stops, commas, semicolons and colons."""
    return clean(text, ".,;:")


def words(text: Column) -> Column:
    """Tokens between white space of any kind; no empty ones, none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def blank_words(text: Column) -> Column:
    """Tokens between single blanks, empty ones included."""
    return F.split(text, " ")


def elided_words(text: Column) -> Column:
    """Lower-case tokens in which an elided article (``l'``) is a token of its own and hyphenated words stay whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[-.][\p{L}\p{N}]+)*['’]?"), F.lit(0))


def title_and_text(title: Column, text: Column) -> Column:
    return F.concat_ws(" ", title, text)


def index_words(text: Column, articles: Sequence[str] = ARTICLES) -> Column:
    """Words for an index: signs blanked, lower case, without articles.

    Articles go as whole words, elided ones (``l'eau``) from the front of their
    word, and ``à`` only as part of ``à la`` and ``à l'``.
    """
    blanked = F.translate(text, INDEX_SIGNS, " " * len(INDEX_SIGNS))
    w = words(F.lower(blanked))
    alone = [a for a in articles if " " not in a]

    def kept(t: Column, i: Column) -> Column:
        then = F.coalesce(F.get(w, i + 1), F.lit(""))
        return ~t.isin(alone) & ~((t == "à") & ((then == "la") | then.rlike("^l['’]")))

    bare = F.transform(F.filter(w, kept), lambda t: F.regexp_replace(t, "^(?:d'|l['’])", ""))
    return F.filter(bare, lambda t: t != "")


def index_words_compat(text: Column, articles: Sequence[str] = ARTICLES) -> Column:
    """The older rule: an article is cut wherever it begins a word, so ``universitaire`` loses its ``un``."""
    out = F.translate(text, INDEX_SIGNS, " " * len(INDEX_SIGNS))
    for a in articles:
        out = F.replace(out, F.lit(f" {a}"), F.lit(" "))
    return words(F.lower(out))


def query_text(text: Column) -> Column:
    """A question in lower case, with straight apostrophes and without question marks and full stops."""
    return F.lower(F.translate(text, "’?.", "'"))


def without_words(text: Column, stop: Sequence[str] = _ALONE) -> Column:
    """The text without the given words, by whole words."""
    return F.array_join(F.filter(words(text), lambda t: ~t.isin(*stop)), " ")


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def has_number(text: Column) -> Column:
    """Some token is all digits or holds a slash."""
    return F.exists(words(text), lambda t: t.rlike(r"^\d+$") | F.contains(t, F.lit("/")))


def bare_word(word: Column) -> Column:
    """Lower case without outer ASCII punctuation and white space."""
    return F.regexp_replace(F.lower(word), r"^[\p{Punct}\s]+|[\p{Punct}\s]+$", "")


def without_controls(text: Column) -> Column:
    """Without the control characters that XML forbids."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def common_prefix(a: Column, b: Column) -> Column:
    """Number of equal leading characters."""
    least = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))
    return F.when(least < 1, 0).otherwise(F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, least))


def prefix_score(a: Column, b: Column, least: int = 3, apart: int = 4) -> Column:
    """100 x common prefix / longer length; 0 if a word is shorter than ``least`` or lengths differ by more than ``apart``."""
    la, lb = F.length(a), F.length(b)
    fits = (la >= least) & (lb >= least) & (F.abs(la - lb) <= apart)
    return F.when(fits, 100.0 * common_prefix(a, b) / F.greatest(la, lb)).otherwise(0.0)


def earliest(text: Column, keywords: Sequence[str]) -> Column:
    """The keyword that occurs first as a struct (pos from 1, kw); of several at one place the first given; null if none occurs."""
    found = F.array(*(F.struct(F.instr(text, k).alias("pos"), F.lit(i).alias("rank"), F.lit(k).alias("kw")) for i, k in enumerate(keywords)))
    least = F.array_min(F.filter(found, lambda x: x["pos"] > 0))
    return F.when(least.isNotNull(), F.struct(least["pos"].alias("pos"), least["kw"].alias("kw")))
