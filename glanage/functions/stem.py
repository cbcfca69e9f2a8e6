"""French stemming after the published Snowball description, and a small rule lemmatiser.

Both work on single words. The stemmer runs in Python: apply it to distinct
forms only (see ``operators.lexicon``). The lemmatiser is a column function.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOWELS = "aeiouyâàëéêèïîôûù"

#: Suffix groups of the published algorithm, as fixed values.
REMOVE_R2 = ("ances", "iqUes", "ismes", "ables", "istes", "ance", "iqUe", "isme", "able", "iste", "eux")
ATION = ("atrices", "ateurs", "ations", "atrice", "ateur", "ation")
LOGIE = ("logies", "logie")
USION = ("usions", "utions", "usion", "ution")
ENCE = ("ences", "ence")
EMENT = ("ements", "ement")
ITE = ("ités", "ité")
IF = ("ives", "ive", "ifs", "if")
EUSE = ("euses", "euse")
ISSEMENT = ("issements", "issement")
MENT = ("ments", "ment")
VERB_I = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
VERB_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
VERB_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def _regions(w: str) -> tuple[int, int, int]:
    """Starts of RV, R1 and R2."""
    v = f"[{VOWELS}]"
    if re.match(f"{v}{v}", w) or w.startswith(("par", "col", "tap")):
        rv = 3
    else:
        m = re.search(v, w[1:])
        rv = m.end() + 1 if m else len(w)
    one = re.compile(f"{v}[^{VOWELS}]")
    m = one.search(w)
    r1 = m.end() if m else len(w)
    m = one.search(w, r1)
    return min(rv, len(w)), r1, m.end() if m else len(w)


def _marked(w: str) -> str:
    """Vowels that act as consonants in upper case."""
    v = f"[{VOWELS}]"
    w = re.sub("qu", "qU", w)
    w = re.sub(f"(?<={v})([ui])(?={v})", lambda m: m[1].upper(), w)
    return re.sub(f"(?<={v})y|y(?={v})", "Y", w)


def _longest(w: str, suffixes: tuple[str, ...] | list[str]) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


def _standard(w: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """Step 1: the word without its standard suffix, and whether verb suffixes must still be tried."""
    every = (*REMOVE_R2, *ATION, *LOGIE, *USION, *ENCE, *EMENT, *ITE, *IF, *EUSE, *ISSEMENT, *MENT, "eaux", "aux", "amment", "emment")
    s = _longest(w, every)
    if s is None:
        return w, True
    base, at = w[: -len(s)], len(w) - len(s)

    def ic(x: str, otherwise: str = "iqU") -> str:
        if x.endswith("ic"):
            return x[:-2] if len(x) - 2 >= r2 else x[:-2] + otherwise
        return x

    if s in REMOVE_R2:
        return (base, False) if at >= r2 else (w, True)
    if s in ATION:
        return (ic(base), False) if at >= r2 else (w, True)
    if s in LOGIE:
        return (base + "log", False) if at >= r2 else (w, True)
    if s in USION:
        return (base + "u", False) if at >= r2 else (w, True)
    if s in ENCE:
        return (base + "ent", False) if at >= r2 else (w, True)
    if s in ISSEMENT:
        return (base, False) if at >= r1 and base and base[-1] not in VOWELS else (w, True)
    if s in EMENT:
        if at < rv:
            return w, True
        if base.endswith("iv") and len(base) - 2 >= r2:
            base = base[:-2]
            if base.endswith("at") and len(base) - 2 >= r2:
                base = base[:-2]
        elif base.endswith("eus"):
            if len(base) - 3 >= r2:
                base = base[:-3]
            elif len(base) - 3 >= r1:
                base = base[:-1] + "x"
        elif base.endswith(("abl", "iqU")) and len(base) - 3 >= r2:
            base = base[:-3]
        elif base.endswith(("ièr", "Ièr")) and len(base) - 3 >= rv:
            base = base[:-3] + "i"
        return base, False
    if s in ITE:
        if at < r2:
            return w, True
        if base.endswith("abil"):
            return (base[:-4], False) if len(base) - 4 >= r2 else (base[:-2] + "l", False)
        if base.endswith("ic"):
            return ic(base), False
        if base.endswith("iv") and len(base) - 2 >= r2:
            return base[:-2], False
        return base, False
    if s in IF:
        if at < r2:
            return w, True
        if base.endswith("at") and len(base) - 2 >= r2:
            base = ic(base[:-2])
        return base, False
    if s == "eaux":
        return w[:-1], False
    if s == "aux":
        return (w[:-2] + "l", False) if at >= r1 else (w, True)
    if s in EUSE:
        if at >= r2:
            return base, False
        return (base + "eux", False) if at >= r1 else (w, True)
    if s == "amment":
        return (base + "ant", True) if at >= rv else (w, True)
    if s == "emment":
        return (base + "ent", True) if at >= rv else (w, True)
    # ment, ments: behind a vowel of RV
    return (base, True) if base and base[-1] in VOWELS and len(base) - 1 >= rv else (w, True)


def stem(word: str | None) -> str | None:
    """The Snowball stem of one French word."""
    if not word:
        return word
    w = _marked(word.lower())
    rv, r1, r2 = _regions(w)
    first, verbs = _standard(w, rv, r1, r2)
    changed = first != w
    if verbs:
        before = first
        s = _longest(first[rv:], VERB_I)
        if s and len(first) - len(s) - 1 >= rv and first[-len(s) - 1] not in VOWELS:
            first = first[: -len(s)]
        else:
            s = _longest(first[rv:], [*VERB_E, *VERB_A, "ions"])
            if s == "ions":
                first = first[:-4] if len(first) - 4 >= r2 else first
            elif s in VERB_E:
                first = first[: -len(s)]
            elif s:
                first = first[: -len(s)]
                if first.endswith("e") and len(first) - 1 >= rv:
                    first = first[:-1]
        changed = changed or first != before
        verb_changed = first != before
    else:
        verb_changed = False
    if changed and (not verbs or verb_changed or first != w):
        if first.endswith("Y"):
            first = first[:-1] + "i"
        elif first.endswith("ç"):
            first = first[:-1] + "c"
    else:
        if first.endswith("s") and len(first) > 1 and first[-2] not in "aiouès":
            first = first[:-1]
        if first.endswith("ion") and len(first) - 3 >= r2 and len(first) - 4 >= rv and first[-4] in "st":
            first = first[:-3]
        elif (s := _longest(first[rv:], ["ière", "Ière", "ier", "Ier"])) is not None:
            first = first[: -len(s)] + "i"
        elif first.endswith("e") and len(first) - 1 >= rv:
            first = first[:-1]
        elif first.endswith("ë") and first[:-1].endswith("gu") and len(first) - 1 >= rv:
            first = first[:-1]
    if first.endswith(("enn", "onn", "ett", "ell", "eill")):
        first = first[:-1]
    m = re.search(f"([éè])([^{VOWELS}]+)$", first)
    if m:
        first = first[: m.start()] + "e" + m[2]
    return first.lower()


#: Irregular forms of the rule lemmatiser, as fixed values.
IRREGULAR = {"est": "être", "sont": "être", "était": "être", "a": "avoir", "ont": "avoir", "avait": "avoir", "yeux": "œil", "fait": "faire", "font": "faire", "va": "aller", "vont": "aller", "peut": "pouvoir", "peuvent": "pouvoir"}


#: Endings of the rule lemmatiser and what takes their place, as fixed values; the first that fits counts.
ENDINGS = (("eaux", "eau"), ("aux", "al"), ("ées", "er"), ("és", "er"), ("ée", "er"), ("issent", "ir"), ("issant", "ir"), ("aient", "er"), ("erait", "er"), ("eront", "er"))
#: What a plural s or x may not follow, as fixed values.
KEPT_S, KEPT_X = ("ss", "us", "is", "as"), ("oux", "eux")


def lemma_of(word: Column) -> Column:
    """A dictionary form by suffix rules: plurals and common verb endings; the word itself where no rule fits."""
    w = F.lower(word)
    shorter = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    ends = lambda *these: reduce(lambda a, b: a | b, (F.endswith(w, F.lit(x)) for x in these))
    irregular = F.create_map(*(F.lit(x) for kv in IRREGULAR.items() for x in kv))
    out = F.when(w.isin(list(IRREGULAR)), F.try_element_at(irregular, w)).when(F.length(w) <= 3, w)
    for ending, put in ENDINGS:
        out = out.when(ends(ending) & (F.length(w) > len(ending) + 2), F.concat(shorter(len(ending)), F.lit(put)))
    out = out.when(ends("s") & ~ends(*KEPT_S), shorter(1)).when(ends("ux") & ~ends(*KEPT_X), shorter(1))
    return F.when(word == "", word).otherwise(out.otherwise(w))


def _mapped(rule: Callable[[str | None], str | None]) -> Callable[[Column], Column]:
    def run(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for w in words:
            yield w.map(rule, na_action="ignore")

    return lambda column: F.pandas_udf(run, StringType())(column)


#: A column function; Arrow batches, one call of the rule per row.
stem_udf = _mapped(stem)
