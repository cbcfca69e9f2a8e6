"""Search: a structured query lowered to semi and anti joins over the postings.

``docs`` has one row per doc_id, with date, rubrique and has_image; ``postings``
has field, term and doc_id. Postings are filtered to the named terms before anything moves, and read once for all words of a query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glanage.operators import lexicon as lex
from glanage.plans.query import PartialDate, StructuredQuery
from glanage.plans.question import analyse


#: Terms that one number has bits for.
_BITS = 62


def matching(postings: DataFrame, wanted: Sequence[tuple[str, Sequence[str], str]], unwanted: Sequence[tuple[str, Sequence[str]]] = ()) -> DataFrame:
    """doc_id of documents that meet every wanted criterion (field, terms, op) and hold no unwanted term, in one pass over the postings.

    op is or (any term) or and (all); terms in no document are ignored, and a
    criterion without a known term is met by none. Each document gets the set of
    its terms as bits, and so has the collection: the terms that are known.
    """
    named = sorted({(f, t) for f, terms, *_ in (*wanted, *unwanted) for t in terms})
    bit = {x: divmod(i, _BITS) for i, x in enumerate(named)}
    n = -(-len(named) // _BITS)
    fields = sorted({f for f, _ in named})
    here = F.lit(False)
    for f in fields:
        here = here | ((F.col("field") == f) & F.col("term").isin([t for g, t in named if g == f]))
    own = postings.where(here).select("doc_id", F.struct("field", "term").alias("x"))

    def bits(word: int) -> Column:
        value = F.lit(0).cast("long")
        for (f, t), (w, at) in bit.items():
            if w == word:
                value = F.when((F.col("x.field") == f) & (F.col("x.term") == t), F.lit(1 << at).cast("long")).otherwise(value)
        return value

    masks = [f"m{w}" for w in range(n)]
    per_doc = own.groupBy("doc_id").agg(*(F.bit_or(bits(w)).alias(m) for w, m in enumerate(masks)))
    mask = lambda f, terms: [sum(1 << bit[f, t][1] for t in set(terms) if bit[f, t][0] == w) for w in range(n)]
    some = lambda prefix, values: _any([F.col(f"{prefix}{w}").bitwiseAND(F.lit(v).cast("long")) != 0 for w, v in enumerate(values) if v])
    if any(op == "and" and len(set(terms)) > 1 for _, terms, op in wanted):
        known = per_doc.agg(*(F.coalesce(F.bit_or(m), F.lit(0)).alias(f"k{w}") for w, m in enumerate(masks)))
        per_doc = per_doc.crossJoin(F.broadcast(known))  # one row
    good = F.lit(True)
    for f, terms, op in wanted:
        values = mask(f, terms)
        if op == "or" or len(set(terms)) == 1:
            good = good & some("m", values)
        else:
            held = lambda w, v: F.col(f"k{w}").bitwiseAND(F.lit(v).cast("long"))
            good = good & some("k", values)
            for w, v in enumerate(values):
                good = good & (F.col(f"m{w}").bitwiseAND(held(w, v)) == held(w, v))
    for f, terms in unwanted:
        good = good & ~some("m", mask(f, terms))
    return per_doc.where(good).select("doc_id")


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def having_terms(postings: DataFrame, field: str, terms: Sequence[str], op: str = "and") -> DataFrame:
    """doc_id, maybe repeated, of documents with any (or) or all (and) of the terms; terms in no document are ignored, none known gives none."""
    if op == "or" or len(set(terms)) == 1:
        return postings.where((F.col("field") == field) & F.col("term").isin(list(terms))).select("doc_id")  # repeats don't matter to a semi or anti join
    return matching(postings, [(field, terms, op)])


def date_matches(date: Column, d: PartialDate) -> Column:
    """Every known part is equal."""
    c = F.lit(True)
    for part, of in ((d.year, F.year), (d.month, F.month), (d.day, F.dayofmonth)):
        if part is not None:
            c = c & (of(date) == part)
    return c


def date_at_least(date: Column, d: PartialDate) -> Column:
    """Not before d, comparing the known parts by year, month, day; a whole date as a range that scans can use."""
    if d.year is not None and d.month is not None and d.day is not None:
        return date >= F.lit(f"{d.year:04d}-{d.month:02d}-{d.day:02d}").cast("date")
    return _order(date, d) >= _of(d)


def date_at_most(date: Column, d: PartialDate) -> Column:
    if d.year is not None and d.month is not None and d.day is not None:
        return date < F.date_add(F.lit(f"{d.year:04d}-{d.month:02d}-{d.day:02d}").cast("date"), 1)
    return _order(date, d) <= _of(d)


def _order(date: Column, d: PartialDate) -> Column:
    parts = [(d.year, F.year(date), 10_000), (d.month, F.month(date), 100), (d.day, F.dayofmonth(date), 1)]
    return sum((c * w for v, c, w in parts if v is not None), F.lit(0))


def _of(d: PartialDate) -> int:
    return (d.year or 0) * 10_000 + (d.month or 0) * 100 + (d.day or 0)


def date_condition(date: Column, q: StructuredQuery) -> Column | None:
    """A precise date overrides bounds; an excluded one always holds. None if the query names no date."""
    c = None
    both = lambda a, b: b if a is None else a & b
    if q.date_on:
        c = date_matches(date, q.date_on)
    else:
        if q.date_from:
            c = both(c, date_at_least(date, q.date_from))
        if q.date_to:
            c = both(c, date_at_most(date, q.date_to))
    if q.date_not:
        c = both(c, ~date_matches(date, q.date_not))
    return c


def sections(docs: DataFrame) -> DataFrame:
    return docs.where("rubrique is not null").select(F.lower(F.trim("rubrique")).alias("rubrique")).distinct()


def search(q: StructuredQuery, docs: DataFrame, postings: DataFrame, compat: bool = False) -> DataFrame:
    """Documents (doc_id), or the sections of the documents (rubrique), that the query asks for.

    With ``compat`` a criterion that no document meets is passed over instead of
    emptying the result, as the older engine does.
    """
    section = F.lower(F.trim("rubrique"))
    words = [(field, terms, op) for field, terms, op in (("texte", q.kw_yes, q.kw_op), ("titre", q.titres, q.titre_op)) if terms]
    steps = []
    if compat:
        for field, terms, op in words:
            steps.append(lambda d, f=field, t=terms, o=op: d.join(having_terms(postings, f, t, o), "doc_id", "left_semi"))
    elif words:
        steps.append(lambda d: d.join(matching(postings, words, [("texte", q.kw_no)] if q.kw_no else ()), "doc_id", "left_semi"))
    if q.rubriques:
        named = {r.lower().strip() for r in q.rubriques}
        # A document has one section: it is in all of several only if they are the same.
        steps.append(lambda d: d.where(section.isin(list(named)) if q.rub_op == "or" or len(named) == 1 else F.lit(False)))
    if q.images:
        steps.append(lambda d: d.where("has_image"))
    condition = date_condition(F.col("date"), q)
    if condition is not None:
        steps.append(lambda d: d.where(condition))
    out = docs
    for step in steps:
        narrowed = step(out)
        if not compat or not narrowed.isEmpty():
            out = narrowed
        elif step is not steps[-1]:
            out = docs
    if q.kw_no and (compat or not words):
        out = out.join(having_terms(postings, "texte", q.kw_no, "or"), "doc_id", "left_anti")
    return sections(out) if q.target == "rubriques" else out.select("doc_id")


class SearchEngine:
    """Questions over one collection; with a lexicon (mot, lemme, ord) keywords are corrected first."""

    def __init__(self, docs: DataFrame, postings: DataFrame, lexicon: DataFrame | None = None):
        self.docs, self.postings, self.lexicon = docs, postings, lexicon

    def corrected(self, words: Sequence[str]) -> tuple[str, ...]:
        if self.lexicon is None or not words:
            return tuple(words)
        w = self.docs.sparkSession.createDataFrame([(x,) for x in words], "mot string")
        found = {r["mot"]: r["corrected"] for r in lex.correct(w, self.lexicon).collect()}  # a row per word of the question
        return tuple(found.get(x.lower().strip(), x) for x in words if x.strip())

    def plan(self, question: str) -> StructuredQuery:
        q = analyse(question)
        return StructuredQuery(**{**q.__dict__, "kw_yes": self.corrected(q.kw_yes), "kw_no": self.corrected(q.kw_no)})

    def search(self, question: str | StructuredQuery, compat: bool = False) -> DataFrame:
        q = self.plan(question) if isinstance(question, str) else question
        return search(q, self.docs, self.postings, compat)


def search_docs(bulletins: DataFrame) -> DataFrame:
    """docs of bulletins."""
    return bulletins.select(F.col("fichier").alias("doc_id"), "date", "rubrique", F.coalesce(F.size("images") > 0, F.lit(False)).alias("has_image"))
