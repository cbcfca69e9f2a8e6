"""Boolean retrieval: an expression as one aggregate over the postings it names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glanage.plans import expression as ex


def evaluate(expression: str | ex.Disjunction, postings: DataFrame, universe: DataFrame) -> DataFrame:
    """doc_id of the documents that satisfy the expression, in order.

    ``postings`` has term and doc_id; ``universe`` has every doc_id, so that NOT
    also finds documents without postings. Unknown terms are in no document.
    Only postings of the named terms are shuffled.
    """
    groups = ex.parse(expression) if isinstance(expression, str) else expression
    names = ex.terms(groups)
    if not names:
        return universe.select("doc_id").limit(0)
    has = {t: f"t{i}" for i, t in enumerate(names)}
    found = postings.where(F.col("term").isin(names)).groupBy("doc_id").agg(*(F.bool_or(F.col("term") == t).alias(c) for t, c in has.items()))

    def holds(x: ex.Literal) -> Column:
        c = F.coalesce(F.col(has[x.term]), F.lit(False))
        return c if x.positive else ~c

    condition = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, map(holds, g)) for g in groups))
    needs_all = any(not any(x.positive for x in g) for g in groups)
    rows = universe.select("doc_id").distinct().join(found, "doc_id", "left") if needs_all else found
    return rows.where(condition).select("doc_id").orderBy("doc_id")


def union(*sets: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), sets).distinct()


def intersect(*sets: DataFrame) -> DataFrame:
    """Documents in every set, in one pass over their union."""
    tagged = [s.select("doc_id", F.lit(i).alias("i")) for i, s in enumerate(sets)]
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    return rows.groupBy("doc_id").agg(F.count_distinct("i").alias("n")).where(F.col("n") == len(sets)).select("doc_id")


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("doc_id"), "doc_id", "left_anti")
