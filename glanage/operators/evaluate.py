"""Retrieval quality against relevance judgements."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_recall(queries: DataFrame, predicted: DataFrame, relevant: DataFrame) -> DataFrame:
    """query_id, precision, recall and f1 of every query.

    Nothing predicted and nothing relevant counts as 1, 1; nothing predicted as
    precision 1, recall 0; nothing relevant as precision 0, recall 1; f1 is 0
    where both are.
    """
    p = predicted.select("query_id", "doc_id").distinct().withColumn("p", F.lit(True))
    r = relevant.select("query_id", "doc_id").distinct().withColumn("r", F.lit(True))
    hits = p.join(r, ["query_id", "doc_id"], "full_outer").groupBy("query_id")
    counts = hits.agg(F.count("p").alias("n_p"), F.count("r").alias("n_r"), F.count_if(F.col("p") & F.col("r")).alias("n_both"))
    every = queries.select("query_id").distinct().join(counts, "query_id", "left").na.fill(0)
    precision = F.when(F.col("n_p") > 0, F.col("n_both") / F.col("n_p")).otherwise(1.0)
    recall = F.when(F.col("n_r") > 0, F.col("n_both") / F.col("n_r")).otherwise(1.0)
    scored = every.select("query_id", precision.alias("precision"), recall.alias("recall"))
    both = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def means(scored: DataFrame) -> DataFrame:
    return scored.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")))


def mean_latency(run: Callable[[object], object], queries: Iterable[object], repeats: int = 1) -> float:
    """Mean seconds that ``run`` takes per query."""
    asked = list(queries)
    began = time.perf_counter()
    for _ in range(repeats):
        for q in asked:
            run(q)
    return (time.perf_counter() - began) / max(1, repeats * len(asked))
