"""Term weights and stop lists.

Tokens are (mot, doc_id), one row per occurrence. Every aggregate here combines
before it shuffles; word tables are joined on the word, and Spark decides from
sizes at run time whether a side is broadcast.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glanage.functions import text


def tokens(docs: DataFrame, content: Column | None = None, doc_id: str = "doc_id", signs: str = string.punctuation) -> DataFrame:
    """(mot, doc_id) of every occurrence in cleaned text."""
    content = F.col("text") if content is None else content
    return docs.select(F.explode(text.words(text.clean(content, signs))).alias("mot"), F.col(doc_id).alias("doc_id"))


def tf(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("mot", "doc_id").agg(F.count("*").alias("tf"))


def n_documents(tf: DataFrame) -> DataFrame:
    """One row n: documents with a token."""
    return tf.agg(F.count_distinct("doc_id").alias("n"))


def df(tf: DataFrame) -> DataFrame:
    """Documents per word; tf has a row per word and document, so counting rows will do."""
    return tf.groupBy("mot").agg(F.count("*").alias("df"))


def idf(tf: DataFrame) -> DataFrame:
    """log10(n / df), without smoothing."""
    return df(tf).crossJoin(F.broadcast(n_documents(tf))).select("mot", F.log10(F.col("n") / F.col("df")).alias("idft"))  # one row


def tf_idf(tf: DataFrame, idf: DataFrame) -> DataFrame:
    return tf.join(idf, "mot").select("doc_id", "mot", (F.col("tf") * F.col("idft")).alias("tf_idf"))


#: Equal steps between the least and the largest value that a quantile counts rows in.
BINS = 1 << 16


def quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """One row: the exact quantile, interpolated; null if there is no value.

    Rows are counted in bins, and only the values of the one or two bins that
    hold the rank are put in order: a task gets as many values as such a bin has
    different ones, and BINS counts.
    """
    values = df.select(F.col(column).alias("v")).where("v is not null")
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    share = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    placed = values.crossJoin(F.broadcast(ends)).select("v", "n", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin"))  # one row
    sizes = placed.groupBy("bin").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = q * (F.col("n") - 1)
    holds = (F.col("before") <= F.ceil(rank)) & (F.col("before") + F.col("c") > F.floor(rank))
    chosen = sizes.withColumn("before", before).where(holds).select("bin", "before", "n")
    counts = placed.drop("n").join(F.broadcast(chosen), "bin").groupBy("v").agg(F.count("*").alias("c"), F.min("before").alias("before"), F.first("n").alias("n"))  # two rows
    # The bins before the first chosen one, and the values before in the chosen ones.
    running = F.coalesce(F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = counts.withColumn("at", F.min("before").over(Window.partitionBy()) + running)
    of = lambda r: F.max(F.when((F.col("at") <= r) & (F.col("at") + F.col("c") > r), F.col("v")))
    ranked = least.agg(of(F.floor(rank)).alias("a"), of(F.ceil(rank)).alias("b"), F.first(rank - F.floor(rank)).alias("f"))
    return ranked.select((F.col("a") + F.col("f") * (F.col("b") - F.col("a"))).alias("cut"))


def low_tail(scored: DataFrame, q: float = 0.1, column: str = "tf_idf") -> DataFrame:
    """Rows at or below a quantile."""
    return scored.crossJoin(F.broadcast(quantile(scored, column, q))).where(F.col(column) <= F.col("cut")).drop("cut")


def high_tail(scored: DataFrame, q: float = 0.9, column: str = "tf_idf") -> DataFrame:
    """Rows at or above a quantile."""
    return scored.crossJoin(F.broadcast(quantile(scored, column, q))).where(F.col(column) >= F.col("cut")).drop("cut")


def clipped(scored: DataFrame, q: float = 0.99, column: str = "tf_idf") -> DataFrame:
    """Values above a quantile brought down to it."""
    return scored.crossJoin(F.broadcast(quantile(scored, column, q))).withColumn(column, F.least(column, "cut")).drop("cut")


def mean_per_word(scored: DataFrame) -> DataFrame:
    return scored.groupBy("mot").agg(F.avg("tf_idf").alias("avg_tf_idf"))


def histogram(scored: DataFrame, low: float, high: float, bins: int, column: str = "tf_idf") -> DataFrame:
    """Rows per bin of equal width over [low, high]; the last bin includes its upper end."""
    inside = scored.where(F.col(column).between(low, high))
    bin_ = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def stop_words_by_tails(scored: DataFrame, low_q: float = 0.17, least: float = 15.0) -> DataFrame:
    """Words with any score in the low tail or of at least ``least``."""
    low = low_tail(scored, low_q).select("mot")
    return low.unionByName(scored.where(F.col("tf_idf") >= least).select("mot")).distinct()


def stop_words_by_means(scored: DataFrame, idf: DataFrame, idf_below: float = 0.2, q: float = 0.02, known: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """Words of small idf, or whose mean score is in the low tail of all means; without those already known.

    Many means are equal right at the cut: they are rounded first, so that the order of summation doesn't decide.
    """
    common = idf.where(F.col("idft") < idf_below).select("mot")
    means = mean_per_word(scored).withColumn("avg_tf_idf", F.round("avg_tf_idf", digits))
    rare = means.crossJoin(F.broadcast(quantile(means, "avg_tf_idf", q))).where(F.col("avg_tf_idf") < F.col("cut")).select("mot")
    found = common.unionByName(rare).distinct()
    return found if known is None else found.join(known.select("mot"), "mot", "left_anti")


def without_stop_words(tokens: DataFrame, stop: DataFrame) -> DataFrame:
    return tokens.join(stop.select("mot"), "mot", "left_anti")


#: Stop lists of up to so many words go into the plan itself, with a hash lookup for each token.
LISTED = 5_000


def filtered_text(docs: DataFrame, stop: DataFrame, column: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text) with the stop words taken out and the order kept; documents may end up empty.

    A stop list is short: it is looked at, and then nothing is shuffled. Only a
    longer one than ``LISTED`` is joined, which gives the same rows.
    """
    listed = [r[0] for r in stop.select("mot").where("mot is not null").limit(LISTED + 1).collect()]
    tokens = text.words(text.clean(F.col(column)))
    if len(listed) <= LISTED:
        kept = F.filter(tokens, lambda w: ~w.isin(listed)) if listed else tokens
        return docs.select(F.col(doc_id).alias("doc_id"), F.array_join(kept, " ").alias("text"))
    placed = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(tokens).alias("pos", "mot"))
    kept = placed.join(stop.select("mot"), "mot", "left_anti")
    built = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "mot"))).alias("w"))
    whole = docs.select(F.col(doc_id).alias("doc_id")).join(built, "doc_id", "left")
    return whole.select("doc_id", F.coalesce(F.array_join("w.mot", " "), F.lit("")).alias("text"))


def top(scored: DataFrame, n: int, *by: Column) -> DataFrame:
    """The first n rows of a total order."""
    return scored.orderBy(*by).limit(n)
