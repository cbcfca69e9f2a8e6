"""Indexes kept up to date from a stream of documents.

An extension of the batch build: new documents arrive as files, their postings
are appended in micro-batches, and a document that comes twice is indexed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glanage.operators.index import word_index


def stream_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def index_stream(docs: DataFrame, out: str, checkpoint: str, field: str = "texte") -> StreamingQuery:
    """Appends the postings of new documents to a Parquet table partitioned by batch.

    A batch that is run again after a failure replaces its own partition, so
    nothing is counted twice; ids seen before are left to ``latest``.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        once = batch.dropDuplicates(["doc_id"])
        word_index(once, field, F.col("text")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The postings, each document as its first batch had it."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    first = rows.groupBy("doc_id").agg(F.min("batch").alias("batch"))
    return rows.join(first, ["doc_id", "batch"]).drop("batch")


def term_counts(docs: DataFrame, watermark: str | None = None, time: str = "ts", window: str = "1 day") -> DataFrame:
    """Documents per term, over windows of event time if a watermark is given."""
    from glanage.functions import text

    if watermark:
        docs = docs.withWatermark(time, watermark)
    words = docs.select(*([F.window(time, window).alias("window")] if watermark else []), F.explode(F.array_distinct(text.words(text.clean(F.col("text"))))).alias("term"))
    return words.groupBy(*(["window", "term"] if watermark else ["term"])).agg(F.count("*").alias("n"))
