"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word: letters, digits and everything outside ASCII, after lower-casing.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the cluster names in ``spark.checkpoint.dir``.

    Only in local mode, as in tests, may it be unset: then a temporary folder is made. On a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    state = process_cache()
    if "local" not in state:
        state["local"] = f"file://{tempfile.mkdtemp(prefix='glanage-')}"
    return state["local"]


def scratch(spark: SparkSession) -> str:
    """This application's own folder in the shared one; ``clean`` deletes it, at the latest when the driver's Python ends while Spark still runs."""
    state, path = process_cache(), f"{shared_dir(spark)}/glanage-{spark.sparkContext.applicationId}"
    if path not in state.setdefault("scratch", {}):
        state["scratch"][path] = spark
        atexit.register(clean, spark)
    return path


def clean(spark: SparkSession) -> None:
    """Deletes all tables and archives that this application has saved; results that aren't consumed yet can't be read afterwards."""
    for path in [p for p, s in process_cache().get("scratch", {}).items() if s is spark]:
        try:
            _delete(spark, path)
        except Exception:  # the application has ended already: the folder is left to whoever keeps the shared one
            pass
        process_cache()["scratch"].pop(path, None)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint (the files outlive lost
    executors), but stays columnar and keeps its size known to the optimizer.
    """
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete saved tables that nothing will read again."""
    for df in tables:
        _delete(df.sparkSession, df.saved_path)


#: Hex digits of a digest that address a bit: 24 bits, so a bitmap has 2 MB, whatever it is made from.
HEX = 6


def bitmap(digests: DataFrame) -> bytes:
    """A bit for the first digits of every hex digest in the column d; at most 2 ** 18 words come to the driver."""
    at = F.conv(F.substring("d", 1, HEX), 16, 10).cast("long")
    words = digests.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(conv(substring(d, 1, {HEX}), 16, 10) % 64 as int))").alias("b"))
    bits = np.zeros(16**HEX // 64, np.int64)
    for w, b in words.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        bits[w] = b
    return bits.astype("<i8").tobytes()


def marked(bits: bytes, digest: str) -> bool:
    """Whether the bitmap has the bit of a hex digest."""
    at = int(digest[:HEX], 16)
    return bool(bits[at >> 3] >> (at & 7) & 1)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names.

    Extra columns of the input, whatever they are called, never get further,
    so they can't clash with what an operator adds.
    """
    return df.select(*(df[given].alias(own) for own, given in columns.items()))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def place(seed: int, *columns: str) -> Column:
    """A number from 0 to 1 that a hash of the columns gives: the order of bounded samples.

    To take the first k of N rows in this order, look only at places under
    2 k / N: what tasks then pass on doesn't grow with their number.
    """
    return F.xxhash64(F.lit(seed), *columns) / 2.0**64 + 0.5


def chunks(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of consecutive rows whose sizes sum to about ``most``; one row at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInPandas or mapInArrow that leaves no freed memory behind.

    Workers serve task after task; what the allocator keeps of a large batch
    would count against the executor for as long as they live.
    """

    def lean_run(batches: Iterator) -> Iterator:
        import ctypes
        import gc

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return lean_run


#: Rows and bytes that go to a Python worker at a time, at most: they bound its memory where texts are long.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch limits to these bounds where they are higher.

    Spark has no way to say this for one query, so it holds for the session. A
    session that sets lower limits keeps them. One row larger than the bound
    still makes a batch of its own.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key)).lower()
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, most)


def mapped(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str | StructType, arrow: bool = False) -> DataFrame:
    """mapInPandas (or mapInArrow) in small batches, without memory left behind."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(lean(run), schema) if arrow else df.mapInPandas(lean(run), schema)


def process_cache() -> dict:
    """A dict that lives as long as this process, on executors too.

    Functions are sent by value, so their module's globals are made anew for
    each task; this one is kept under a name of its own.
    """
    import sys
    import types

    return sys.modules.setdefault("_glanage_cache", types.ModuleType("_glanage_cache")).__dict__
