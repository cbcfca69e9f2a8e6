"""Connected components of an edge table, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glanage.llm.common import forget, saved


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node that has an edge; root is the least id it can reach.

    ``edges`` has a and b. Alternates large-star and small-star steps until the
    edges no longer change; the number of steps grows with the logarithm of the
    longest chain. Loops, repeated and reversed edges make no difference; no
    edges give no rows.
    """
    lo, hi = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    now, before = saved(edges.select(lo, hi).where("lo < hi").distinct(), "edges"), None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)")).alias("h")).first()
        if before == tuple(seen) or seen["n"] == 0:
            return now.select(F.col("hi").alias("id"), F.col("lo").alias("root")).unionByName(
                now.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct()
            )
        before = tuple(seen)
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # Kept apart, so that Spark can split the rows of a centre in the join.
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        near = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(near, "hi").select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        last, now = now, saved(small.select("e.lo", "e.hi").where("lo < hi").distinct(), "edges")
        forget(last, least)
