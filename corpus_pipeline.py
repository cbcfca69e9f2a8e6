"""The corpus pipeline: documents in, sampled segmentations of the clean ones out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.

1. toxicity: documents whose score reaches their language's threshold go.
2. near_duplicates: one document of each class of near copies stays.
3. decontamination: documents that hold a benchmark item go.
4. pii: personal values are replaced by format-preserving pseudonyms.
5. segmentation: sampled segmentations of each text, with inclusion scores.

Null and empty texts pass through the first four stages (equal ones count as
copies); very long texts are taken whole by every stage; rows that share a
doc_id leave the second stage as one, the least; ties go as the stages' own
modules say; an empty table gives an empty result; extra columns of documents
are dropped by the first stage. A stage's table is deleted when the next one is
written, the last when the application ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glanage.llm.common import forget, saved
from glanage.llm.decontamination import stage_decontamination
from glanage.llm.minhash import stage_near_duplicates
from glanage.llm.pii import stage_pii
from glanage.llm.segmentation import stage_segmentation
from glanage.llm.toxicity import stage_toxicity

STAGES = [
    ("toxicity", stage_toxicity),
    ("near_duplicates", stage_near_duplicates),
    ("decontamination", stage_decontamination),
    ("pii", stage_pii),
    ("segmentation", stage_segmentation),
]

#: Several stages (a trained model, sampling, a keyed permutation) are not SQL; tests/llm holds the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what comes between is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, saved(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            forget(last)
    return STAGES[-1][1](spark, docs, sf_dir)
