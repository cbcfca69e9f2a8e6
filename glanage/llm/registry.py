"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glanage.llm import decontamination, language, licenses, media, minhash, pii, segmentation, toolcalls, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash": minhash.op1_minhash,
        "op2_tool_calls": toolcalls.op2_tool_calls,
        "op3_language": language.op3_language,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_decontamination": decontamination.op5_decontamination,
        "op6_licenses": licenses.op6_licenses,
        "op7_warc": warc.op7_warc,
        "op9_media": media.op9_media,
        "op8_segmentation": segmentation.op8_segmentation,
        "op10_pii": pii.op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_tool_calls": toolcalls.ORACLE, "op5_decontamination": decontamination.ORACLE}
