"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, html, jaccard, licenses, lines, media, packing, quality, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": licenses.op1_licenses,
        "op2_html": html.op2_html,
        "op3_quality": quality.op3_quality,
        "op4_neighbours": ann.op4_neighbours,
        "op5_chroma": media.op5_chroma,
        "op6_bpe": bpe.op6_bpe,
        "op7_lines": lines.op7_lines,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_pack": packing.op9_pack,
        "op10_jaccard": jaccard.op10_jaccard,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_lines": lines.OP7_SQL, "op10_jaccard": jaccard.OP10_SQL}
