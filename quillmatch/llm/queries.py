"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quillmatch.llm import decontaminate, html, infill, jaccard, licenses, lines, packing, quality, substrings, tokens, toxicity, warc, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_licenses": licenses.op2_licenses,
        "op3_quality": quality.op3_quality,
        "op4_token_orc": tokens.op4_token_orc,
        "op5_warc": warc.op5_warc,
        "op6_packing": packing.op6_packing,
        "op7_line_dedup": lines.op7_line_dedup,
        "op8_jaccard": jaccard.op8_jaccard,
        "op9_substrings": substrings.op9_substrings,
        "op10_html": html.op10_html,
        "op11_whitening": whitening.op11_whitening,
        "op12_infill": infill.op12_infill,
        "op13_toxicity": toxicity.op13_toxicity,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality": quality.OP3_SQL, "op5_warc": warc.OP5_SQL, "op8_jaccard": jaccard.OP8_SQL, "op9_substrings": substrings.OP9_SQL, "op12_infill": infill.OP12_SQL}
