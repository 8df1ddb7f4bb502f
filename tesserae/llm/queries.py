"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.collocations import OP13_SQL, op13_collocations
from tesserae.llm.decontamination import OP1_SQL, op1_decontamination
from tesserae.llm.license_scan import OP2_SQL, op2_license_scan
from tesserae.llm.line_dedup import OP4_SQL, op4_line_dedup
from tesserae.llm.lm_scoring import op3_lm_scoring
from tesserae.llm.mixing import op9_mixing
from tesserae.llm.near_dedup import op6_near_dedup
from tesserae.llm.packing import op11_packing
from tesserae.llm.pii import op7_pii
from tesserae.llm.quality_classifier import op8_quality_classifier
from tesserae.llm.quality_rules import OP5_SQL, op5_quality_rules
from tesserae.llm.sharding import op10_sharding
from tesserae.llm.whitening import op12_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_license_scan": op2_license_scan,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_line_dedup": op4_line_dedup,
        "op5_quality_rules": op5_quality_rules,
        "op6_near_dedup": op6_near_dedup,
        "op7_pii": op7_pii,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_mixing": op9_mixing,
        "op10_sharding": op10_sharding,
        "op11_packing": op11_packing,
        "op12_whitening": op12_whitening,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": OP1_SQL,
        "op2_license_scan": OP2_SQL,
        "op4_line_dedup": OP4_SQL,
        "op5_quality_rules": OP5_SQL,
        "op13_collocations": OP13_SQL,
    }
