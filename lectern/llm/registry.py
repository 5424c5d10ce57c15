"""Queries of this subpackage: name -> callable(spark, sf_dir), and SQL where it can express them."""

from __future__ import annotations

import importlib

#: Query name -> module with ``query(spark, sf_dir)`` and, where SQL can express it, ``SQL``.
MODULES = {
    "op1_quality": "q01",
    "op2_lm_score": "q02",
    "op3_bpe": "q03",
    "op4_suffix_array_dedup": "q04",
    "op5_exact_dedup": "q05",
    "op6_decontaminate": "q06",
    "op7_near_dedup": "q07",
    "op8_toxicity": "q08",
    "op9_substring_dedup": "q09",
    "op10_license_scan": "q10",
}


def queries() -> dict:
    out = {}
    for name, module in MODULES.items():
        out[name] = importlib.import_module(f"{__package__}.{module}").query
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in MODULES.items():
        sql = getattr(importlib.import_module(f"{__package__}.{module}"), "SQL", None)
        if sql:
            out[name] = sql
    return out
