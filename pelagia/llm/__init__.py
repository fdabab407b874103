"""Operators for preparing training data. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module of this subpackage with query(spark, sf_dir) and, where SQL can say it, ORACLE_SQL.
MODULES = {
    "op1_suffix_dedup": "suffix_dedup",
    "op2_quality_rules": "quality_rules",
    "op3_warc": "warc",
    "op4_quality_classifier": "quality_classifier",
    "op5_simhash": "simhash",
    "op6_license_scan": "license_scan",
    "op7_byte_bpe": "byte_bpe",
    "op8_decontaminate": "decontaminate",
    "op9_url_filter": "url_filter",
    "op10_substring_dedup": "substring_dedup",
}


def queries() -> dict:
    return {name: import_module(f"pelagia.llm.{m}").query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"pelagia.llm.{m}"), "ORACLE_SQL", None) for name, m in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
