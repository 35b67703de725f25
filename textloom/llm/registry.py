"""The queries of this subpackage and, where SQL can express them, the SQL whose rows they match."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_quality_rules": "quality_rules",
    "op2_license_scan": "license_scan",
    "op3_secret_scan": "secret_scan",
    "op4_packing": "packing",
    "op5_line_dedup": "line_dedup",
    "op6_warc_fixity": "warc_fixity",
    "op7_simhash_forest": "simhash_forest",
    "op8_decontaminate": "decontaminate",
    "op9_sharding": "sharding",
    "op10_language_fusion": "language_fusion",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{_MODULES[name]}")


def queries() -> dict:
    return {name: _module(name).query for name in _MODULES}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(_module(name), "SQL", None) for name in _MODULES}
    return {name: sql for name, sql in found.items() if sql}
