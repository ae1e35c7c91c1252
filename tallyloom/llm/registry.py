"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: query name -> module of this subpackage that defines a function of that name
MODULES = {
    "op1_sharding": "sharding",
    "op4_jaccard_join": "jaccard_join",
    "op5_best_fit_packing": "best_fit_packing",
    "op2_token_attribution": "token_attribution",
    "op10_voronoi_knn": "voronoi_knn",
    "op3_license_scan": "license_scan",
    "op9_source_mixing": "source_mixing",
    "op6_pii": "pii",
    "op7_substring_dedup": "substring_dedup",
    "op8_quality_rules": "quality_rules",
    "op12_importance_resampling": "importance_resampling",
    "op13_prefix_trie": "prefix_trie",
    "op11_secret_scan": "secret_scan",
}


def queries() -> dict:
    found = {}
    for name, module in MODULES.items():
        found[name] = getattr(importlib.import_module(f"tallyloom.llm.{module}"), name)
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in MODULES.items():
        sql = getattr(importlib.import_module(f"tallyloom.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
