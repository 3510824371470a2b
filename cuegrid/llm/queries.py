"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: query -> (module, callable, name of its SQL or None)
_TABLE = {
    "op1_near_dedup": ("near_dedup", "op1_near_dedup", "OP1_SQL"),
    "op2_topk": ("topk", "op2_topk", "OP2_SQL"),
    "op3_licenses": ("licenses", "op3_licenses", None),
    "op4_quality": ("quality", "op4_quality", None),
    "op5_pii": ("pii", "op5_pii", None),
    "op7_mix": ("mixing", "op7_mix", "OP7_SQL"),
    "op8_language": ("language", "op8_language", None),
    "op9_warc": ("warc", "op9_warc", "OP9_SQL"),
    "op10_line_dedup": ("line_dedup", "op10_line_dedup", "OP10_SQL"),
    "op6_pack": ("packing", "op6_pack", None),
    "licenses_base": ("base_sql", "licenses_base", "LICENSES_SQL"),
    "quality_base": ("base_sql", "quality_base", "QUALITY_SQL"),
    "pii_base": ("base_sql", "pii_base", "PII_SQL"),
}


def llm_queries() -> dict:
    return {name: getattr(import_module(f"cuegrid.llm.{module}"), call) for name, (module, call, _) in _TABLE.items()}


def llm_oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"cuegrid.llm.{module}"), sql) for name, (module, _, sql) in _TABLE.items() if sql}
