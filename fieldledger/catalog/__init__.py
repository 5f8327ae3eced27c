"""Every operator as a query over the given tables."""

import importlib

from .registry import QUERIES, SQL, query

for _m in ("filters", "aggregates", "joins", "windows", "order", "upserts", "text", "sources", "payloads", "plans", "streams"):
    try:
        importlib.import_module(f"{__name__}.{_m}")
    except ModuleNotFoundError as e:
        if _m not in str(e): raise

__all__ = ["QUERIES", "SQL", "query"]
