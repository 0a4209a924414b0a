"""Registered queries, one per operator."""

from importlib import import_module

from shelfmark.plans.registry import ORACLES, QUERIES

for _name in ("log_queries", "page_queries", "crawl_queries", "stream_queries"):
    import_module(f"shelfmark.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
