"""Query catalogue: importing the modules registers their queries."""

from importlib import import_module

from .registry import ORACLE, QUERIES

MODULES = (
    "tpch", "wideweb", "relational", "functions", "history", "events", "ingest", "maintenance", "search", "udfs",
    "streams",
)
for _name in MODULES:
    import_module(f"{__name__}.{_name}")

__all__ = ["ORACLE", "QUERIES"]
