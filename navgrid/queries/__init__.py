"""Registered queries: every operator on the driver tables, each with the SQL that must give the same rows."""

from importlib import import_module

from navgrid.queries.common import REGISTRY

for _module in ("cleaning", "tables", "panels", "series", "portfolios", "frontiers", "archives"):
    import_module(f"navgrid.queries.{_module}")

__all__ = ["REGISTRY"]
