"""Queries and comparison SQL, one module per operator family."""

from importlib import import_module

MODULES = ["rollups", "normals", "series_entries", "tables_entries", "reports_entries", "model_entries", "stream_entries"]


def load():
    for name in MODULES:
        import_module(f"entries.{name}")
    from entries import base
    return base.QUERIES, base.ORACLE
