"""Every operator as a runnable query with the SQL that states its result."""

from importlib import import_module

THEMES = ("features", "statistics", "rules", "tables", "models", "forecasts", "streams", "jobs")


def _collect(name):
    out = {}
    for theme in THEMES:
        part = getattr(import_module(f"aerolith.catalog.{theme}"), name)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        out |= part
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict:
    return _collect("ORACLES")
