"""Registered queries over the provided tables, with their reference SQL."""

from importlib import import_module

MODULES = ("records", "windows", "quality", "signals", "outcomes", "models", "live", "storage")


def load_all():
    """All queries and their SQL, by name."""
    from driftline.catalog import registry

    for module in MODULES:
        import_module(f"driftline.catalog.{module}")
    return dict(registry.QUERIES), dict(registry.REFERENCE_SQL)
