"""Named queries over the sample tables, each with the same query in plain SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

MODULES = ["monitoring", "labeling", "drifting", "evaluating", "governing", "checking", "perturbing", "storing", "streams"]


def load():
    """Import every catalog module, which fills the registry."""
    from modelwatch.catalog import registry

    for name in MODULES:
        import_module(f"modelwatch.catalog.{name}")
    return registry
