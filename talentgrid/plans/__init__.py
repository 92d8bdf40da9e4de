"""Named queries over the logical tables, one module per operator family."""

from __future__ import annotations

import importlib

FAMILIES = [
    "scalars", "postings", "places", "linking", "taxonomy", "demand", "ranking", "coverage", "pay", "ordinal",
    "evaluation", "sampling", "corpus", "logs", "tables",
]


def load_all():
    from talentgrid.plans import registry

    for family in FAMILIES:
        importlib.import_module(f"talentgrid.plans.{family}")
    return registry
