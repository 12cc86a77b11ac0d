"""Registered queries, one module per area of the inventory."""

from __future__ import annotations

import importlib

AREAS = ("sources", "scalars", "cohort", "rasters", "screening", "evaluation", "modelling")


def load_catalogue():
    from cohortloom.plans import registry

    for area in AREAS:
        importlib.import_module(f"cohortloom.plans.{area}")
    return registry.QUERIES, registry.ORACLES
