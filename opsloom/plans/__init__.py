"""Registered queries. Importing the suites fills the registry."""

from __future__ import annotations

import importlib

SUITES = ("relational", "business", "analytics", "kpis", "rules", "entities", "profiling", "quality",
          "anomalies", "documents", "operations", "streams", "tables")


def load_suites() -> None:
    for suite in SUITES:
        importlib.import_module(f"opsloom.plans.{suite}_suite")
