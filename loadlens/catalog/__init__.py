"""All registered queries of the workload diagnostics library."""

from __future__ import annotations

from importlib import import_module

from loadlens.catalog.base import Query

MODULES = ("scalars", "activity", "rules", "joins", "plans", "adapters", "evidence", "reports", "files")


def queries() -> dict[str, Query]:
    return {q.name: q for m in MODULES for q in import_module(f"loadlens.catalog.{m}").QUERIES}
