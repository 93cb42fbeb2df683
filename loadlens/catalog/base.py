"""How a query is registered: its name, what it does on the views, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from loadlens.sources.views import Views, with_views


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Views], DataFrame]
    sql: str | None = None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.run(Views(spark, sf_dir))

    @property
    def oracle(self) -> str | None:
        return with_views(self.sql) if self.sql else None
