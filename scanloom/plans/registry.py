"""Registration of queries: an operator over canonical tables, with the oracle's SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.sources import adapters

Tables = Callable[[str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, build: Callable[[Tables], DataFrame], sql: str | None = None, *tables: str) -> None:
        """tables: the canonical tables that the SQL names; base tables need no mention."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(lambda t: adapters.table(spark, sf_dir, t))

        self.queries[name] = run
        if sql is not None:
            self.oracles[name] = adapters.oracle(sql, *tables)


def tie_break(digits: int) -> float:
    return 1.3 * 10.0 ** -(digits + 3)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison. A small shift keeps values that are decimal ties from going either way."""
    return df.withColumns({c: F.round(F.col(c) + F.lit(tie_break(digits)), digits) + F.lit(0.0) for c in names})


def r(expression: str, name: str, digits: int = 6) -> str:
    """The same in SQL."""
    return f"round(({expression}) + {tie_break(digits):.1e}, {digits}) + 0.0 AS {name}"
