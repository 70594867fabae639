"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scanloom.plans import clouds, models, rig, spatial, tracks
from scanloom.sources import adapters

PARTS = (clouds, tracks, spatial, models, rig)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clouds.flagship(adapters.table(spark, sf_dir, "points"))


def queries() -> dict:
    return {k: v for part in PARTS for k, v in part.REG.queries.items()}


def oracles() -> dict[str, str]:
    return {k: v for part in PARTS for k, v in part.REG.oracles.items()}
