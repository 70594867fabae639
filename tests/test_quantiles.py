"""Percentiles by narrowing buckets, against Spark's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators.quantiles import exact_percentiles, percentile_row

R = np.random.default_rng(1)
SHARES = (0.0, 0.005, 0.25, 0.5, 0.7, 0.95, 0.995, 1.0)


@pytest.mark.parametrize("values", [R.normal(size=20001), np.exp(R.normal(size=20000) * 20), R.integers(0, 4, 20000), [3.0], [1.0, 2.0], -np.exp(R.normal(size=999) * 8)], ids=["normal", "wide", "ties", "one", "two", "negative"])
def test_percentiles_are_exact(spark, values):
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    want = rows.agg(*[F.percentile("v", F.lit(p)).alias(str(p)) for p in SHARES]).first().asDict()
    assert exact_percentiles(rows, {str(p): (F.col("v"), p) for p in SHARES}) == want


def test_odd_rows_do_not_count(spark):
    odd = [(None,), (float("nan"),), (float("inf"),), (float("-inf"),)]
    rows = spark.createDataFrame([*odd, (1.0,), (5.0,)], "v double")
    assert exact_percentiles(rows, {"a": (F.col("v"), 0.5), "b": (F.col("v") * 2, 1.0)}) == {"a": 3.0, "b": 10.0}
    for none in (rows.limit(0), spark.createDataFrame(odd, "v double")):
        assert percentile_row(none, {"a": (F.col("v"), 0.5)}).collect() == [(None,)]


def test_percentiles_of_groups(spark):
    from scanloom.operators.quantiles import grouped_percentiles

    r = np.random.default_rng(3)
    groups = {"hot": np.concatenate([r.lognormal(0, 6, 9000), [1e300, -1e300]]), "ties": np.repeat([1.0, 2.0, 2.0], 40), "one": np.array([5.0]), None: r.integers(0, 9, 30).astype(float), "two": np.array([3.0, 4.0])}
    rows = [(k, float(v)) for k, own in groups.items() for v in own] + [("hot", None), ("hot", float("nan")), ("hot", float("inf")), ("empty", None)]
    table = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {g["k"]: g for g in grouped_percentiles(table, ["k"], {"low": (F.col("v"), 0.0), "mid": (F.col("v"), 0.5), "p90": (F.col("v"), 0.9), "neg": (-F.col("v"), 1.0)}).collect()}
    assert len(got) == 6 and got["empty"]["mid"] is None
    for k, own in groups.items():
        for name, share, values in (("low", 0, own), ("mid", 50, own), ("p90", 90, own), ("neg", 100, -own)):
            assert np.isclose(got[k][name], np.percentile(values, share), rtol=1e-12), (k, name)
    assert grouped_percentiles(table.limit(0), ["k"], {"mid": (F.col("v"), 0.5)}).count() == 0
