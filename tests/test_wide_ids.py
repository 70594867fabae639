"""Neighbour queries on order keys so large that the ids of points are more than a long holds."""

import pytest
from pyspark.sql import functions as F

from scanloom.plans import catalog

#: Added to the order keys: a multiple of 5 and 101, so that points_b has the same rows, and ids that grow by a constant modulo 2 ** 64.
SHIFT = 20_200_000


@pytest.fixture(scope="module")
def shifted(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shifted"))
    spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("l_orderkey", F.col("l_orderkey") + SHIFT).write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name", ["j5_radius_join", "j6_nn_join", "j7_knn_join", "a25_overlap_metrics", "a7_normals"])
def test_ids_beyond_a_long(spark, sf, shifted, name):
    """The same neighbours under the ids modulo 2 ** 64."""
    ids = {"point_id", "point_id_b", "first"}
    by = SHIFT * 1_024_000_000_000

    def rows(folder, more):
        found = catalog.queries()[name](spark, folder)
        return sorted(tuple((r[c] + more + 2**63) % 2**64 - 2**63 if c in ids else r[c] for c in found.columns) for r in found.collect())

    want = rows(sf, by)
    assert len(want) > 1 and rows(shifted, 0) == want
