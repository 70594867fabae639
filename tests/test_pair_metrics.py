"""Colour errors by split and model, with totals: what is written, and the totals."""

import pytest
from pyspark.sql import functions as F

from scanloom.operators import vision
from scanloom.sources import adapters


def test_rows_are_written_once_a_model(spark, sf, monkeypatch):
    """Totals over splits and models are not written as rows of their own."""
    obs = adapters.table(spark, sf, "observations")
    plain, written = vision.checkpoint, []

    def counting(df):
        out = plain(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(vision, "checkpoint", counting)
    got = {(g["split"], g["model"]): g for g in vision.pair_metrics(obs, {"off": lambda o: o, "half": lambda o: o.withColumns({c: F.col(c) * 0.5 for c in "rgb"})}).collect()}
    n = got[None, None]["n"]
    assert len(got) == 12 and written == [n]
    for name in ("off", "half"):
        own = [got[s, name] for s in ("train", "validation", "test")]
        assert sum(g["n"] for g in own) == got[None, name]["n"] == n / 2
        assert got[None, name]["rmse"] == pytest.approx((sum(g["n"] * g["rmse"] ** 2 for g in own) / (n / 2)) ** 0.5)
        assert got[None, name]["delta_e"] == pytest.approx(sum(g["n"] * g["delta_e"] for g in own) / (n / 2))
