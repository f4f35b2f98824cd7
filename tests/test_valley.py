"""The valley of a histogram and percentiles by ranges against those of the values themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsignal.operators import cluster, rank, valley


@pytest.mark.parametrize("seed", range(4))
def test_valley_equals_that_of_all_scores(spark, seed):
    rng = np.random.default_rng(seed)
    s = np.round(np.clip(np.concatenate([rng.normal(0.5, 0.06, 300), rng.normal(0.93 - 0.02 * seed, 0.03, 120), rng.uniform(0, 1, 20)]), 0, 1), 4)
    df = spark.createDataFrame([(float(x),) for x in s] + [(None,)], "s double")
    got = valley.density_valley(df, F.col("s")).first()
    assert got["threshold"] == pytest.approx(cluster.density_valley(s), abs=1e-6)


def test_valley_of_too_little(spark):
    for rows in ([], [(0.5,)] * 10, [(0.5,)] * 50, [(0.99,)] * 50):
        got = valley.density_valley(spark.createDataFrame(rows, "s double"), F.col("s")).first()
        assert tuple(got) == (0.88, 0)


@pytest.mark.parametrize("parts", [4096, 3])
def test_percentiles_by_ranges_are_exact(spark, monkeypatch, parts):
    monkeypatch.setattr(rank, "PARTS", parts)
    rng = np.random.default_rng(parts)
    groups = {"a": rng.normal(size=300), "b": np.repeat([1.0, 2.0], [200, 3]), "c": np.array([5.0]), None: np.round(rng.uniform(-1e6, 1e6, 50)), "d": np.array([1e-300, 2e-300, 1.0])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("empty", None)]
    out = {r["g"]: list(r["p"]) for r in rank.exact_percentiles(spark.createDataFrame(rows, "g string, x double"), "g", "x", [0.0, 0.1, 0.5, 0.9, 1.0]).collect()}
    assert out.pop("empty") == [None] * 5 and set(out) == set(groups)
    for g, v in groups.items():
        assert out[g] == pytest.approx(np.quantile(v, [0.0, 0.1, 0.5, 0.9, 1.0]).tolist(), rel=1e-12)
