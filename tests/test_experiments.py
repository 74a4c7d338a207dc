"""Nested experiment grids: both ways to gather the matrices, against fits of each cell on its own rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from protolens.operators import experiments as X
from protolens.operators import stats as S
from protolens.operators.sampling import sample_per_class


@pytest.mark.parametrize("budget", [None, 1])
def test_cells_equal_single_fits(spark, monkeypatch, budget):
    if budget:
        monkeypatch.setattr(S, "GRAM_STATE_BUDGET_BYTES", budget)  # a scan a seed, one matrix at a time
    rng = np.random.default_rng(7)
    rows = [(i, x, i % 2, (rng.normal(size=5) + 20 + (i % 2)).tolist()) for i in range(90) for x in (1, 2)]
    df = spark.createDataFrame(rows, "example_id long, layer int, label int, vector array<double>").repartition(3)
    seeds, sizes = (0, 7), (5, 20, 1000)
    fit = X.fit_cells(df, X.cells_by_size(df.select("example_id", "label").distinct(), seeds, sizes), len(seeds), len(sizes))
    got = {(r.layer, r._seed, r._size, r.label): (r.w, r.b) for r in fit["params"].collect()}
    assert len(got) == 2 * 2 * 3 * 2
    n = {(r._size, r.n) for r in fit["means"].collect()}
    assert n == {(0, 5), (1, 20), (2, 45)}  # a size beyond the class takes all of it
    for s, seed in enumerate(seeds):
        for z, size in enumerate(sizes):
            one = sample_per_class(df, size, ["layer"], "label", "example_id", seed)
            for r in S.fit_gda(one, ["layer"], "label")["params"].collect():
                w, b = got[r.layer, s, z, r.label]
                assert np.allclose(w, r.w, atol=1e-8) and abs(b - r.b) < 1e-7
    scored = X.score_cells(df, fit, len(sizes), keep=["example_id"])
    assert scored.count() == 90 * 2 * 2 * 3 * 3
    assert scored.where((F.col("score") < 0) | (F.col("score") > 1) | F.col("score").isNull()).count() == 0


def test_wide_groups_one_matrix_at_a_time(spark):
    """Interleaved groups: each partition emits every group's matrix once."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i % 14, rng.normal(size=6).tolist()) for i in range(700)], "label int, vector array<double>").repartition(3)
    parts = S.gram_partials(df, ["label"], one_at_a_time=True)
    assert parts.groupBy(F.spark_partition_id().alias("p"), "label", "i").count().agg(F.max("count")).first()[0] == 1
    key = lambda r: (r.label, r.i)
    a, b = (sorted(S.merge_gram(p, ["label"]).collect(), key=key) for p in (parts, S.gram_partials(df, ["label"])))
    assert all(x.n == y.n and np.allclose(x.g, y.g) for x, y in zip(a, b))
