"""Parameter blocks: whitening, sums over blocks, and both ways to meet the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from protolens.operators import blocks as B
from protolens.operators import outliers as O
from protolens.operators import scoring as SC


def _model(spark, d, k, rng, matrix):
    mu = rng.normal(size=(k, d)) + 50.0
    mats = [matrix(d) for _ in range(k)]
    means = spark.createDataFrame([(1, c, m.tolist()) for c, m in enumerate(mu)], "layer int, label int, mean array<double>")
    prec = spark.createDataFrame([(1, c, i, r.tolist()) for c, p in enumerate(mats) for i, r in enumerate(p)],
                                 "layer int, label int, i int, row array<double>")
    return mu, mats, means, prec


@pytest.mark.parametrize("limit", [None, 1])
def test_any_symmetric_matrix_gives_its_quadratic_form(spark, monkeypatch, limit):
    rng = np.random.default_rng(4)

    def definite(d):
        a = rng.normal(size=(d, d))
        return a @ a.T + np.eye(d)

    def indefinite(d):
        a = rng.normal(size=(d, d))
        return a + a.T

    d, k = 24, 5
    monkeypatch.setattr(B, "BLOCK_BYTES", 7 * d * 8)  # several blocks a matrix
    monkeypatch.setattr(B, "HELD_BYTES", 20 * d * 8)
    x = rng.normal(size=(90, d)) + 50.0
    rows = spark.createDataFrame([(i, 1 if i % 9 else 2, v.tolist() if i % 10 else None) for i, v in enumerate(x)],
                                 "example_id int, layer int, vector array<double>")
    for matrix in (definite, indefinite):
        mu, mats, means, prec = _model(spark, d, k, rng, matrix)
        got = {r.example_id: r.s for r in SC.mahalanobis_class_sq(rows, means, prec, ["layer"], out="s", max_broadcast_bytes=limit,
                                                                  keep=["example_id"]).collect()}
        one = {r.example_id: r.s for r in SC.mahalanobis_sq(rows, means, prec.where("label = 0"), ["layer"], out="s",
                                                            max_broadcast_bytes=limit).collect()}
        assert sorted(got) == sorted(one) == [i for i in range(90) if i % 9]  # rows of a key without parameters go
        for i in got:
            if i % 10 == 0:
                assert got[i] is None and one[i] is None
                continue
            z = x[i] - mu
            assert np.allclose(got[i], [v @ p @ v for v, p in zip(z, mats)], rtol=1e-9, atol=1e-7)
            assert np.allclose(one[i], [v @ mats[0] @ v for v in z], rtol=1e-9, atol=1e-7)


def test_nan_matrix_gives_nan(spark):
    _, _, means, prec = _model(spark, 3, 2, np.random.default_rng(1), np.eye)
    prec = prec.withColumn("row", F.when(F.col("label") == 1, F.transform("row", lambda v: F.lit(float("nan")))).otherwise(F.col("row")))
    rows = spark.createDataFrame([(1, [50.0, 50.0, 50.0])], "layer int, vector array<float>")
    got = SC.mahalanobis_class_sq(rows, means, prec, ["layer"]).first().maha
    assert got[0] > 0 and np.isnan(got[1])
    assert SC.mahalanobis_class_sq(rows.limit(0), means, prec, ["layer"], max_broadcast_bytes=1).count() == 0
    assert SC.mahalanobis_class_sq(rows, means.limit(0), prec.limit(0), ["layer"]).count() == 0


def test_fourteen_wide_classes_stream_in_blocks(spark):
    """K = 14 matrices of width 512 (29 MB) past a limit of 4 MB equal the quadratic forms."""
    rng = np.random.default_rng(9)
    d, k = 512, 14
    mu = rng.normal(size=(k, d))
    low = [rng.normal(size=(d, 3)) for _ in range(k)]
    mats = [np.eye(d) * (c + 1) + u @ u.T for c, u in enumerate(low)]
    pdf = pd.DataFrame([{"layer": 0, "label": c, "i": i, "row": p[i]} for c, p in enumerate(mats) for i in range(d)])
    means = spark.createDataFrame([(0, c, m.tolist()) for c, m in enumerate(mu)], "layer long, label long, mean array<double>")
    x = rng.normal(size=(40, d))
    rows = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "example_id int, layer long, vector array<double>")
    got = SC.mahalanobis_class_sq(rows, means, spark.createDataFrame(pdf), ["layer"], max_broadcast_bytes=4 << 20, keep=["example_id"])
    for r in got.collect():
        z = x[r.example_id] - mu
        assert np.allclose(r.maha, [v @ p @ v for v, p in zip(z, mats)], rtol=1e-9)


def test_forests_of_any_size_and_empty_tables(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(i % 2), [float(v) for v in rng.normal(size=5)] if i else [9.0] * 5) for i in range(300)]
    df = spark.createDataFrame(rows, "example_id long, label int, vector array<double>")
    forests = O.fit_forests(df, ["label"], n_trees=20)
    key = lambda r: r.example_id
    a, b = (sorted(O.outlier_scores(df, forests, ["label"], max_broadcast_bytes=m).collect(), key=key) for m in (None, 1))
    assert a == b and len(a) == 300
    assert min(a, key=lambda r: r.outlier_score).example_id == 0 and not a[0].keep
    empty = df.limit(0)
    assert O.outlier_scores(empty, O.fit_forests(empty, ["label"], n_trees=2), ["label"]).count() == 0
    assert O.outlier_filter(df, ["label"], n_trees=20).columns == df.columns
