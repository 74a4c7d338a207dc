"""Invariants for the iterative fits (rows-only in the driver): stacking, baselines, k-means prototypes."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from protolens.operators import clustering as CL
from protolens.operators import meta as ME
from protolens.plans import q_meta
from protolens.plans.common import signal_split
from protolens.plans.flagship import features, fit_layers, layer_probabilities

from .conftest import SF_CHECK, SF_SMALL


@pytest.fixture(scope="module")
def feats(spark):
    tr, te = signal_split(spark, SF_CHECK)
    layers = [1, 2, 3]
    fit = fit_layers(tr)
    f, cols = features(layer_probabilities(tr, fit["params"]), layers)
    f = f.join(tr.select("example_id", "label").distinct(), "example_id")
    return tr, te, f, cols


def test_l1_strength_controls_sparsity(feats):
    _, _, f, cols = feats
    path = dict(ME.regularisation_path(f, cols, "label"))
    assert sorted(path) == sorted(ME.REGULARISATION_CS)
    nz = {c: int(np.sum(np.abs(m.coefficients.toArray()[:-1]) > 1e-5)) for c, m in path.items()}
    assert nz[0.0001] == 0  # an almost infinite penalty zeroes every layer
    assert nz[10] >= nz[0.0001]


def test_meta_predict_is_a_probability(spark, feats):
    _, _, f, cols = feats
    model = ME.meta_fit(f, cols, "label", 10.0)
    p = [r.s for r in ME.meta_predict(model, f, cols, "s").select("s").collect()]
    assert len(p) == f.count() and all(0.0 <= x <= 1.0 for x in p)


@pytest.mark.parametrize("fit_fn", [ME.supervised_lr, ME.supervised_rf])
def test_supervised_baselines_score_in_unit_interval(feats, fit_fn):
    tr, te, _, _ = feats
    model = fit_fn(tr.where("layer = 2"))
    s = [r.score for r in ME.predict_vectors(model, te.where("layer = 2")).select("score").collect()]
    assert len(s) > 0 and all(0.0 <= x <= 1.0 for x in s)


def test_forest_of_cached_node_ids_is_the_same_forest(spark):
    """Node ids kept with the rows spare the tasks the trees; splits and scores equal those of a forest without them."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, int(rng.integers(2)), rng.normal(size=4).tolist()) for i in range(120)], "example_id long, label int, vector array<double>").coalesce(1)
    model = ME.supervised_rf(df)
    assert model.getCacheNodeIds() and model.getNumTrees == 100 and model.getMaxDepth() == 30
    plain = RandomForestClassifier(numTrees=100, featureSubsetStrategy="sqrt", maxDepth=30, seed=42).fit(
        df.select(array_to_vector("vector").alias("features"), F.col("label").cast("double").alias("label")))
    a, b = ({r.example_id: r.score for r in ME.predict_vectors(m, df).select("example_id", "score").collect()} for m in (model, plain))
    assert a == b and len(a) == 120 and model.toDebugString.split("\n")[1:] == plain.toDebugString.split("\n")[1:]


def test_supervised_layers_are_scored_before_the_next_is_fitted(spark, monkeypatch):
    """One model at a time: no task holds the models of several layers."""
    steps, write = [], ME.materialize

    def fit(train):
        steps.append("fit")
        return ME.supervised_lr(train)

    def record(df):
        steps.append("written" if "score" in df.columns else "rows")
        return write(df)

    monkeypatch.setattr(ME, "materialize", record)
    assert q_meta._supervised(spark, SF_SMALL, fit, "lr").count() == 9
    assert steps == ["rows", "rows", *["fit", "written"] * 3]


def test_kmeans_prototypes_are_class_local(feats):
    tr, _, _, _ = feats
    p = CL.cluster_prototypes(tr, ["layer"], "label", n_clusters_per_class=2, iters=10)
    a = p["assigned"].select("label", "cluster_id").distinct().collect()
    assert all(r.cluster_id // 2 == r.label for r in a)  # ids offset by class
    # every example belongs to exactly one cluster of its own layer
    counts = p["assigned"].groupBy("layer", "example_id").count().agg(F.max("count")).first()[0]
    assert counts == 1
    n = p["means"].groupBy("layer").agg(F.sum("n").alias("n")).collect()
    assert {r.layer: r.n for r in n} == {r.layer: r["count"] for r in tr.groupBy("layer").count().collect()}


def test_l1_stack_is_stationary_with_a_penalised_intercept(feats):
    """Optimality of |w| + |b| + C sum log(1 + exp(-y (w x + b))), the objective of liblinear's L1 solver."""
    _, _, f, cols = feats
    rows = f.select(*[F.col(c).cast("double") for c in cols], F.col("label").cast("double")).toPandas().to_numpy()
    x, y = np.column_stack([rows[:, :-1], np.ones(len(rows))]), np.where(rows[:, -1] == 1, 1.0, -1.0)
    for C in (0.1, 1.0, 10.0):
        w = ME.meta_fit(f, cols, "label", C).coefficients.toArray()
        assert C < 1 or np.abs(w[:-1]).max() > 1  # the label is in the vectors: the stack is not empty
        g = -C * (x * (y / (1 + np.exp(y * (x @ w))))[:, None]).sum(0)
        on = np.abs(w) > 1e-6
        assert np.allclose(g[on], -np.sign(w[on]), atol=5e-3 * max(1.0, C * len(x) / 100)) and (np.abs(g[~on]) <= 1.05).all()


def test_stacks_of_row_and_feature_subsets_equal_single_fits(spark):
    """Problems fitted in the same passes: each equals its own fit on its rows and columns; rows with gaps take no part."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3)) * [1.0, 0.01, 5.0] + [0.5, 0.5, -2.0]
    y = (x @ [1.0, 80.0, -0.2] - 40.5 + rng.logistic(size=500) > 0).astype(int)
    rows = [(*map(float, v), int(t), int(i % 3)) for i, (v, t) in enumerate(zip(x, y))] + [(None, 1.0, 1.0, 1, 0), (1.0, float("nan"), 1.0, 0, 1)]
    df = spark.createDataFrame(rows, "a double, b double, c double, label int, part int")
    problems = [ME.Problem(2.0), ME.Problem(0.5, F.col("part") == 1), ME.Problem(5.0, F.col("part") != 0, ["b", "c"]), ME.Problem(1.0, F.lit(False))]
    many = ME.fit_stacks(df, ["a", "b", "c"], "label", problems)
    assert all(m.violation < 1e-6 for m in many)
    for m, q, keep in zip(many, problems, (range(500), [i for i in range(500) if i % 3 == 1], [i for i in range(500) if i % 3], [])):
        w = m.coefficients.toArray()
        z, t = np.column_stack([x, np.ones(500)])[keep], y[keep]
        g = q.C * z.T @ (1 / (1 + np.exp(-z @ w)) - t)
        for j, name in enumerate(["a", "b", "c", None]):
            if q.columns and name and name not in q.columns:
                assert w[j] == 0
            elif w[j]:
                assert abs(g[j] + np.sign(w[j])) < 1e-6
            else:
                assert abs(g[j]) <= 1 + 1e-6
    assert not many[3].coefficients.toArray().any()


def test_oversampled_start_finds_the_groups(spark):
    """Six clusters far apart, a class with fewer rows than clusters, and equal rows."""
    rng = np.random.default_rng(2)
    rows = [(i, 0, 0, (rng.normal(size=3) + 40 * np.eye(3)[i % 3] * (1 + i // 3 % 2)).tolist()) for i in range(240)]
    rows += [(1000, 0, 1, [1.0, 2.0, 3.0]), (1001, 0, 1, [9.0, 2.0, 3.0])] + [(2000 + i, 0, 2, [5.0, 5.0, 5.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "example_id long, layer int, label int, vector array<double>").repartition(4)
    centres, assigned = CL.grouped_kmeans(df, ["layer"], "label", k=6, start="oversampled")
    per = {r.label: r.n for r in centres.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert per[0] == 6 and per[1] <= 2 and per[2] == 1
    sizes = [r["count"] for r in assigned.where("label = 0").groupBy("cluster").count().collect()]
    assert sizes == [40] * 6 and assigned.count() == len(rows)


def test_broadcast_centres_give_the_clusters_of_joined_centres(spark):
    """Same centres and rows a cluster whether the centres fit the broadcast limit or not: a null label and a one-row class."""
    rng = np.random.default_rng(7)
    rows = [(i, i % 3, i % 2, rng.normal(size=5).tolist()) for i in range(900)]
    rows += [(5000, 0, None, [0.0] * 5), (5001, 7, 1, [1.0] * 5)]
    df = spark.createDataFrame(rows, "example_id long, layer int, label int, vector array<double>").repartition(5)

    def run():
        centres, assigned = CL.grouped_kmeans(df, ["layer"], "label", k=3)
        at = {(r.layer, r.label, r.cluster): r.center for r in centres.collect()}
        return at, {(r.example_id, r.layer): r.cluster for r in assigned.collect()}, centres.dtypes

    centres, clusters, kind = run()
    spark.conf.set("protolens.maxBroadcastBytes", "1")
    try:
        joined, same, kind_joined = run()
    finally:
        spark.conf.unset("protolens.maxBroadcastBytes")
    assert kind == kind_joined and clusters == same and len(clusters) == 901
    assert centres.keys() == joined.keys() and len(centres) == 19
    assert all(np.allclose(centres[k], joined[k], rtol=0, atol=1e-12) for k in centres)


def test_a_lloyd_round_is_one_job(spark, monkeypatch):
    """Rounds write no tables: what a fit writes does not grow with its rounds."""
    rng = np.random.default_rng(8)
    rows = [(i, 0, i % 2, rng.normal(size=3).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "example_id long, layer int, label int, vector array<double>")
    written, write = [], CL.materialize
    monkeypatch.setattr(CL, "materialize", lambda t: written.append(0) or write(t))
    counts = []
    for iters in (1, 4):
        written.clear()
        with pytest.warns(RuntimeWarning, match="still moved"):
            CL.grouped_kmeans(df, ["layer"], "label", k=2, iters=iters, tol=-1.0)
        counts.append(len(written))
    assert counts[0] == counts[1]


def test_nearest_centres_order_numbers_as_spark():
    """NaN above infinity, the first on ties."""
    nan, inf = float("nan"), float("inf")
    d = np.array([[nan, 1.0, nan, nan, 2.0], [inf, 1.0, nan, 0.0, 1.0], [nan, 0.5, nan, nan, 1.0]])
    assert CL._first_smallest(d).tolist() == [1, 2, 0, 1, 1]
