"""Forests whose trees stay in tables: the same trees as MLlib's where nothing is drawn, one forest however it is dealt out."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from protolens.operators import forest as FO
from protolens.operators import meta as ME
from protolens.plans import q_meta

from .conftest import SF_SMALL

LIMITS = ("protolens.maxDriverNodes", "protolens.forestTaskBytes")


@pytest.fixture
def limits(spark):
    """Sets the rows times trees that the driver may hold, and the bytes a task may."""
    def put(*values):
        for name, v in zip(LIMITS, values):
            spark.conf.set(name, str(v))

    yield put
    for name in LIMITS:
        spark.conf.unset(name)


def frame(spark, x, y, parts=3):
    rows = [(i, int(c), v.tolist()) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "example_id long, label int, vector array<double>").repartition(parts)


def scores(model, df):
    return {r.example_id: r.score for r in ME.predict_vectors(model, df).select("example_id", "score").collect()}


@pytest.mark.parametrize("classes", [2, 3])
def test_a_tree_of_all_rows_and_features_is_mllibs_tree(spark, classes):
    rng = np.random.default_rng(classes)
    x, y = rng.integers(0, 20, (400, 3)).astype(float), rng.integers(0, classes, 400)
    df = frame(spark, x, y, 1)
    plain = DecisionTreeClassifier(maxDepth=30).fit(df.select(array_to_vector("vector").alias("features"), F.col("label").cast("double")))
    thresholds = FO.find_thresholds(df, "vector")
    nodes = FO.grow(FO.binned(x, thresholds), y, np.ones(400), classes, 0, 1, 42, 3)
    other = rng.uniform(-1, 21, (300, 3))
    pos = FO.route(FO.binned(other, thresholds), nodes.feature, nodes.bin, nodes.child)
    share = nodes.counts / nodes.counts.sum(1, keepdims=True)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(other)], "example_id long, vector array<double>")
    want = scores(plain, asked)
    assert plain.numNodes == len(nodes.feature) > 200
    assert [want[i] for i in range(300)] == share[nodes.child[pos], 1].tolist()


def test_a_forest_past_the_drivers_limit_stays_in_tables(spark, limits):
    """As good as MLlib's on rows not seen; every row is scored once and keeps its columns."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2400, 6))
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] + 0.3 * rng.normal(size=2400) > 0).astype(int)
    train, test = frame(spark, x[:1600], y[:1600]), frame(spark, x[1600:], y[1600:]).withColumn("kept", F.col("example_id") % 7)
    small = ME.supervised_rf(train)
    limits(159_999)
    large = ME.supervised_rf(train)
    assert isinstance(small, RandomForestClassificationModel) and isinstance(large, FO.Forest)
    got = ME.predict_vectors(large, test)
    assert got.columns == [*test.columns, "score"] and got.where("kept = example_id % 7").count() == 800
    a, b = scores(small, test), scores(large, test)
    assert a.keys() == b.keys() and all(0.0 <= s <= 1.0 for s in b.values())
    right = [np.mean([(s[i] > 0.5) == y[1600 + i] for i in range(800)]) for s in (a, b)]
    assert min(right) > 0.8 and abs(right[0] - right[1]) < 0.04
    assert np.corrcoef([a[i] for i in range(800)], [b[i] for i in range(800)])[0, 1] > 0.97
    assert large.pieces.count() == 100 and all(len(t.feature) == 1 for t in large.tops)
    nodes = large.pieces.agg(F.sum("nodes")).first()[0]
    assert abs(nodes / small.totalNumNodes - 1) < 0.1


def test_the_forest_is_the_same_however_nodes_are_dealt_out(spark, limits, monkeypatch):
    """Nodes split by all tasks together, or by one task: the same draws, splits and merged leaves; a class hard to tell apart and one easy."""
    monkeypatch.setattr(ME, "TREES", 8)
    rng = np.random.default_rng(4)
    x = np.where(rng.random((700, 5)) < 0.5, rng.integers(0, 4, (700, 5)), rng.normal(size=(700, 5)))
    y = (x[:, 0] > 1).astype(int) ^ (rng.random(700) < 0.1 * (x[:, 1] > 0))
    df = frame(spark, x, y)
    found = []
    for held in (1 << 20, 7 * 20):
        limits(0, held)
        model = ME.supervised_rf(df)
        found.append(scores(model, df))
    assert len(found[0]) == 700 and found[0] == found[1]
    assert max(len(t.feature) for t in model.tops) > 20


def test_trees_without_rows_have_no_vote(spark, limits):
    limits(0)
    df = frame(spark, np.array([[0.0], [1.0]]), [0, 1])
    got = scores(ME.supervised_rf(df), df)
    assert got[0] < 0.5 < got[1]


def test_forests_in_tables_refuse_what_mllib_refuses(spark, limits):
    limits(0)
    for rows in ([(0, [1.0]), (1, [float("nan")])], [(0, [1.0]), (None, [2.0])], [(0, [1.0]), (1, None)], [(0, [1.0]), (-1, [2.0])]):
        with pytest.raises(ValueError, match="a forest needs"):
            ME.supervised_rf(spark.createDataFrame(rows, "label int, vector array<double>"))


def test_supervised_rf_past_the_drivers_limit(spark, limits):
    """Same records, over the same rows, as those of a fit that holds its model in the driver."""
    def records(fit):
        got = q_meta._supervised(spark, SF_SMALL, fit, "rf").collect()
        return {(r.layer, r.dataset, r.method): [r[c] for c in q_meta.RECORD_COLS if "support" in c] for r in got}

    limits(0)
    after = records(ME.supervised_rf)
    assert len(after) == 9 and all(after.values()) and after == records(ME.supervised_lr)
