"""Invariants and brute-force checks (test strategy of SURVEY section 5)."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from protolens.functions import vec as V
from protolens.operators import contrast as CT
from protolens.operators import metrics as M
from protolens.operators import outliers as O
from protolens.operators import sampling as SP
from protolens.operators import stats as S
from protolens.plans.common import train_test
from protolens.session import scratch_path
from protolens.streaming.scoring import score_stream

from .conftest import SF_CHECK


def _brute_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    total = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return total / (len(pos) * len(neg))


def _brute_ap(scores, labels):
    order = sorted(set(scores), reverse=True)
    p_total = sum(labels)
    ap, prev_r = 0.0, 0.0
    for t in order:
        sel = [y for s, y in zip(scores, labels) if s >= t]
        tp = sum(sel)
        r = tp / p_total
        ap += (r - prev_r) * (tp / len(sel))
        prev_r = r
    return ap


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_auc_ap_match_brute_force_with_ties(spark, buckets):
    rng = np.random.default_rng(7)
    n = 400
    scores = np.round(rng.random(n), 2).tolist()  # many ties
    labels = (rng.random(n) < 0.4).astype(int).tolist()
    groups = ["a" if i % 3 else "b" for i in range(n)]
    df = spark.createDataFrame(pd.DataFrame({"g": groups, "score": scores, "label": labels}))
    auc = {r.g: r.roc_auc for r in M.roc_auc(df, ["g"], buckets=buckets).collect()}
    ap = {r.g: r.average_precision for r in M.average_precision(df, ["g"], buckets=buckets).collect()}
    for g in ("a", "b"):
        s = [x for x, gg in zip(scores, groups) if gg == g]
        y = [x for x, gg in zip(labels, groups) if gg == g]
        assert abs(auc[g] - _brute_auc(s, y)) < 1e-12
        assert abs(ap[g] - _brute_ap(s, y)) < 1e-12


def test_auc_of_negated_scores_and_single_class(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": "x", "score": rng.random(200), "label": (rng.random(200) < 0.5).astype(int)})
    df = spark.createDataFrame(pdf)
    a = M.roc_auc(df, ["g"]).first().roc_auc
    b = M.roc_auc(df.withColumn("score", -F.col("score")), ["g"]).first().roc_auc
    assert abs(a + b - 1.0) < 1e-12
    one = M.binary_scores(df.withColumn("label", F.lit(1)), ["g"]).first()
    assert one.roc_auc is None and one.average_precision is None


def test_rank_cut_exact_under_a_hot_key(spark):
    """One class holds most rows; the bucketed cut equals a full per-class ranking."""
    n = 30000
    ids = np.arange(n)
    label = np.where(ids % 10 == 0, 1, 0)  # class 0 holds 90%
    df = spark.createDataFrame(pd.DataFrame({"example_id": ids, "label": label}))
    got = SP.sample_per_class(df, 500, [], "label", "example_id", 11, rank_col="rank")
    got = {(r.label, r.example_id): r.rank for r in got.collect()}
    import hashlib

    exp = {}
    for lab in (0, 1):
        members = sorted((hashlib.md5(f"{i}:11".encode()).hexdigest(), i) for i in ids[label == lab])
        for rank, (_, i) in enumerate(members[:500], 1):
            exp[(lab, int(i))] = rank
    assert got == exp


def test_rank_cut_multi_digit_buckets(spark):
    n = 5000
    df = spark.createDataFrame(pd.DataFrame({"example_id": np.arange(n), "g": 0}))
    h = df.withColumn("_h", SP.hash_order("example_id", 5))
    a = SP.rank_cut(h, ["g"], "_h", "example_id", 1234, "rank", digits=3)
    b = SP.rank_cut(h, ["g"], "_h", "example_id", 1234, "rank", digits=1)
    key = lambda r: r.example_id
    assert sorted((r.example_id, r.rank) for r in a.collect()) == sorted((r.example_id, r.rank) for r in b.collect())
    assert a.count() == 1234


def test_rule_parsing_semantics(spark):
    rules = ["if C1 or C2 then B1", "if C1 and C3 then B2", "if C2 then B1", "if c9 then B1", "C1 B1", "if C1 and C2 or C3 then B2"]
    t = {r.rule_idx: r for r in CT.parse_rules(spark, rules).collect()}
    assert (t[0].mode, t[0].conditions, t[0].behavior_idx) == ("any", [0, 1], 0)
    assert (t[1].mode, t[1].conditions, t[1].behavior_idx) == ("all", [0, 2], 1)
    assert (t[2].mode, t[2].conditions) == ("any", [1])
    assert t[4].mode == "never"
    assert t[5].mode == "any"  # any 'or' makes the whole rule an OR
    flags = spark.createDataFrame([(1, [True, False, False]), (2, [False, False, True])], "example_id int, flags array<boolean>")
    ev = {(r.example_id, r.rule_idx): r.satisfied for r in CT.evaluate_rules(flags, CT.parse_rules(spark, rules)).collect()}
    assert ev[(1, 0)] and not ev[(1, 1)] and not ev[(1, 3)] and ev[(2, 5)] and not ev[(2, 0)]


def test_norm_preserving_rescale_keeps_norms(spark):
    before = spark.createDataFrame([(1, 0, [3.0, 4.0]), (1, 1, [1.0, 0.0]), (2, 0, [1.0, 1.0])],
                                   "example_id int, pos int, vector array<double>")
    after = before.withColumn("vector", F.when(F.col("example_id") == 1, V.add("vector", F.array(F.lit(1.0), F.lit(1.0))))
                              .otherwise(V.scale("vector", 0.5)))
    out = {(r.example_id, r.pos): r.vector for r in CT.norm_preserving_rescale(before, after, ["example_id"], "pos").collect()}
    assert abs(np.linalg.norm(out[(1, 0)]) - 5.0) < 1e-12 and abs(np.linalg.norm(out[(1, 1)]) - 1.0) < 1e-12
    assert out[(2, 0)] == [0.5, 0.5]  # norms shrank: no rescale


def test_isolation_forest_flags_far_points(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    x[:5] += 25.0
    pdf = pd.DataFrame({"example_id": np.arange(600), "label": 0, "vector": list(x)})
    df = spark.createDataFrame(pdf)
    s = O.outlier_scores(df, O.fit_forests(df, ["label"], n_trees=50), ["label"]).toPandas()
    far = s[s.example_id < 5]
    assert (~far.keep).all()
    assert s.keep.mean() > 0.9


@pytest.mark.parametrize("limit", [1 << 20, 1])
def test_stream_scoring_equals_batch(spark, limit):
    tr, te = train_test(spark, SF_CHECK)
    fit = S.fit_gda(tr, ["layer"], "label")
    path = scratch_path(spark, "stream_in")
    te.write.mode("overwrite").parquet(path)
    stream = spark.readStream.schema(te.schema).option("maxFilesPerTrigger", 2).parquet(path)
    q = score_stream(stream, fit["params"], max_broadcast_bytes=limit).select("example_id", "layer", "pred", "score") \
        .writeStream.format("memory").queryName(f"scored_stream_{limit}").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.example_id, r.layer): (r.pred, round(r.score, 9)) for r in spark.sql(f"SELECT * FROM scored_stream_{limit}").collect()}
    from protolens.operators import scoring as SC

    b = SC.argmax_class(SC.softmax_probs(SC.gda_logits(te, fit["params"], ["layer"])), "probs", "pred")
    exp = {(r.example_id, r.layer): (r.pred, round(r.probs[1], 9)) for r in b.collect()}
    assert got == exp and len(got) > 0


def test_sample_per_class_strict_raises(spark):
    df = spark.createDataFrame(pd.DataFrame({"example_id": np.arange(50), "label": [0] * 45 + [1] * 5}))
    assert SP.sample_per_class(df, 10, [], "label").count() == 15
    with pytest.raises(ValueError):
        SP.sample_per_class(df, 10, [], "label", strict=True)


def test_flagship_with_logits(spark):
    from protolens.plans import flagship

    rows = flagship.multilayer_report(spark, "/root/testdata/sf0.001", use_logits=True).collect()
    assert len(rows) > 0 and all(r.negative_support + r.positive_support > 0 for r in rows)


def test_evaluate_from_reference_layout_matches_flagship(spark):
    """Vector fixture written as per-layer files (train) and per-benchmark folders; same records as the flagship."""
    from protolens.plans import flagship
    from protolens.sources.fixtures import signal_vectors

    v = signal_vectors(spark, SF_CHECK)  # the flagship's fixture, layer 0 included

    def write(df, path, by):
        out = df.select(*by, F.concat(F.lit("layer_"), F.col("layer").cast("string"),
                                      F.lit("_hidden_states.parquet")).alias("layer_file"),
                        "example_id", F.col("label").cast("float").alias("labels"),
                        F.transform("vector", lambda x: x.cast("float")).alias("hidden_state"))
        # one file per layer (and benchmark), rows in example order: the reference's positional layout
        out.repartition(*by, "layer_file").sortWithinPartitions("example_id").drop("example_id") \
            .write.mode("overwrite").partitionBy(*by, "layer_file").parquet(path)

    train_dir, bench_root = scratch_path(spark, "train_layers"), scratch_path(spark, "bench_layers")
    write(v.where("split = 'train'"), train_dir, [])
    write(v.where("split = 'test'"), bench_root, ["dataset_type", "dataset"])
    out_dir = scratch_path(spark, "eval_out")
    got = {(r.dataset, r.method): r for r in flagship.evaluate_files(spark, train_dir, bench_root, out_dir).collect()}
    exp = {(r.dataset, r.method): r for r in flagship.multilayer_report(spark, SF_CHECK).collect()}
    assert got.keys() == exp.keys() and len(got) > 0
    for k in exp:
        for c in ("accuracy", "f1", "roc_auc", "average_precision", "positive_support"):
            assert got[k][c] == exp[k][c], (k, c)
    assert spark.read.parquet(f"{out_dir}/predictions").count() > 0


def test_condition_search_plan(spark):
    from protolens.plans.common import layer_vectors
    from protolens.plans.condition import condition_search

    v = layer_vectors(spark, SF_CHECK).select("example_id", "layer", "label", "vector")
    out = condition_search(v, [1, 2, 3], max_layers=2)
    best = out["best"].first()
    assert best is not None and 0 < best.f1 <= 1 and best.direction in ("larger", "smaller")
    g = out["grid"]
    assert g.agg(F.max("f1")).first()[0] == best.f1
    assert out["predictions"].count() == v.select("example_id").distinct().count()
    d = out["directions"].collect()
    assert len(d) == 3 and all(abs(np.linalg.norm(r.direction) - 1) < 1e-9 for r in d)


def test_combo_prototypes_plan(spark):
    from protolens.plans.combos import combo_prototype_scores

    tr, te = train_test(spark, SF_CHECK)
    rec = combo_prototype_scores(tr, te).collect()
    combos = {r.combo for r in rec}
    assert combos == {"ds0", "ds1", "ds2", "ds0+ds1", "ds0+ds2", "ds1+ds2", "ds0+ds1+ds2"}
    assert len(rec) == 7 * 3 * 3  # combos x layers x benchmarks
    assert all(0 <= r.accuracy <= 1 for r in rec)


def test_training_sample_is_shared_by_all_layers(spark):
    from protolens.plans.flagship import sample_training_ids

    tr, _ = train_test(spark, SF_CHECK)
    s = sample_training_ids(tr, num_samples_per_class=50, num_frac_data=0.9)
    per_layer = {r.layer: set() for r in s.select("layer").distinct().collect()}
    for r in s.select("layer", "example_id").collect():
        per_layer[r.layer].add(r.example_id)
    sets = list(per_layer.values())
    assert len(sets) == 3 and all(x == sets[0] for x in sets) and len(sets[0]) == 100


def test_isolation_forest_chunked_broadcast_equal(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    pdf = pd.DataFrame({"example_id": np.arange(400), "label": np.arange(400) % 4, "vector": list(x)})
    df = spark.createDataFrame(pdf)
    forests = O.fit_forests(df, ["label"], n_trees=20)
    a = {r.example_id: r.outlier_score for r in O.outlier_scores(df, forests, ["label"]).collect()}
    b = {r.example_id: r.outlier_score for r in O.outlier_scores(df, forests, ["label"], max_broadcast_bytes=60000).collect()}
    assert a.keys() == b.keys() and len(a) == 400
    assert all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_prefix_sums_ranges_and_batches(spark):
    """Many ranges, tiny Arrow batches (sums carried across batches), one hot group: equal to pandas cumsum."""
    rng = np.random.default_rng(9)
    n = 3000
    g = np.where(rng.random(n) < 0.8, "hot", rng.choice(["a", "b", "c"], n))
    pdf = pd.DataFrame({"g": g, "score": rng.permutation(n).astype(float), "pos": rng.integers(0, 3, n)})
    df = spark.createDataFrame(pdf)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = M.prefix_sums(df, ["g"], "score", ["pos"], buckets=13).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    exp = pdf.sort_values(["g", "score"]).assign(pos_cum=lambda t: t.groupby("g")["pos"].cumsum())
    m = exp.merge(got, on=["g", "score"], suffixes=("", "_got"))
    assert len(m) == n and (m.pos_cum == m.pos_cum_got).all()
    desc = M.prefix_sums(df, ["g"], "score", ["pos"], buckets=5, descending=True).toPandas()
    exp_d = pdf.sort_values(["g", "score"], ascending=[True, False]).assign(c=lambda t: t.groupby("g")["pos"].cumsum())
    md = exp_d.merge(desc, on=["g", "score"])
    assert (md.c == md.pos_cum).all()


def test_scan_reference_style_score_files(spark):
    """Pretty-printed scores.json files (flat and nested) in model/.../type/dataset folders."""
    import json
    import os

    from protolens.sources import readers as RD

    root = scratch_path(spark, "scores_tree").replace("file:", "")
    flat = {("m1", "harmful", "a"): {"f1": 0.5, "accuracy": 0.75}, ("m2", "non_harmful", "b"): {"f1": 0.25, "accuracy": 1}}
    for (m, t, d), rec in flat.items():
        os.makedirs(os.path.join(root, "flat", m, "3_datasets", t, d))
        with open(os.path.join(root, "flat", m, "3_datasets", t, d, "scores.json"), "w") as f:
            json.dump(rec, f, indent=4)
    os.makedirs(os.path.join(root, "nested", "harmful", "a"))
    with open(os.path.join(root, "nested", "harmful", "a", "scores.json"), "w") as f:
        json.dump({"gda": {"f1": 0.1, "positive_support": 3}, "nmc": {"f1": 0.2}}, f, indent=4)
    levels = ("model", "num_datasets", "dataset_type", "dataset")
    got = {(r.model, r.num_datasets, r.dataset_type, r.dataset, r.metric): r.value
           for r in RD.scan_result_scores(spark, os.path.join(root, "flat"), levels).collect()}
    assert got == {(m, "3_datasets", t, d, k): float(v) for (m, t, d), rec in flat.items() for k, v in rec.items()}
    nested = {(r.method, r.metric): r.value for r in
              RD.scan_result_scores(spark, os.path.join(root, "nested"), ("dataset_type", "dataset"), nested=True).collect()}
    assert nested == {("gda", "f1"): 0.1, ("gda", "positive_support"): 3.0, ("nmc", "f1"): 0.2}


def test_rank_cut_and_prefix_sums_without_broadcast(spark):
    """Above the broadcast limit the bucket / range tables go through plain shuffle joins, same results."""
    df = spark.createDataFrame(pd.DataFrame({"example_id": np.arange(3000), "label": np.arange(3000) % 3}))
    a = sorted(tuple(r) for r in SP.sample_per_class(df, 50, [], "label", rank_col="rank").collect())
    spark.conf.set("protolens.maxBroadcastBytes", "0")
    try:
        b = sorted(tuple(r) for r in SP.sample_per_class(df, 50, [], "label", rank_col="rank").collect())
        s = M.prefix_sums(df.withColumn("one", F.lit(1)), ["label"], "example_id", ["one"], buckets=4)
        assert all(r.one_cum == r.example_id // 3 + 1 for r in s.collect())
    finally:
        spark.conf.unset("protolens.maxBroadcastBytes")
    assert a == b and len(a) == 150


def test_worked_direction_example(spark):
    """Three pairs whose difference is the same vector: first component along (1, 1, 1), oriented so that
    positives project above negatives."""
    pos = [[0.1, 0.2, 0.3], [0.2, 0.3, 0.4], [0.2, 0.3, 0.4]]
    neg = [[0.4, 0.5, 0.6], [0.5, 0.6, 0.7], [0.5, 0.6, 0.7]]
    rows = [(1, r + 1, p, n) for r, (p, n) in enumerate(zip(pos, neg))]
    pairs = spark.createDataFrame(rows, "layer int, rank int, pos array<double>, neg array<double>")
    d = CT.read_directions(pairs, ["layer"], "pca_pairwise").first()
    v = np.array(d.direction)
    assert np.allclose(np.abs(v), np.full(3, 1 / np.sqrt(3)), atol=1e-9) and abs(d.evr - 1.0) < 1e-9
    # positives are smaller along +(1,1,1), so the oriented direction points to -(1,1,1)
    assert all(np.dot(p, v) > np.dot(n, v) for p, n in zip(pos, neg))


def test_combo_multilayer_stack_plan(spark):
    from protolens.plans.combos import combo_multilayer_stack

    tr, te = train_test(spark, SF_CHECK)
    rec = combo_multilayer_stack(tr, te).collect()
    assert {r.combo for r in rec} == {"ds0", "ds1", "ds2", "ds0+ds1", "ds0+ds2", "ds1+ds2", "ds0+ds1+ds2"}
    assert len(rec) == 7 * 3 and all(r.positive_support + r.negative_support > 0 for r in rec)


def test_sample_fraction_rounds_half_to_even(spark):
    # 5 rows per group, frac 0.5 -> 2.5 -> 2 rows (Python round), globally 15 * 0.5 = 7.5 -> 8
    df = spark.createDataFrame(pd.DataFrame({"example_id": np.arange(15), "g": np.arange(15) % 3}))
    per = SP.sample_fraction(df, 0.5, "example_id", 1, keys=["g"]).groupBy("g").count().collect()
    assert {r["count"] for r in per} == {round(2.5)}
    assert SP.sample_fraction(df, 0.5, "example_id", 1).count() == round(7.5)


def test_category_steps_plan(spark):
    from protolens.plans.categories import category_steps_report

    tr, te = train_test(spark, SF_CHECK)
    rec = category_steps_report(tr, te, max_step=3).collect()
    assert {r.step for r in rec} == {1, 2, 3} and {r.method for r in rec} == {"gda", "nmc", "mahalanobis"}
    assert len(rec) == 3 * 3 * 3 * 3  # steps x layers x methods x datasets
    # GDA and Mahalanobis with a shared precision and uniform prior give the same argmax
    by = {(r.step, r.layer, r.method, r.dataset): r for r in rec}
    for (step, layer, method, ds), r in by.items():
        if method == "gda":
            assert r.accuracy == by[(step, layer, "mahalanobis", ds)].accuracy


def test_outliers_leave_before_the_fit(spark):
    """Rows far away change the prototypes; with outlier removal the records are those of a fit without them."""
    from protolens.operators.outliers import outlier_filter
    from protolens.plans.combos import combo_prototype_scores
    from protolens.plans.common import train_test

    tr, te = train_test(spark, SF_CHECK)
    tr = tr.where("layer = 1").withColumn("vector", F.when(F.col("example_id") % 97 == 1, F.transform("vector", lambda x: x + 8.0)).otherwise(F.col("vector")))
    te, key = te.where("layer = 1"), lambda r: (r.combo, r.dataset)
    kept = outlier_filter(tr, ["layer", "dataset", "label"])
    assert 0 < kept.count() < tr.count() and kept.where("example_id % 97 = 1").count() == 0
    a = sorted(combo_prototype_scores(tr, te, remove_outliers=True).collect(), key=key)
    b = sorted(combo_prototype_scores(kept, te).collect(), key=key)
    assert len(a) == 21 and [key(r) for r in a] == [key(r) for r in b]
    assert all(x.f1 == y.f1 and abs(x.roc_auc - y.roc_auc) < 1e-9 for x, y in zip(a, b))
