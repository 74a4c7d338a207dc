"""Option variants of operators that the registered queries exercise in one form only."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from protolens.functions import templates as TPL
from protolens.functions import text as TX
from protolens.functions import vec as V
from protolens.operators import contrast as CT
from protolens.operators import metrics as M
from protolens.operators import pooling as PO
from protolens.sources import readers as RD


def test_select_single_layer_and_pooling(spark):
    df = spark.createDataFrame([(0, "last"), (1, "last"), (2, "last"), (2, "mean")], "layer int, pooling string")
    assert [r.layer for r in RD.select_layers(df, only=2).collect()] == [2]
    assert sorted(r.layer for r in RD.select_layers(df).collect()) == [1, 2]
    assert RD.select_layers(df, pooling="mean").count() == 1


def test_last_k_variants(spark):
    rows = [(1, p, 1 if p < 3 else 0, [float(p), 10.0 * p]) for p in range(5)]
    df = spark.createDataFrame(rows, "example_id int, pos int, mask int, vector array<double>")
    last2 = PO.pool_last_k_mean(df, 2).first().vector
    assert np.allclose(last2, [1.5, 15.0])  # valid positions 0..2, last two are 1 and 2
    allm = PO.pool_last_k_mean(df, "all").first().vector
    assert np.allclose(allm, [1.0, 10.0])
    suf = PO.pool_last_k_mean(df.withColumn("slen", F.lit(1)), "suffix", suffix_len="slen").first().vector
    assert np.allclose(suf, [2.0, 20.0])
    assert np.allclose(PO.pool_last_token(df).first().vector, [2.0, 20.0])


def test_condition_flags_strict_and_grid(spark):
    s = spark.createDataFrame([(1, 1, 0.3), (2, 1, 0.2)], "example_id int, layer int, similarity double")
    grid = {r.example_id: r.condition_met for r in CT.condition_met(s, [1], 0.2, "larger").collect()}
    strict = {r.example_id: r.condition_met for r in CT.condition_met(s, [1], 0.2, "larger", strict=True).collect()}
    assert grid == {1: False, 2: True} and strict == {1: False, 2: False}
    smaller = {r.example_id: r.condition_met for r in CT.condition_met(s, [1], 0.2, "smaller").collect()}
    assert smaller == {1: True, 2: False}


def test_add_behavior_custom_combine(spark):
    rows = spark.createDataFrame([(1, 1, [1.0, 2.0]), (1, 2, [1.0, 2.0])], "example_id int, layer int, vector array<double>")
    beh = spark.createDataFrame([(2, [1.0, 1.0])], "layer int, direction array<double>")
    out = {r.layer: r.vector for r in CT.add_behavior(rows, beh, None, ["layer"], strength=2.0,
                                                      combine=lambda h, v: V.sub(h, v)).collect()}
    assert out == {1: [1.0, 2.0], 2: [-1.0, 0.0]}  # only the behaviour layer, with the custom operator


def test_threshold_predict_widths(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.3],), ([0.4, 0.6, 0.0],)], "p array<double>")
    got = [r.pred for r in df.select(M.threshold_predict(F.col("p"), width=3).alias("pred")).collect()]
    assert got == [1, 1]
    two = spark.createDataFrame([([0.4, 0.6],), ([0.5, 0.5],)], "p array<double>")
    got2 = [r.pred for r in two.select(M.threshold_predict(F.col("p"), width=2).alias("pred")).collect()]
    assert got2 == [1, 0]  # strictly greater than 0.5


def test_wrap_pair_keeps_first_message_only(spark):
    m = spark.createDataFrame([([("user", "zq1"), ("assistant", "zq2"), ("user", "again")],)],
                              "messages array<struct<role:string,content:string>>")
    w = m.select(TX.wrap_classification_prompt("messages", TPL.RESPONSE_CLASSIFICATION_TEMPLATE, False).alias("w")).first().w
    assert len(w) == 1 and "zq1" in w[0].content and "zq2" in w[0].content
    one = m.select(TX.wrap_classification_prompt("messages", TPL.CLASSIFICATION_TEMPLATE).alias("w")).first().w
    assert len(one) == 3 and one[0].content.count("zq1") == 1 and one[1].content == "zq2"


def test_template_slots_are_not_reinterpreted(spark):
    df = spark.createDataFrame([("{response} and {prompt}",)], "t string")
    out = df.select(TPL.fill("P:{prompt} R:{response}", prompt=F.col("t"), response=F.lit("x")).alias("o")).first().o
    assert out == "P:{response} and {prompt} R:x"


def test_one_row_class_gives_nan_not_an_error(spark):
    """A class with a single row has no covariance: NaN (as float arithmetic gives), the fit still completes."""
    import pandas as pd

    from protolens.operators import stats as S

    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"example_id": range(6), "layer": 1, "label": [0, 0, 0, 0, 0, 1],
                        "vector": list(rng.random((6, 3)))})
    fit = S.fit_gda(spark.createDataFrame(pdf), ["layer"], "label", per_class=True)
    one = fit["class_cov"].where("label = 1").collect()
    assert len(one) == 3 and all(np.isnan(v) for r in one for v in r.row)
    assert fit["params"].count() == 2  # the pooled fit is defined


def test_degenerate_texts_do_not_fail_the_job(spark):
    from protolens.functions import labels as L

    df = spark.createDataFrame([("no marker here", "two words", "[]")], "t string, q string, j string")
    ans, ok = L.gsm_answer(F.col("t"))
    r = df.select(ans.alias("a"), ok.alias("ok"), TX.render_task_template(F.col("q"), F.split("q", " ")).alias("p"),
                  L.top_scored_category(F.col("j")).alias("c")).first()
    assert r.a is None and r.ok is False and "A) two" in r.p and "D) " in r.p and r.c is None


def test_scale_conf_sizes_splits_and_batches():
    from protolens.session import scale_conf

    wide = scale_conf(100 * 2**40, vector_dim=4096, cores=8000)
    narrow = scale_conf(100 * 2**40, vector_dim=64, cores=8000)
    # the partial-Gram state of a split (2 x d^2 doubles) is at most 1/16 of the split
    assert int(wide["spark.sql.files.maxPartitionBytes"]) >= 16 * 2 * 4096 * 4096 * 8
    assert int(narrow["spark.sql.files.maxPartitionBytes"]) == 256 * 1024 * 1024
    assert int(wide["spark.sql.execution.arrow.maxRecordsPerBatch"]) * 4096 * 8 <= 64 * 1024 * 1024
    assert wide["spark.sql.adaptive.skewJoin.enabled"] == "true"


def _scored_pairs(spark, n=60):
    import numpy as np

    from protolens.operators import stats as S

    r = np.random.default_rng(0)
    rows = [(int(i % 40) if i else 2**60 + 1, int(layer), int(c), [float(v) for v in r.standard_normal(12) + c])
            for layer in (1, 2) for c in (0, 1) for i in range(n)]  # ids repeat
    df = spark.createDataFrame(rows, "example_id long, layer int, label int, vector array<double>").repartition(5)
    return df, S.fit_gda(df, ["layer"], "label", per_class=True)


def test_streamed_parameters_give_the_broadcast_scores(spark, monkeypatch):
    """Keys over the broadcast limit (here 1 byte): same scores, also for repeated ids and several salts."""
    import numpy as np

    from protolens.operators import blocks as B
    from protolens.operators import scoring as SC

    monkeypatch.setattr(B, "HELD_BYTES", 25 * 12 * 8)
    monkeypatch.setattr(B, "BLOCK_BYTES", 5 * 12 * 8)
    df, fit = _scored_pairs(spark)
    key = lambda x: (x.example_id, x.layer, x.label, tuple(x.vector))
    for score in (lambda b: SC.mahalanobis_sq(df, fit["means"], fit["precision"], ["layer"], out="s", max_broadcast_bytes=b),
                  lambda b: SC.mahalanobis_class_sq(df, fit["means"], fit["class_precision"], ["layer"], out="s", max_broadcast_bytes=b),
                  lambda b: SC.gda_logits(df, fit["params"], ["layer"], out="s", engine="arrow", max_broadcast_bytes=b),
                  lambda b: SC.nmc_neg_distance(df, fit["means"], ["layer"], out="s", engine="arrow", max_broadcast_bytes=b)):
        small, large = sorted(score(None).collect(), key=key), sorted(score(1).collect(), key=key)
        assert len(large) == 240 and [key(x) for x in small] == [key(x) for x in large]
        assert np.allclose([x.s for x in small], [x.s for x in large])


def test_gap_in_class_ids_raises(spark):
    from protolens.operators import scoring as SC

    df, fit = _scored_pairs(spark, 5)
    gap = lambda t: t.withColumn("label", F.col("label") * 2)
    for bad in (lambda: SC.gda_logits(df, gap(fit["params"]), ["layer"]), lambda: SC.nmc_pred(df, gap(fit["means"]), ["layer"]),
                lambda: SC.mahalanobis_sq(df, gap(fit["means"]), fit["precision"], ["layer"])):
        with pytest.raises(ValueError, match="without gaps"):
            bad()


def test_salt_spreads_a_hot_key(spark):
    from protolens.operators.params import attach_params, row_salt

    df, fit = _scored_pairs(spark)
    hot = df.where("layer = 1 and label = 0").select("layer", "label", "vector")
    salts = hot.select(row_salt(hot, ["layer", "label"], F.lit(16)).alias("s")).distinct().count()
    assert salts >= 8
    with pytest.raises(ValueError):
        row_salt(hot.select("layer", "label"), ["layer", "label"], F.lit(16))
    with pytest.raises(ValueError):
        attach_params(hot, fit["means"], ["layer", "label"], max_broadcast_bytes=1, salt_col="label")
