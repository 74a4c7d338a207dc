"""Registered queries: classification metrics (M1-M15) on nearest-mean scores of test rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protolens.operators import metrics as M
from protolens.operators import scoring as SC
from protolens.operators import stats as S
from protolens.plans.catalog import register
from protolens.plans.common import rnd, train_test
from protolens.plans.sqlparts import DISTANCE, gda_ctes, nmc_ctes, vec_base

KEYS = ["layer", "dataset"]


def scored(spark: SparkSession, sf: str, label: str = "label") -> DataFrame:
    tr, te = train_test(spark, sf)
    means = S.class_means(tr, ["layer"], label)
    s = SC.nmc_pred(te, means, ["layer"], label)
    return s.withColumn("score", F.element_at("probs", 2))


def _binary(spark, sf) -> DataFrame:
    s = scored(spark, sf)
    return s.withColumn("pred", M.threshold_predict(F.col("score")))


CONFUSION_SQL = """,
bp AS (SELECT *, CAST(score > 0.5 AS INTEGER) AS bpred FROM preds),
cf AS (SELECT layer, dataset,
              CAST(sum(CASE WHEN label = 0 AND bpred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
              CAST(sum(CASE WHEN label = 0 AND bpred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
              CAST(sum(CASE WHEN label = 1 AND bpred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
              CAST(sum(CASE WHEN label = 1 AND bpred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
              avg(CAST(bpred = label AS DOUBLE)) AS accuracy
       FROM bp GROUP BY layer, dataset)"""
_CONF = nmc_ctes() + CONFUSION_SQL

M1_SQL = vec_base(nmc_ctes() + """
SELECT example_id, layer, CAST(score > 0.5 AS INTEGER) AS pred FROM preds""")


@register("threshold_predict", M1_SQL)
def q_threshold_predict(spark, sf):
    return _binary(spark, sf).select("example_id", "layer", "pred")


M2_SQL = vec_base(_CONF + """
SELECT layer, dataset, tn, fp, fn, tp FROM cf""")


def _conf(spark, sf):
    return M.counting_metrics(M.confusion_counts(_binary(spark, sf), KEYS, "pred", "label"))


@register("confusion_counts", M2_SQL)
def q_confusion_counts(spark, sf):
    return _conf(spark, sf).select(*KEYS, "tn", "fp", "fn", "tp")


M3_SQL = vec_base(_CONF + """
SELECT layer, dataset, round(accuracy, 6) AS accuracy FROM cf""")


@register("accuracy", M3_SQL)
def q_accuracy(spark, sf):
    return _conf(spark, sf).select(*KEYS, rnd("accuracy").alias("accuracy"))


M4_SQL = vec_base(_CONF + """
SELECT layer, dataset, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM cf""")


@register("f1_binary", M4_SQL)
def q_f1_binary(spark, sf):
    return _conf(spark, sf).select(*KEYS, rnd("f1").alias("f1"))


M5_SQL = vec_base(_CONF + """
SELECT layer, dataset, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS true_positive_rate,
       round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 6) AS true_negative_rate FROM cf""")


@register("tpr_tnr", M5_SQL)
def q_tpr_tnr(spark, sf):
    c = _conf(spark, sf)
    return c.select(*KEYS, rnd("true_positive_rate").alias("true_positive_rate"),
                    rnd("true_negative_rate").alias("true_negative_rate"))


M6_SQL = vec_base(_CONF + """
SELECT layer, dataset, tn + fp AS negative_support, tp + fn AS positive_support FROM cf""")


@register("supports", M6_SQL)
def q_supports(spark, sf):
    return _conf(spark, sf).select(*KEYS, "negative_support", "positive_support")


RANK_SQL = _RANK = """,
st AS (SELECT layer, dataset, score, sum(label) AS pos, sum(1 - label) AS neg FROM preds GROUP BY ALL),
cu AS (SELECT *, sum(neg) OVER (PARTITION BY layer, dataset ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb,
              sum(pos) OVER (PARTITION BY layer, dataset ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tpc,
              sum(pos + neg) OVER (PARTITION BY layer, dataset ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS allc
       FROM st),
rk AS (SELECT layer, dataset,
              CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (coalesce(nb, 0) + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS roc_auc,
              CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * tpc / allc) / sum(pos) END AS average_precision
       FROM cu GROUP BY layer, dataset)"""

M7_SQL = vec_base(nmc_ctes() + _RANK + """
SELECT layer, dataset, round(roc_auc, 6) AS roc_auc FROM rk""")


@register("roc_auc", M7_SQL)
def q_roc_auc(spark, sf):
    a = M.roc_auc(scored(spark, sf), KEYS, "score", "label")
    return a.select(*KEYS, rnd("roc_auc").alias("roc_auc"))


M8_SQL = vec_base(nmc_ctes() + _RANK + """
SELECT layer, dataset, round(average_precision, 6) AS average_precision FROM rk""")


@register("average_precision", M8_SQL)
def q_average_precision(spark, sf):
    a = M.average_precision(scored(spark, sf), KEYS, "score", "label")
    return a.select(*KEYS, rnd("average_precision").alias("average_precision"))


M9_SQL = vec_base(nmc_ctes(label="category") + """,
t AS (SELECT layer, dataset, category AS cls, count(*) AS nt FROM preds GROUP BY ALL),
p AS (SELECT layer, dataset, pred AS cls, count(*) AS np FROM preds GROUP BY ALL),
tp AS (SELECT layer, dataset, category AS cls, count(*) AS ntp FROM preds WHERE pred = category GROUP BY ALL),
u AS (SELECT layer, dataset, cls, coalesce(nt, 0) AS nt, coalesce(np, 0) AS np FROM t FULL JOIN p USING (layer, dataset, cls))
SELECT layer, dataset, round(avg(CASE WHEN nt + np > 0 THEN 2.0 * coalesce(ntp, 0) / (nt + np) ELSE 0 END), 6) AS macro_f1
FROM u LEFT JOIN tp USING (layer, dataset, cls) GROUP BY layer, dataset""")


@register("macro_f1", M9_SQL)
def q_macro_f1(spark, sf):
    s = scored(spark, sf, "category")
    return M.macro_f1(s, KEYS, "pred", "category").select(*KEYS, rnd("macro_f1").alias("macro_f1"))


_OVR = nmc_ctes(label="category") + """,
o AS (SELECT layer, dataset, cls, prob AS score, CAST(category = cls AS INTEGER) AS y FROM probs),
st AS (SELECT layer, dataset, cls, score, sum(y) AS pos, sum(1 - y) AS neg FROM o GROUP BY ALL),
cu AS (SELECT *, sum(neg) OVER (PARTITION BY layer, dataset, cls ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb,
              sum(pos) OVER (PARTITION BY layer, dataset, cls ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tpc,
              sum(pos + neg) OVER (PARTITION BY layer, dataset, cls ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS allc
       FROM st),
rk AS (SELECT layer, dataset, cls,
              CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (coalesce(nb, 0) + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS auc,
              CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * tpc / allc) / sum(pos) END AS ap
       FROM cu GROUP BY layer, dataset, cls)"""

M10_SQL = vec_base(_OVR + """
SELECT layer, dataset, round(avg(auc), 6) AS ovr_auc FROM rk GROUP BY layer, dataset""")


@register("ovr_auc", M10_SQL)
def q_ovr_auc(spark, sf):
    s = scored(spark, sf, "category")
    return M.ovr_auc(s, KEYS, "probs", "category").select(*KEYS, rnd("ovr_auc").alias("ovr_auc"))


M11_SQL = vec_base(_OVR + """
SELECT layer, dataset, round(avg(ap), 6) AS multiclass_ap FROM rk GROUP BY layer, dataset""")


@register("multiclass_ap", M11_SQL)
def q_multiclass_ap(spark, sf):
    s = scored(spark, sf, "category")
    return M.multiclass_ap(s, KEYS, "probs", "category").select(*KEYS, rnd("multiclass_ap").alias("multiclass_ap"))


M12_SQL = vec_base(nmc_ctes(label="category") + """
SELECT example_id, layer, CAST(pred >= 1 AS INTEGER) AS pred FROM preds""")


@register("binarize_multiclass", M12_SQL)
def q_binarize_multiclass(spark, sf):
    s = scored(spark, sf, "category")
    return s.select("example_id", "layer", M.binarize_multiclass(F.col("pred")).alias("pred"))


M13_SQL = vec_base(nmc_ctes(label="category") + """,
ps AS (SELECT example_id, layer, sum(prob) FILTER (WHERE cls IN (1, 3, 5)) AS score FROM probs GROUP BY ALL)
SELECT example_id, layer, CAST(pred IN (1, 3, 5) AS INTEGER) AS pred, round(ps.score, 6) AS score
FROM preds JOIN ps USING (example_id, layer)""")


@register("collapse_positive_ids", M13_SQL)
def q_collapse_positive_ids(spark, sf):
    s = scored(spark, sf, "category")
    pred, score = M.collapse_positive_ids(F.col("pred"), F.col("probs"), [1, 3, 5])
    return s.select("example_id", "layer", pred.alias("pred"), rnd(score).alias("score"))


M14_SQL = vec_base(nmc_ctes(label="category") + """,
ps AS (SELECT example_id, layer, sum(prob) FILTER (WHERE cls % 2 = 1) AS score FROM probs GROUP BY ALL)
SELECT example_id, layer, CAST(pred % 2 = 1 AS INTEGER) AS pred, round(ps.score, 6) AS score
FROM preds JOIN ps USING (example_id, layer)""")


@register("collapse_dataset_protos", M14_SQL)
def q_collapse_dataset_protos(spark, sf):
    s = scored(spark, sf, "category")
    pred, score = M.collapse_dataset_protos(F.col("probs"))
    return s.select("example_id", "layer", pred.alias("pred"), rnd(score).alias("score"))


M15_SQL = vec_base(_CONF + _RANK + """
SELECT dataset, concat('nmc_layer', CAST(layer AS VARCHAR)) AS method, round(accuracy, 6) AS accuracy,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS true_positive_rate,
       round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 6) AS true_negative_rate,
       tn + fp AS negative_support, tp + fn AS positive_support,
       round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision
FROM cf JOIN rk USING (layer, dataset)""")

#: the columns of a score record from cf and rk
RECORD_SQL = """round(accuracy, 6) AS accuracy,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS true_positive_rate,
       round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 6) AS true_negative_rate,
       tn + fp AS negative_support, tp + fn AS positive_support,
       round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision
FROM cf JOIN rk USING (layer, dataset)"""
RECORD_COLS = ["accuracy", "f1", "true_positive_rate", "true_negative_rate", "negative_support", "positive_support",
               "roc_auc", "average_precision"]


def round_record(df: DataFrame, keys) -> DataFrame:
    return df.select(*keys, *[rnd(c).alias(c) if c not in ("negative_support", "positive_support") else F.col(c)
                              for c in RECORD_COLS])


@register("score_record", M15_SQL)
def q_score_record(spark, sf):
    s = scored(spark, sf).withColumn("method", F.concat(F.lit("nmc_layer"), F.col("layer").cast("string")))
    rec = M.binary_scores(s, ["dataset", "method"], "score", "label")
    return round_record(rec, ["dataset", "method"])


# Single-layer evaluation: the full record of all three methods per (layer, benchmark) ----------------------
SINGLE_SQL = vec_base(nmc_ctes().replace("preds AS (", "nmc AS (") + "," + gda_ctes() + f""",
lg AS (SELECT te.example_id, te.layer, te.dataset, te.label, p.cls, list_dot_product(te.vector, p.w) + p.b AS s
       FROM te JOIN g_params p USING (layer)),
zz AS (SELECT te.example_id, te.layer, te.dataset, te.label, g.cls, q.p, list_transform(te.vector, lambda x, c: x - g.m[c]) AS z
      FROM te JOIN g_params g USING (layer) JOIN g_prec q USING (layer)),
md AS (SELECT example_id, layer, dataset, label, cls, -({DISTANCE}) AS s FROM zz),
two AS (SELECT 'gda' AS kind, * FROM lg UNION ALL SELECT 'mahalanobis', * FROM md),
soft AS (SELECT *, exp(s - max(s) OVER w) AS e FROM two WINDOW w AS (PARTITION BY kind, example_id, layer)),
ps AS (SELECT kind, example_id, layer, dataset, label, cls, e / sum(e) OVER (PARTITION BY kind, example_id, layer) AS prob FROM soft),
allp AS (SELECT 'nmc' AS kind, layer AS l, dataset AS ds, label, score FROM nmc
         UNION ALL SELECT kind, layer, dataset, label, prob FROM ps WHERE cls = 1),
preds AS (SELECT concat(kind, '_layer', CAST(l AS VARCHAR)) AS layer, ds AS dataset, label, score FROM allp)""" + CONFUSION_SQL + _RANK + """
SELECT dataset, layer AS method, round(accuracy, 6) AS accuracy,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS true_positive_rate,
       round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 6) AS true_negative_rate,
       tn + fp AS negative_support, tp + fn AS positive_support,
       round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision
FROM cf JOIN rk USING (layer, dataset)""")


@register("single_layer_evaluation", SINGLE_SQL)
def q_single_layer_evaluation(spark, sf):
    """GDA, nearest-mean and Mahalanobis predictions of every layer, one score record per benchmark and method."""
    tr, te = train_test(spark, sf)
    fit = S.fit_gda(tr, ["layer"], "label")
    by = {"gda": SC.softmax_probs(SC.gda_logits(te, fit["params"], ["layer"])),
          "nmc": SC.nmc_pred(te, fit["means"], ["layer"]),
          "mahalanobis": SC.mahalanobis_pred(SC.mahalanobis_sq(te, fit["means"], fit["precision"], ["layer"]))}
    parts = [s.select("dataset", F.concat(F.lit(f"{k}_layer"), F.col("layer").cast("string")).alias("method"), "label",
                      SC.positive_score("probs").alias("score")) for k, s in by.items()]
    rec = M.binary_scores(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["dataset", "method"], "score", "label")
    return round_record(rec, ["dataset", "method"])
