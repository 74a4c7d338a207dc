"""Registered queries of iterative fits: G11-G18, A9, A10.

The stacks and k-means have SQL twins that reach the same optimum by other steps; the supervised baselines (G16-G18)
are checked by row count and invariants (tests/test_meta.py).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from protolens.operators import clustering as CL
from protolens.operators import meta as ME
from protolens.operators import metrics as M
from protolens.operators import scoring as SC
from protolens.operators import stats as S
from protolens.plans.catalog import register
from protolens.plans.common import long_array, long_matrix, rnd, signal_split, train_test
from protolens.plans.flagship import RECORD_COLS, features, fit_layers, layer_probabilities
from protolens.plans.q_metrics import CONFUSION_SQL, RANK_SQL, RECORD_SQL
from protolens.plans.sqlparts import gda_ctes, l1_ctes, precision_ctes, scatter_ctes, vec_base


def _train_features(spark: SparkSession, sf: str):
    tr, te = signal_split(spark, sf)
    fit = fit_layers(tr)
    layers = sorted(r[0] for r in fit["params"].select("layer").distinct().collect())
    feat, cols = features(layer_probabilities(tr, fit["params"]), layers, ["label"])
    return tr, te, layers, fit, feat, cols


_PROB = """
lg{n} AS (SELECT t.example_id, t.layer, t.label, p.cls, list_dot_product(t.vector, p.w) + p.b AS s FROM {rows} t JOIN g_params p USING (layer)),
pr{n} AS (SELECT *, exp(s - max(s) OVER o) AS e FROM lg{n} WINDOW o AS (PARTITION BY example_id, layer)),
ft{n} AS (SELECT 'all' AS grp, example_id AS rid, list_append(list(prob ORDER BY layer), 1.0::DOUBLE) AS x, any_value(label) AS y
        FROM (SELECT example_id, layer, label, cls, e / sum(e) OVER (PARTITION BY example_id, layer) AS prob FROM pr{n}) WHERE cls = 1 GROUP BY example_id)"""


def _stack_sql(cs: str, body: str, steps: int = 3500) -> str:
    """``body`` over l1 (grp, C, w[]) fitted on the layer probabilities of the training rows, and ft2 (test features)."""
    return vec_base(gda_ctes() + "," + _PROB.format(n=1, rows="tr") + "," + _PROB.format(n=2, rows="te") + f""",
cs AS (SELECT 'all' AS grp, unnest([{cs}]) AS C),""" + l1_ctes("ft1", "cs", steps=steps) + f""",
ly AS (SELECT layer, row_number() OVER (ORDER BY layer) AS p FROM (SELECT DISTINCT layer FROM tr))
{body}""", "signal_vectors")


@register("meta_fit", _stack_sql("1.0, 0.1, 0.01", """
SELECT C, layer, round(w[p], 6) AS coefficient FROM l1, ly
UNION ALL SELECT C, -1, round(w[-1], 6) FROM l1"""))
def q_meta_fit(spark, sf):
    """Stacked L1 models for C = 1, 0.1, 0.01 -> (C, layer, coefficient) plus intercept rows."""
    _, _, layers, fit, feat, cols = _train_features(spark, sf)
    cs = (1.0, 0.1, 0.01)
    out = None
    for c, model in zip(cs, ME.fit_stacks(feat, cols, "label", [ME.Problem(c) for c in cs])):
        co = ME.meta_coefficients(spark, model, layers, c, layer_source=fit["params"])
        intercept = fit["params"].select(F.lit(-1).alias("layer"), F.lit(ME.intercept(model)).alias("coefficient"),
                                         F.lit(float(c)).alias("C")).limit(1)  # one row, from the fitted table
        co = co.unionByName(intercept)
        out = co if out is None else out.unionByName(co)
    return out.select("C", "layer", rnd("coefficient").alias("coefficient"))


@register("meta_predict", _stack_sql("1.0", """
SELECT rid AS example_id, round(1 / (1 + exp(-list_dot_product(x, w))), 6) AS meta_score FROM ft2, l1"""))
def q_meta_predict(spark, sf):
    """P(class 1) of the stacked model for every test example."""
    _, te, layers, fit, feat, cols = _train_features(spark, sf)
    model = ME.meta_fit(feat, cols, "label", 1.0)
    te_feat, _ = features(layer_probabilities(te, fit["params"]), layers)
    return ME.meta_predict(model, te_feat, cols, "meta_score").select("example_id", rnd("meta_score").alias("meta_score"))


@register("regularisation_path", _stack_sql(", ".join(map(str, ME.REGULARISATION_CS)), """
SELECT C, layer, round(w[p], 6) AS coefficient, CAST(sum(CASE WHEN abs(w[p]) > 1e-5 THEN 1 ELSE 0 END) OVER (PARTITION BY C) AS BIGINT) AS layers_used
FROM l1, ly"""))
def q_regularisation_path(spark, sf):
    """Eight C values, all fitted in the same passes -> (C, layer, coefficient, layers_used)."""
    _, _, layers, fit, feat, cols = _train_features(spark, sf)
    out = None
    for c, model in ME.regularisation_path(feat, cols, "label"):
        co = ME.meta_coefficients(spark, model, layers, c, layer_source=fit["params"])
        out = co if out is None else out.unionByName(co)
    used = out.groupBy("C").agg(F.sum((F.abs("coefficient") > 1e-5).cast("int")).alias("layers_used"))
    return out.join(used, "C").select("C", "layer", rnd("coefficient").alias("coefficient"), "layers_used")


META_COEFFICIENTS_SQL = _stack_sql("1.0", "SELECT layer, round(w[p], 6) AS coefficient FROM l1, ly")


@register("meta_coefficients", META_COEFFICIENTS_SQL)
def q_meta_coefficients(spark, sf):
    """Layer -> weight of the C = 1 stack."""
    _, _, layers, fit, feat, cols = _train_features(spark, sf)
    co = ME.meta_coefficients(spark, ME.meta_fit(feat, cols, "label", 1.0), layers, layer_source=fit["params"])
    return co.select("layer", rnd("coefficient").alias("coefficient"))


REUSE_SQL = vec_base("""
stp AS (SELECT tr.*, step FROM tr, (SELECT unnest(range(1, (SELECT max(category) FROM tr) + 1)) AS step) WHERE category <= step),
""" + gda_ctes("category", "step, layer", "stp").lstrip() + "".join(f""",
lg{n} AS (SELECT p.step, t.example_id, t.layer, t.dataset, t.category, p.cls, list_dot_product(t.vector, p.w) + p.b AS s
       FROM {rows} t JOIN g_params p ON t.layer = p.layer AND t.category <= p.step),
pr{n} AS (SELECT *, exp(s - max(s) OVER o) AS e FROM lg{n} WINDOW o AS (PARTITION BY step, example_id, layer)),
hm{n} AS (SELECT step, example_id, layer, any_value(dataset) AS dataset, any_value(category) AS category, 1 - sum(e) FILTER (WHERE cls = 0) / sum(e) AS score
       FROM pr{n} GROUP BY step, example_id, layer),
ft{n} AS (SELECT 'all' AS grp, step, example_id AS rid, any_value(dataset) AS dataset, CAST(any_value(category) >= 1 AS INTEGER) AS y,
              list_append(list(score ORDER BY layer), 1.0::DOUBLE) AS x FROM hm{n} GROUP BY step, example_id)""" for n, rows in ((1, "tr"), (2, "te"))) + """,
one AS (SELECT * FROM ft1 WHERE step = 1), cs AS (SELECT 'all' AS grp, 0.01::DOUBLE AS C),""" + l1_ctes("one", "cs", steps=700) + """,
preds AS (SELECT CAST(step AS VARCHAR) AS layer, dataset, y AS label, round(1 / (1 + exp(-list_dot_product(x, w))), 9) AS score FROM ft2, l1)"""
    + CONFUSION_SQL + RANK_SQL + """
SELECT CAST(layer AS INTEGER) AS step, dataset, """ + RECORD_SQL)


@register("reuse_first_meta", REUSE_SQL)
def q_reuse_first_meta(spark, sf):
    """Category steps 1..9 fitted in one (step, layer)-keyed job; the L1 stack (C = 0.01) is
    fitted on step 1 and reused for the later steps (finetune=False)."""
    tr, te = train_test(spark, sf)
    cats = S.materialize(S.class_counts(tr, ["layer"], "category"))  # small: layers x categories
    layers = sorted(r[0] for r in cats.select("layer").distinct().collect())
    max_step = int(cats.agg(F.max("category")).first()[0])
    fit = S.fit_gda_steps(tr, ["layer"], "category", max_step)

    def harm(rows):
        stepped = S.incremental_steps(rows, "category", max_step)
        s = SC.softmax_probs(SC.gda_logits(stepped, fit["params"], ["step", "layer"], "category"))
        s = s.withColumn("score", 1.0 - F.element_at("probs", 1))  # all non-benign classes
        wide = s.withColumn("_f", F.concat(F.lit("layer_"), F.col("layer").cast("string"))).groupBy(
            "step", "example_id").pivot("_f", [f"layer_{x}" for x in layers]).agg(F.first("score"))
        meta = rows.select("example_id", "dataset", (F.col("category") >= 1).cast("int").alias("y")).distinct()
        return wide.join(meta, "example_id"), [f"layer_{x}" for x in layers]

    f_tr, cols = harm(tr)
    model = ME.meta_fit(f_tr.where("step = 1"), cols, "y", 0.01)
    f_te, _ = harm(te)
    sc = ME.meta_predict(model, f_te, cols, "score")
    rec = M.binary_scores(sc, ["step", "dataset"], "score", "y")
    return rec.select("step", "dataset", *[rnd(c).alias(c) if "support" not in c else F.col(c) for c in RECORD_COLS])


def _supervised(spark, sf, fit_fn, method):
    """A classifier on the raw vectors of every layer, one record a benchmark and layer.

    A task that scores holds a whole model, so each layer is scored and written before the next is fitted, by one task a core."""
    tr, te = train_test(spark, sf)
    tr, te = ME.materialize(tr.select("layer", "label", "vector")), ME.materialize(te.select("layer", "dataset", "label", "vector"))
    cores = spark.sparkContext.defaultParallelism

    def score(layer):
        model = fit_fn(tr.where(F.col("layer") == layer))
        s = ME.predict_vectors(model, te.where(F.col("layer") == layer).coalesce(cores), "vector", "score")
        return ME.materialize(s.select("layer", "dataset", "label", "score"))

    scored = None
    for layer in [r["layer"] for r in tr.select("layer").distinct().orderBy("layer").collect()]:  # one model a layer
        s = score(layer)
        scored = s if scored is None else scored.unionByName(s)
    rec = M.binary_scores(scored.withColumn("method", F.lit(method)), ["layer", "dataset", "method"], "score", "label")
    return rec.select("layer", "dataset", "method", *[rnd(c).alias(c) if "support" not in c else F.col(c) for c in RECORD_COLS])


@register("supervised_lr")
def q_supervised_lr(spark, sf):
    """L2 logistic regression on the raw vectors of every layer, scored per benchmark."""
    return _supervised(spark, sf, ME.supervised_lr, "lr")


@register("supervised_rf")
def q_supervised_rf(spark, sf):
    """Random forest baseline."""
    return _supervised(spark, sf, ME.supervised_rf, "rf")


@register("supervised_gbt")
def q_supervised_gbt(spark, sf):
    """Gradient-boosted trees baseline."""
    return _supervised(spark, sf, ME.supervised_gbt, "gbt")


def _mean_of(cluster: int) -> str:
    return "[" + ", ".join(f"avg(vector[{i}]) FILTER (WHERE cl = {cluster}) OVER g" for i in range(1, 17)) + "]"


#: Lloyd's rounds on the rows themselves, two clusters a class, from the first two rows in hash order
_LLOYD = f"""
st AS (SELECT example_id, layer, label, vector, row_number() OVER (PARTITION BY layer, label ORDER BY md5(concat(CAST(example_id AS VARCHAR), ':42')), example_id) AS rn FROM tr),
c0 AS (SELECT layer, label, max(vector) FILTER (WHERE rn = 1) AS a, max(vector) FILTER (WHERE rn = 2) AS b FROM st GROUP BY layer, label),
ll(example_id, layer, label, vector, k, cl) USING KEY (example_id, layer) AS (
  SELECT example_id, st.layer, st.label, vector, 0, CASE WHEN list_distance(vector, b) < list_distance(vector, a) THEN 1 ELSE 0 END
  FROM st JOIN c0 ON st.layer = c0.layer AND st.label = c0.label
  UNION
  SELECT example_id, layer, label, vector, k + 1, CASE WHEN list_distance(vector, b) < list_distance(vector, a) THEN 1 ELSE 0 END
  FROM (SELECT *, {_mean_of(0)} AS a, {_mean_of(1)} AS b FROM ll WHERE k < 100 WINDOW g AS (PARTITION BY layer, label))),
asg AS (SELECT example_id, layer, CAST(label * 2 + cl AS INTEGER) AS cluster_id, vector FROM ll),
ae AS (SELECT layer, cluster_id, unnest(range(len(vector))) AS i, unnest(vector) AS x FROM asg)"""


@register("cluster_prototypes", vec_base(_LLOYD + """
SELECT layer, cluster_id, CAST(count(*) AS BIGINT) AS n, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS value FROM ae GROUP BY layer, cluster_id, i"""))
def q_cluster_prototypes(spark, sf):
    """Two k-means prototypes per class and layer -> (layer, cluster_id, n, i, value)."""
    tr, _ = train_test(spark, sf)
    p = CL.cluster_prototypes(tr, ["layer"], "label", n_clusters_per_class=2)
    return long_array(p["means"], ["layer", "cluster_id", "n"], "mean")


@register("cluster_precisions", vec_base(_LLOYD + "," + scatter_ctes("cluster_id", "layer", "asg") + """,
cn AS (SELECT layer, cls, count(*) AS nn FROM g_x GROUP BY ALL),
cs AS (SELECT g_se.layer, g_se.cls, nn, i, j, s FROM g_se JOIN cn ON g_se.layer = cn.layer AND g_se.cls = cn.cls),
""" + precision_ctes("layer, cls", "cs", "cp").lstrip() + """,
pr AS (SELECT layer, cls, unnest(range(len(p))) AS i, unnest(p) AS r FROM cp)
SELECT layer, CAST(cls AS INTEGER) AS cluster_id, CAST(i AS INTEGER) AS i, CAST(unnest(range(len(r))) AS INTEGER) AS j, round(unnest(r), 6) AS value FROM pr"""))
def q_cluster_precisions(spark, sf):
    """A10: Bayes precision of every cluster covariance -> (layer, cluster_id, i, j, value)."""
    tr, _ = train_test(spark, sf)
    p = CL.cluster_prototypes(tr, ["layer"], "label", n_clusters_per_class=2)
    return long_matrix(CL.cluster_precisions(p)["cluster_precision"], ["layer", "cluster_id"])
