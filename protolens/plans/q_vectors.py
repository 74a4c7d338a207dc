"""Registered queries: statistics (A*), scoring (G1-G10, G19), vector joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protolens.functions import vec as V
from protolens.operators import scoring as SC
from protolens.operators import stats as S
from protolens.operators.params import attach_params
from protolens.plans.catalog import register
from protolens.plans.common import layer_vectors, long_array, long_matrix, rnd, train_test
from protolens.plans.sqlparts import DISTANCE, gda_ctes, nmc_ctes, precision_ctes, scatter_ctes, vec_base
from protolens.sources import fixtures as fx

# ------------------------------------------------------------------ A1, A2

A1_SQL = vec_base("""
x AS (SELECT 1)
SELECT layer, label, CAST(count(*) AS BIGINT) AS n, i, round(avg(x), 6) AS value FROM tre GROUP BY layer, label, i""")


@register("class_means", A1_SQL)
def q_class_means(spark: SparkSession, sf: str) -> DataFrame:
    tr, _ = train_test(spark, sf)
    return long_array(S.class_means(tr, ["layer"], "label"), ["layer", "label", "n"], "mean")


A2_SQL = vec_base("""
c AS (SELECT layer, label, CAST(count(*) AS BIGINT) AS n FROM tr GROUP BY layer, label)
SELECT layer, label, n, CAST(sum(n) OVER (PARTITION BY layer) AS BIGINT) AS n_total FROM c""")


@register("class_counts", A2_SQL)
def q_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    tr, _ = train_test(spark, sf)
    return S.class_counts(tr, ["layer"], "label")


# ------------------------------------------------------------------ A3, A4, A5
_SCATTER = """
mu AS (SELECT layer, label, i, avg(x) AS m FROM tre GROUP BY ALL),
c AS (SELECT t.example_id, t.layer, t.label, t.i, t.x - mu.m AS xc FROM tre t JOIN mu USING (layer, label, i)),
sc AS (SELECT a.layer, a.label, a.i, b.i AS j, sum(a.xc * b.xc) AS s FROM c a JOIN c b USING (example_id, layer, label)
       GROUP BY a.layer, a.label, a.i, b.i),
cnt AS (SELECT layer, label, count(*) AS n FROM tr GROUP BY ALL),
lc AS (SELECT layer, count(*) AS nn FROM tr GROUP BY ALL)"""

A3_SQL = vec_base(_SCATTER + """
SELECT layer, i, j, round(sum(s) / (any_value(nn) - 1), 6) AS value FROM sc JOIN lc USING (layer) GROUP BY layer, i, j""")


@register("pooled_covariance", A3_SQL)
def q_pooled_covariance(spark: SparkSession, sf: str) -> DataFrame:
    tr, _ = train_test(spark, sf)
    pooled = S.pooled_covariance(S.class_scatter(tr, ["layer"], "label"), ["layer"])
    return long_matrix(pooled, ["layer"])


A4_SQL = vec_base(_SCATTER + """
SELECT layer, label, i, j, round(s / (n - 1), 6) AS value FROM sc JOIN cnt USING (layer, label)""")


@register("class_covariance", A4_SQL)
def q_class_covariance(spark: SparkSession, sf: str) -> DataFrame:
    tr, _ = train_test(spark, sf)
    cc = S.class_covariance(S.class_scatter(tr, ["layer"], "label"), ["layer"], "label")
    return long_matrix(cc, ["layer", "label"])


A5_SQL = vec_base(_SCATTER + """,
cv AS (SELECT layer, label, i, j, s / (n - 1) AS c FROM sc JOIN cnt USING (layer, label)),
dn AS (SELECT layer, label, sqrt(sum(c * c)) AS dn FROM cv WHERE i = j GROUP BY ALL)
SELECT layer, label, i, j, round(c / dn, 6) AS value FROM cv JOIN dn USING (layer, label)""")


@register("diag_norm_scaling", A5_SQL)
def q_diag_norm_scaling(spark: SparkSession, sf: str) -> DataFrame:
    tr, _ = train_test(spark, sf)
    cc = S.class_covariance(S.class_scatter(tr, ["layer"], "label"), ["layer"], "label")
    return long_matrix(S.diag_norm_scaling(cc, ["layer", "label"]), ["layer", "label"])


# ------------------------------------------------------------------ A6, A7, A8


def _fit(spark, sf, per_class=False):
    tr, te = train_test(spark, sf)
    return S.fit_gda(tr, ["layer"], "label", per_class=per_class), tr, te


_LONG_P = """
pl AS (SELECT *, CAST(unnest(range(len(p))) AS INTEGER) AS i, unnest(p) AS r FROM {src}),
pe AS (SELECT * EXCLUDE (p, r), CAST(unnest(range(len(r))) AS INTEGER) AS j, unnest(r) AS value FROM pl)"""

A6_SQL = vec_base(gda_ctes() + "," + _LONG_P.format(src="g_prec") + """
SELECT layer, i, j, round(value, 6) AS value FROM pe""")


@register("bayes_precision", A6_SQL)
def q_bayes_precision(spark: SparkSession, sf: str) -> DataFrame:
    fit, _, _ = _fit(spark, sf)
    return long_matrix(fit["precision"], ["layer"])


_CLASS_PRECISION = scatter_ctes() + """,
g_s AS (SELECT layer, cls, u.n AS nn, i, j, s FROM g_se JOIN (SELECT layer, cls, n FROM g_mu) u USING (layer, cls)),
""" + precision_ctes("layer, cls", "g_s", "g_cp").lstrip()

A7_SQL = vec_base(_CLASS_PRECISION + "," + _LONG_P.format(src="g_cp") + """
SELECT layer, cls AS label, i, j, round(value, 6) AS value FROM pe""")


@register("class_precisions", A7_SQL)
def q_class_precisions(spark: SparkSession, sf: str) -> DataFrame:
    fit, _, _ = _fit(spark, sf, per_class=True)
    return long_matrix(fit["class_precision"], ["layer", "label"])


A8_SQL = vec_base(gda_ctes() + """
SELECT layer, cls AS label, concat('w', CAST(q AS VARCHAR)) AS param, round(value, 6) AS value
FROM (SELECT layer, cls, unnest(range(len(w))) AS q, unnest(w) AS value FROM g_params)
UNION ALL
SELECT layer, cls AS label, 'b' AS param, round(b, 6) AS value FROM g_params""")


def _params_long(params: DataFrame, keys) -> DataFrame:
    keys = list(keys)
    weights = params.select(*keys, F.posexplode("w").alias("q", "value")).select(
        *keys, F.concat(F.lit("w"), F.col("q").cast("string")).alias("param"), rnd("value").alias("value"))
    return weights.unionByName(params.select(*keys, F.lit("b").alias("param"), rnd("b").alias("value")))


@register("gda_params", A8_SQL)
def q_gda_params(spark: SparkSession, sf: str) -> DataFrame:
    fit, _, _ = _fit(spark, sf)
    return _params_long(fit["params"], ["layer", "label"])


# ------------------------------------------------------------------ A11-A15

DATASET_COMBOS_SQL = _DS_COMBOS = """
ds AS (SELECT dataset, CAST(row_number() OVER (ORDER BY dataset) - 1 AS INTEGER) AS r FROM (SELECT DISTINCT dataset FROM v)),
masks AS (SELECT unnest(range(1, CAST(pow(2, (SELECT count(*) FROM ds)) AS BIGINT))) AS m),
cd AS (SELECT m, dataset, r FROM masks, ds WHERE (m >> r) & 1 = 1),
combos AS (SELECT m, dataset, string_agg(dataset, '+' ORDER BY r) OVER (PARTITION BY m) AS combo,
                  CAST(count(*) OVER (PARTITION BY m) AS INTEGER) AS combo_size FROM cd)"""


def _dataset_names(v: DataFrame) -> list[str]:
    """Names of the datasets (a parameter: a handful)."""
    return sorted(r[0] for r in v.select("dataset").distinct().collect())


A14_SQL = vec_base(_DS_COMBOS + """
SELECT combo, combo_size, dataset FROM combos""")


@register("dataset_combinations", A14_SQL)
def q_dataset_combinations(spark: SparkSession, sf: str) -> DataFrame:
    """Every non-empty set of the datasets found in the data: their distinct names exploded over the sets that hold them."""
    v = layer_vectors(spark, sf)
    names = _dataset_names(v)
    sets = v.select("dataset").distinct().select("dataset", F.explode(S.dataset_masks(names)).alias("m"))
    return sets.select(S.combination_name(F.col("m"), names).alias("combo"), F.bit_count("m").cast("int").alias("combo_size"), "dataset")


A11_SQL = vec_base(_DS_COMBOS + """,
mu AS (SELECT layer, dataset, label, i, avg(x) AS m FROM tre GROUP BY ALL),
c AS (SELECT t.example_id, t.layer, t.dataset, t.label, t.i, t.x - mu.m AS xc
      FROM tre t JOIN mu USING (layer, dataset, label, i)),
sc AS (SELECT a.layer, a.dataset, a.i, b.i AS j, sum(a.xc * b.xc) AS s FROM c a JOIN c b USING (example_id, layer, dataset, label)
       GROUP BY ALL),
cnt AS (SELECT layer, dataset, count(*) AS n FROM tr GROUP BY ALL)
SELECT combo, layer, i, j, round(sum(s) / (sum(n) - 1), 6) AS value
FROM sc JOIN cnt USING (layer, dataset) JOIN combos USING (dataset) GROUP BY combo, layer, i, j""")


@register("merge_covariances", A11_SQL)
def q_merge_covariances(spark: SparkSession, sf: str) -> DataFrame:
    tr, _ = train_test(spark, sf)
    names = _dataset_names(layer_vectors(spark, sf))
    per_ds = S.pooled_covariance(S.class_scatter(tr, ["layer", "dataset"], "label"), ["layer", "dataset"])
    merged = S.merge_combination_covariances(per_ds, ["layer"], names)
    return long_matrix(merged.withColumn("combo", S.combination_name(F.col("mask"), names)), ["combo", "layer"])


A12_SQL = vec_base(_DS_COMBOS + """,
mu AS (SELECT layer, dataset, label, i, avg(x) AS mm, count(*) AS n FROM tre GROUP BY ALL)
SELECT combo, layer, label, CAST(sum(n) AS BIGINT) AS n, i, round(sum(n * mm) / sum(n), 6) AS value
FROM mu JOIN combos USING (dataset) GROUP BY combo, layer, label, i""")


@register("merge_means_weighted", A12_SQL)
def q_merge_means_weighted(spark: SparkSession, sf: str) -> DataFrame:
    tr, _ = train_test(spark, sf)
    names = _dataset_names(layer_vectors(spark, sf))
    merged = S.merge_combination_means(S.class_means(tr, ["layer", "dataset"], "label"), ["layer", "label"], names)
    return long_array(merged.withColumn("combo", S.combination_name(F.col("mask"), names)), ["combo", "layer", "label", "n"], "mean")


A13_SQL = vec_base(_DS_COMBOS + """,
mu AS (SELECT layer, dataset, label, count(*) AS n FROM tr GROUP BY ALL)
SELECT combo, layer, dataset, label, CAST(n AS BIGINT) AS n,
       CAST(row_number() OVER (PARTITION BY combo, layer ORDER BY dataset, label) - 1 AS INTEGER) AS proto_id,
       CAST((row_number() OVER (PARTITION BY combo, layer ORDER BY dataset, label) - 1) % 2 AS INTEGER) AS proto_class
FROM mu JOIN combos USING (dataset)""")


@register("stack_prototypes", A13_SQL)
def q_stack_prototypes(spark: SparkSession, sf: str) -> DataFrame:
    tr, _ = train_test(spark, sf)
    names = _dataset_names(layer_vectors(spark, sf))
    st = S.stack_prototypes(S.class_means(tr, ["layer", "dataset"], "label"), names, ["layer"], "label")
    return st.select("combo", "layer", "dataset", "label", "n", "proto_id", "proto_class")


A15_SQL = vec_base("""
mu AS (SELECT layer, category, i, avg(x) AS m FROM tre GROUP BY ALL),
c AS (SELECT t.example_id, t.layer, t.category, t.i, t.x - mu.m AS xc FROM tre t JOIN mu USING (layer, category, i)),
sc AS (SELECT a.layer, a.category, a.i, b.i AS j, sum(a.xc * b.xc) AS s FROM c a JOIN c b USING (example_id, layer, category)
       GROUP BY ALL),
cnt AS (SELECT layer, category, count(*) AS n FROM tr GROUP BY ALL),
steps AS (SELECT unnest(range(1, (SELECT max(category) FROM tr) + 1)) AS step),
sc2 AS (SELECT step, layer, i, j, sum(s) AS s FROM sc, steps WHERE category <= step GROUP BY ALL),
n2 AS (SELECT step, layer, sum(n) AS n FROM cnt, steps WHERE category <= step GROUP BY ALL)
SELECT CAST(step AS INTEGER) AS step, layer, i, j, round(s / (n - 1), 6) AS value FROM sc2 JOIN n2 USING (step, layer)""")


@register("incremental_categories", A15_SQL)
def q_incremental_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Pooled covariance for every category step from per-category partials (one scan)."""
    tr, _ = train_test(spark, sf)
    per_cat = S.class_scatter(tr, ["layer"], "category")  # additive per category
    top = int(tr.agg(F.max("category")).first()[0] or 0)
    stepped = S.incremental_steps(per_cat, "category", max_step=top)
    pooled = S.pooled_covariance(stepped.drop("category"), ["step", "layer"])
    return long_matrix(pooled, ["step", "layer"])


# ------------------------------------------------------------------ G1-G10


def _probs_long(df: DataFrame, keys, arr: str = "probs") -> DataFrame:
    return long_array(df, keys, arr, idx="cls", val="value")


G1_SQL = vec_base(gda_ctes() + """
SELECT te.example_id, te.layer, CAST(p.cls AS INTEGER) AS cls, round(list_dot_product(te.vector, p.w) + p.b, 6) AS value
FROM te JOIN g_params p USING (layer)""")


@register("gda_logits", G1_SQL)
def q_gda_logits(spark: SparkSession, sf: str) -> DataFrame:
    fit, _, te = _fit(spark, sf)
    return _probs_long(SC.gda_logits(te, fit["params"], ["layer"]), ["example_id", "layer"], "logits")


G2_SQL = vec_base(nmc_ctes() + """
SELECT example_id, layer, CAST(cls AS INTEGER) AS cls, round(prob, 6) AS value FROM probs""")


def _nmc(spark, sf, label="label"):
    tr, te = train_test(spark, sf)
    means = S.class_means(tr, ["layer"], label)
    return SC.nmc_pred(te, means, ["layer"], label)


@register("softmax_probs", G2_SQL)
def q_softmax_probs(spark: SparkSession, sf: str) -> DataFrame:
    return _probs_long(_nmc(spark, sf), ["example_id", "layer"])


G3_SQL = vec_base(nmc_ctes() + """
SELECT example_id, layer, pred FROM preds""")


@register("argmax_class", G3_SQL)
def q_argmax_class(spark: SparkSession, sf: str) -> DataFrame:
    return _nmc(spark, sf).select("example_id", "layer", "pred")


G6_SQL = vec_base(nmc_ctes() + """
SELECT example_id, layer, pred, round(score, 6) AS score FROM preds""")


@register("nmc_pred", G6_SQL)
def q_nmc_pred(spark: SparkSession, sf: str) -> DataFrame:
    s = _nmc(spark, sf)
    return s.select("example_id", "layer", "pred", rnd(F.element_at("probs", 2)).alias("score"))


G4_SQL = vec_base(gda_ctes() + f""",
z AS (SELECT te.example_id, te.layer, g.cls, q.p, list_transform(te.vector, lambda x, c: x - g.m[c]) AS z
      FROM te JOIN g_params g USING (layer) JOIN g_prec q USING (layer))
SELECT example_id, layer, CAST(cls AS INTEGER) AS cls, round({DISTANCE}, 6) AS value FROM z""")


@register("mahalanobis_sq", G4_SQL)
def q_mahalanobis_sq(spark: SparkSession, sf: str) -> DataFrame:
    fit, _, te = _fit(spark, sf)
    s = SC.mahalanobis_sq(te, fit["means"], fit["precision"], ["layer"])
    return _probs_long(s, ["example_id", "layer"], "maha")


G5_SQL = vec_base(_CLASS_PRECISION + f""",
z AS (SELECT te.example_id, te.layer, g.cls, q.p, list_transform(te.vector, lambda x, c: x - g.m[c]) AS z
      FROM te JOIN g_mu g USING (layer) JOIN g_cp q ON q.layer = g.layer AND q.cls = g.cls),
d AS (SELECT example_id, layer, cls, -({DISTANCE}) AS s FROM z),
mx AS (SELECT example_id, layer, max(s) AS ms FROM d GROUP BY ALL),
pr AS (SELECT d.*, mx.ms, exp(d.s - mx.ms) / sum(exp(d.s - mx.ms)) OVER (PARTITION BY d.example_id, d.layer) AS prob
       FROM d JOIN mx USING (example_id, layer))
SELECT example_id, layer, CAST(min(cls) FILTER (WHERE s = ms) AS INTEGER) AS pred,
       round(max(prob) FILTER (WHERE cls = 1), 6) AS score
FROM pr GROUP BY example_id, layer""")


@register("mahalanobis_class_pred", G5_SQL)
def q_mahalanobis_class_pred(spark: SparkSession, sf: str) -> DataFrame:
    fit, _, te = _fit(spark, sf, per_class=True)
    s = SC.mahalanobis_pred(SC.mahalanobis_class_sq(te, fit["means"], fit["class_precision"], ["layer"]))
    return s.select("example_id", "layer", "pred", rnd(F.element_at("probs", 2)).alias("score"))


_GDA_PROBS = """,
lg AS (SELECT te.example_id, te.layer, te.dataset, te.dataset_type, te.label, p.cls,
              list_dot_product(te.vector, p.w) + p.b AS s FROM te JOIN g_params p USING (layer)),
lmx AS (SELECT example_id, layer, max(s) AS ms FROM lg GROUP BY ALL),
gp AS (SELECT lg.*, lmx.ms, exp(lg.s - lmx.ms) / sum(exp(lg.s - lmx.ms)) OVER (PARTITION BY lg.example_id, lg.layer) AS prob
       FROM lg JOIN lmx USING (example_id, layer))"""

G7_SQL = vec_base(gda_ctes() + _GDA_PROBS + """
SELECT example_id, layer, round(prob, 6) AS score FROM gp WHERE cls = 1""")


def _gda_scored(spark, sf, label="label"):
    tr, te = train_test(spark, sf)
    fit = S.fit_gda(tr, ["layer"], label)
    return SC.softmax_probs(SC.gda_logits(te, fit["params"], ["layer"], label))


@register("layer_scores", G7_SQL)
def q_layer_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = _gda_scored(spark, sf)
    return s.select("example_id", "layer", rnd(SC.positive_score("probs")).alias("score"))


G8_SQL = vec_base(gda_ctes(label="category") + _GDA_PROBS + """
SELECT example_id, concat('layer', CAST(layer AS VARCHAR), '_', CAST(cls AS VARCHAR)) AS feature, round(prob, 6) AS value
FROM gp WHERE cls >= 1""")


@register("layer_class_features", G8_SQL)
def q_layer_class_features(spark: SparkSession, sf: str) -> DataFrame:
    s = _gda_scored(spark, sf, label="category")
    feats = s.select("example_id", "layer", F.posexplode(F.slice("probs", 2, F.size("probs"))).alias("k", "value"))
    return feats.select(
        "example_id",
        F.concat(F.lit("layer"), F.col("layer").cast("string"), F.lit("_"), (F.col("k") + 1).cast("string")).alias(
            "feature"),
        rnd("value").alias("value"),
    )


G9_SQL = vec_base(gda_ctes(keys="layer, dataset") + """,
lg AS (SELECT te.example_id, te.layer, p.dataset AS model, p.cls, list_dot_product(te.vector, p.w) + p.b AS s
       FROM te JOIN g_params p ON te.layer = p.layer),
lmx AS (SELECT example_id, layer, model, max(s) AS ms FROM lg GROUP BY ALL),
gp AS (SELECT lg.*, exp(lg.s - lmx.ms) / sum(exp(lg.s - lmx.ms)) OVER (PARTITION BY lg.example_id, lg.layer, lg.model) AS prob
       FROM lg JOIN lmx USING (example_id, layer, model))
SELECT example_id, layer, model, round(prob, 6) AS score FROM gp WHERE cls = 1""")


@register("layer_dataset_features", G9_SQL)
def q_layer_dataset_features(spark: SparkSession, sf: str) -> DataFrame:
    tr, te = train_test(spark, sf)
    fit = S.fit_gda(tr, ["layer", "dataset"], "label")
    params = fit["params"].withColumnRenamed("dataset", "model")
    # every test row against every dataset's model of the same layer
    models = sorted(r[0] for r in params.select("model").distinct().collect())  # a parameter: dataset names
    rows = te.select("example_id", "layer", "vector").withColumn(
        "model", F.explode(F.array(*[F.lit(m) for m in models])))
    s = SC.softmax_probs(SC.gda_logits(rows, params, ["layer", "model"], "label"))
    return s.select("example_id", "layer", "model", rnd(SC.positive_score("probs")).alias("score"))


G10_SQL = vec_base(nmc_ctes(label="category") + """
SELECT example_id, layer, round(sum(prob) FILTER (WHERE cls % 2 = 1), 6) AS value FROM probs GROUP BY example_id, layer""")


@register("odd_class_sum", G10_SQL)
def q_odd_class_sum(spark: SparkSession, sf: str) -> DataFrame:
    s = _nmc(spark, sf, label="category")
    return s.select("example_id", "layer", rnd(SC.odd_class_sum("probs")).alias("value"))


# ------------------------------------------------------------------ J3, J7, J8
J7_SQL = vec_base("""
mu AS (SELECT layer, label AS proto, i, avg(x) AS m FROM tre GROUP BY ALL)
SELECT t.example_id, t.layer, CAST(mu.proto AS INTEGER) AS proto, round(sum((t.x - mu.m) * (t.x - mu.m)), 6) AS value
FROM tee t JOIN mu ON t.layer = mu.layer AND t.i = mu.i GROUP BY t.example_id, t.layer, mu.proto""")


@register("score_cross_join", J7_SQL)
def q_score_cross_join(spark: SparkSession, sf: str) -> DataFrame:
    """Every test vector against every prototype of its own layer (equi join on layer, broadcast)."""
    tr, te = train_test(spark, sf)
    protos = S.class_means(tr, ["layer"], "label").select("layer", F.col("label").alias("proto"), "mean")
    j = attach_params(te, protos, ["layer"])
    return j.select("example_id", "layer", F.col("proto").cast("int").alias("proto"),
                    rnd(V.sq_dist("vector", "mean")).alias("value"))


J8_SQL = vec_base(nmc_ctes() + """
SELECT example_id, round(max(score) FILTER (WHERE layer = 1), 6) AS layer_1,
       round(max(score) FILTER (WHERE layer = 2), 6) AS layer_2, round(max(score) FILTER (WHERE layer = 3), 6) AS layer_3
FROM preds GROUP BY example_id""")


@register("layer_feature_align", J8_SQL)
def q_layer_feature_align(spark: SparkSession, sf: str) -> DataFrame:
    s = _nmc(spark, sf).select("example_id", "layer", rnd(F.element_at("probs", 2)).alias("score"))
    wide = SC.layer_features(s, "example_id", ["layer"], "score", [1, 2, 3])
    return wide.select("example_id", *[F.col(str(i)).alias(f"layer_{i}") for i in (1, 2, 3)])


J3_SQL = fx.with_views("""
SELECT v.example_id, v.layer, e.label AS category, round(list_sum(v.vector), 6) AS vsum
FROM vectors v JOIN embeddings e ON v.example_id = e.vec_id WHERE v.layer <> 0""", "vectors")


@register("attach_category", J3_SQL)
def q_attach_category(spark: SparkSession, sf: str) -> DataFrame:
    """Categories attached to vector rows by key (replaces the reference's positional zip)."""
    v = layer_vectors(spark, sf).drop("category")
    cats = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("example_id"), F.col("label").alias("category"))
    return v.join(cats, "example_id").select("example_id", "layer", "category", rnd(V.vsum("vector")).alias("vsum"))
