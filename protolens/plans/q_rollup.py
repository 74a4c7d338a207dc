"""Registered queries: result analytics (D1-D18) over result tables derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from protolens.operators import rollup as R
from protolens.plans.catalog import register
from protolens.plans.common import rnd
from protolens.sources import fixtures as fx
from protolens.sources.fixtures import with_views

DATASETS = ["click", "error", "purchase", "signup", "view"]
CATEGORY_ORDER = ["view", "click", "signup", "purchase", "error"]
N_LAYERS = {"model0": 32, "model1": 32, "model2": 40}


def _rs(spark, sf):
    return fx.result_scores(spark, sf)


def _rs_sql(body: str) -> str:
    return with_views(body, "result_scores")


def _coefs(spark, sf):
    ev = fx.table(spark, sf, "events")
    g = ev.groupBy(F.concat(F.lit("model"), (F.col("user_id") % 3).cast("string")).alias("model"),
                   F.col("event_type").alias("C"), (F.col("event_id") % 32).cast("int").alias("layer"))
    return g.agg(F.avg(F.when(F.col("value") < 20, F.lit(0.0)).otherwise((F.col("value") - 20) / 1000))
                 .alias("coefficient"))


_COEFS = """
coefs AS (SELECT concat('model', CAST(user_id % 3 AS VARCHAR)) AS model, event_type AS C, CAST(event_id % 32 AS INTEGER) AS layer,
                 avg(CASE WHEN value < 20 THEN 0.0 ELSE (value - 20) / 1000 END) AS coefficient FROM events GROUP BY 1, 2, 3)"""


# D1 ---------------------------------------------------------------------------
@register("path_fields", _rs_sql("""
SELECT model, dataset, CAST(split_part(seed, '_', 2) AS INTEGER) AS seed_n,
       CAST(split_part(num_samples, '_', 1) AS INTEGER) AS n_samples,
       CAST(split_part(concat('C_0.0', split_part(seed, '_', 2)), '_', 2) AS DOUBLE) AS c_value
FROM result_scores"""))
def q_path_fields(spark, sf):
    r = _rs(spark, sf)
    return r.select("model", "dataset", R.path_field("seed", "seed").alias("seed_n"),
                    R.path_field("num_samples", "samples").alias("n_samples"),
                    R.path_field(F.concat(F.lit("C_0.0"), F.element_at(F.split("seed", "_"), 2)), "C").alias("c_value"))


# D2 ---------------------------------------------------------------------------
@register("headline_score", _rs_sql("""
SELECT model, dataset, seed, num_samples, round(CASE WHEN dataset_type = 'harmful' THEN f1 ELSE accuracy END, 6) AS score
FROM result_scores"""))
def q_headline_score(spark, sf):
    return _rs(spark, sf).select("model", "dataset", "seed", "num_samples", rnd(R.headline_score()).alias("score"))


# D3 ---------------------------------------------------------------------------
@register("mean_by_group", _rs_sql("""
SELECT model, CAST(split_part(num_samples, '_', 1) AS INTEGER) AS num_categories, dataset_type, round(avg(f1), 6) AS mean_score
FROM result_scores WHERE dataset = 'click' GROUP BY ALL"""))
def q_mean_by_group(spark, sf):
    r = _rs(spark, sf).where(F.col("dataset") == "click").withColumn(
        "num_categories", R.path_field("num_samples", "samples"))
    m = R.mean_by_group(r, ["model", "num_categories", "dataset_type"], "f1")
    return m.withColumn("mean_score", rnd("mean_score"))


# D4 ---------------------------------------------------------------------------
@register("mean_std_by_group", _rs_sql("""
SELECT seed AS combo, model, dataset_type, round(avg(f1), 6) AS mean, round(stddev_samp(f1), 6) AS std
FROM result_scores GROUP BY ALL"""))
def q_mean_std_by_group(spark, sf):
    r = _rs(spark, sf).withColumnRenamed("seed", "combo")
    m = R.mean_std_by_group(r, ["combo", "model", "dataset_type"], "f1")
    return m.select("combo", "model", "dataset_type", rnd("mean").alias("mean"), rnd("std").alias("std"))


# D5 ---------------------------------------------------------------------------
@register("layers_used", with_views("WITH " + _COEFS + """
SELECT model, C, CAST(sum(CASE WHEN abs(coefficient) > 1e-5 THEN 1 ELSE 0 END) AS INTEGER) AS layers_used
FROM coefs GROUP BY model, C""", "result_scores"))
def q_layers_used(spark, sf):
    return R.layers_used(_coefs(spark, sf), ["model", "C"])


# D6 ---------------------------------------------------------------------------
@register("f1_by_layers_used", with_views("WITH " + _COEFS + """,
lu AS (SELECT model, C, CAST(sum(CASE WHEN abs(coefficient) > 1e-5 THEN 1 ELSE 0 END) AS INTEGER) AS layers_used
       FROM coefs GROUP BY model, C)
SELECT r.model, lu.C, lu.layers_used, round(avg(r.f1), 6) AS mean_f1
FROM result_scores r JOIN lu ON r.model = lu.model AND r.dataset = lu.C
GROUP BY r.model, lu.C, lu.layers_used HAVING lu.layers_used >= 1""", "result_scores"))
def q_f1_by_layers_used(spark, sf):
    lu = R.layers_used(_coefs(spark, sf), ["model", "C"])
    r = _rs(spark, sf).withColumnRenamed("dataset", "C")
    j = r.join(lu, ["model", "C"])
    m = j.groupBy("model", "C", "layers_used").agg(F.avg("f1").alias("mean_f1")).where(F.col("layers_used") >= 1)
    return m.withColumn("mean_f1", rnd("mean_f1"))


# D7 ---------------------------------------------------------------------------
_D7_COLS = ", ".join(f"round(max(nv) FILTER (WHERE C = '{c}'), 6) AS \"{c}\"" for c in DATASETS)


@register("normalised_coefficients", with_views("WITH " + _COEFS + f""",
n AS (SELECT model, C, layer, CASE WHEN max(abs(coefficient)) OVER (PARTITION BY model, C) = 0 THEN 0.0
             ELSE abs(coefficient) / max(abs(coefficient)) OVER (PARTITION BY model, C) END AS nv FROM coefs)
SELECT model, layer, {_D7_COLS} FROM n GROUP BY model, layer""", "result_scores"))
def q_normalised_coefficients(spark, sf):
    n = R.normalised_coefficients(_coefs(spark, sf), ["model", "C"])
    wide = n.groupBy("model", "layer").pivot("C", DATASETS).agg(F.first("normalised"))
    return wide.select("model", "layer", *[rnd(c).alias(c) for c in DATASETS])


# D8 ---------------------------------------------------------------------------
@register("relative_layer", with_views("WITH " + _COEFS + """,
m AS (SELECT * FROM (VALUES ('model0', 32), ('model1', 32), ('model2', 40)) t(model, n))
SELECT coefs.model, C, layer, round(layer / n, 6) AS relative_layer FROM coefs JOIN m USING (model)""", "result_scores"))
def q_relative_layer(spark, sf):
    r = R.relative_layer(_coefs(spark, sf), N_LAYERS)
    return r.select("model", "C", "layer", rnd("relative_layer").alias("relative_layer"))


# D9 ---------------------------------------------------------------------------
@register("union_baseline", _rs_sql("""
SELECT model, dataset, seed, round(f1, 6) AS f1, NULL AS method FROM result_scores WHERE model <> 'model0'
UNION ALL SELECT model, dataset, NULL, round(f1, 6), 'baseline' FROM result_scores WHERE model = 'model0'"""))
def q_union_baseline(spark, sf):
    r = _rs(spark, sf)
    main = r.where(F.col("model") != "model0").select("model", "dataset", "seed", rnd("f1").alias("f1"))
    base = r.where(F.col("model") == "model0").select("model", "dataset", rnd("f1").alias("f1"),
                                                      F.lit("baseline").alias("method"))
    return R.union_all([main, base]).select("model", "dataset", "seed", "f1", "method")


# D10 --------------------------------------------------------------------------
@register("union_result_types", _rs_sql("""
SELECT model, dataset, dataset_type, seed, num_samples, round(f1, 6) AS f1 FROM result_scores"""))
def q_union_result_types(spark, sf):
    r = _rs(spark, sf).select("model", "dataset", "dataset_type", "seed", "num_samples", rnd("f1").alias("f1"))
    return R.union_all([r.where("dataset_type = 'harmful'"), r.where("dataset_type = 'non_harmful'")])


# D11 --------------------------------------------------------------------------
@register("melt", _rs_sql("""
SELECT model, dataset, seed, num_samples, 'f1' AS metric, round(f1, 6) AS value FROM result_scores
UNION ALL SELECT model, dataset, seed, num_samples, 'accuracy', round(accuracy, 6) FROM result_scores"""))
def q_melt(spark, sf):
    r = _rs(spark, sf)
    m = R.melt(r, ["model", "dataset", "seed", "num_samples"], ["f1", "accuracy"])
    return m.withColumn("value", rnd("value"))


# D12 --------------------------------------------------------------------------
@register("min_max_mean_rows", _rs_sql("""
WITH pm AS (SELECT model, dataset, avg(f1) AS f FROM result_scores GROUP BY ALL)
SELECT model, 'min' AS stat, round(min(f), 6) AS value FROM pm WHERE model <> 'model2' GROUP BY model
UNION ALL SELECT model, 'max', round(max(f), 6) FROM pm WHERE model <> 'model2' GROUP BY model
UNION ALL SELECT model, 'mean', round(avg(f), 6) FROM pm WHERE model <> 'model2' GROUP BY model
UNION ALL SELECT model, 'guard', round(avg(f), 6) FROM pm WHERE model = 'model2' GROUP BY model"""))
def q_min_max_mean_rows(spark, sf):
    pm = _rs(spark, sf).groupBy("model", "dataset").agg(F.avg("f1").alias("f"))
    rows = R.min_max_mean_rows(pm.where(F.col("model") != "model2"), "model", "f")
    guard = pm.where(F.col("model") == "model2").groupBy("model").agg(F.avg("f").alias("value")) \
        .withColumn("stat", F.lit("guard"))
    return R.union_all([rows, guard]).select("model", "stat", rnd("value").alias("value"))


# D13 --------------------------------------------------------------------------
_D13_PIV = ", ".join(f"avg(f1) FILTER (WHERE dataset = '{d}') AS \"{d}\"" for d in DATASETS)


@register("row_mean", _rs_sql(f"""
WITH w AS (SELECT model, seed, {_D13_PIV} FROM result_scores GROUP BY model, seed)
SELECT model, seed, round(({' + '.join(f'coalesce("{d}", 0)' for d in DATASETS)})
                          / ({' + '.join(f'CASE WHEN "{d}" IS NULL THEN 0 ELSE 1 END' for d in DATASETS)}), 6) AS row_mean
FROM w"""))
def q_row_mean(spark, sf):
    w = _rs(spark, sf).groupBy("model", "seed").pivot("dataset", DATASETS).agg(F.avg("f1"))
    return w.select("model", "seed", rnd(R.row_mean(DATASETS)).alias("row_mean"))


# D14 --------------------------------------------------------------------------
@register("ordered_category_sort", _rs_sql("""
SELECT dataset, CAST(list_position(['view', 'click', 'signup', 'purchase', 'error'], dataset) AS INTEGER) AS order_rank,
       round(avg(f1), 6) AS mean_f1
FROM result_scores GROUP BY dataset"""))
def q_ordered_category_sort(spark, sf):
    m = _rs(spark, sf).groupBy("dataset").agg(rnd(F.avg("f1")).alias("mean_f1"))
    return R.ordered_category_sort(m, "dataset", CATEGORY_ORDER).select("dataset", "order_rank", "mean_f1")


# D15 --------------------------------------------------------------------------
_NAME_SQL = "CASE model WHEN 'model0' THEN 'llama3_8b' WHEN 'model1' THEN 'llama3_8b_inst' ELSE 'mistral7b' END"


@register("pair_variants", _rs_sql(f"""
WITH n AS (SELECT {_NAME_SQL} AS name, dataset, seed, num_samples, f1 FROM result_scores)
SELECT regexp_replace(name, '_inst$', '') AS base_model, dataset, seed, num_samples,
       round(max(f1) FILTER (WHERE NOT ends_with(name, '_inst')), 6) AS pt,
       round(max(f1) FILTER (WHERE ends_with(name, '_inst')), 6) AS it
FROM n GROUP BY 1, 2, 3, 4"""))
def q_pair_variants(spark, sf):
    name = F.when(F.col("model") == "model0", "llama3_8b").when(F.col("model") == "model1", "llama3_8b_inst") \
        .otherwise("mistral7b")
    r = _rs(spark, sf).withColumn("name", name).withColumn("f1", rnd("f1"))
    return R.pair_variants(r, "name", ["dataset", "seed", "num_samples"], "f1")


# D16 --------------------------------------------------------------------------
@register("percent_and_rename", _rs_sql("""
WITH m AS (SELECT model, CASE WHEN dataset_type = 'harmful' THEN concat('Majority Vote ', dataset) ELSE dataset END AS method,
                  avg(f1) AS f FROM result_scores GROUP BY ALL)
SELECT model, CASE WHEN starts_with(method, 'Majority Vote ') THEN substr(method, 15) ELSE method END AS method,
       round(f * 100, 6) AS value_pct FROM m"""))
def q_percent_and_rename(spark, sf):
    r = _rs(spark, sf)
    method = F.when(F.col("dataset_type") == "harmful", F.concat(F.lit("Majority Vote "), F.col("dataset"))) \
        .otherwise(F.col("dataset"))
    m = r.groupBy("model", method.alias("method")).agg(F.avg("f1").alias("f"))
    v, n = R.percent_and_rename("f", "method")
    return m.select("model", n.alias("method"), rnd(v).alias("value_pct"))


# D17 --------------------------------------------------------------------------
@register("line_mean", _rs_sql("""
SELECT CAST(split_part(num_samples, '_', 1) AS INTEGER) AS x, model AS hue, round(avg(f1), 6) AS y
FROM result_scores GROUP BY 1, 2"""))
def q_line_mean(spark, sf):
    r = _rs(spark, sf).select(R.path_field("num_samples", "samples").alias("x"), F.col("model").alias("hue"), "f1")
    return R.mean_by_group(r, ["x", "hue"], "f1", "y").withColumn("y", rnd("y"))


# D18 --------------------------------------------------------------------------
@register("response_detection_rates", """
WITH m AS (SELECT unnest([0, 1, 2]) AS m),
r AS (SELECT concat('model', CAST(m.m AS VARCHAR)) AS model, l.toxic = 1 AS hq, (d.doc_id + m.m) % 3 <> 0 AS flagged,
             (d.doc_id * (m.m + 1)) % 4 = 0 AS hr
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id, m)
SELECT model, CAST(sum(CAST(hq AS INTEGER)) AS BIGINT) AS harmful_questions,
       CAST(sum(CAST(hq AND flagged AS INTEGER)) AS BIGINT) AS classified_correctly,
       CAST(sum(CAST(hq AND hr AS INTEGER)) AS BIGINT) AS harmful_responses,
       CAST(sum(CAST(hq AND flagged AND hr AS INTEGER)) AS BIGINT) AS both
FROM r GROUP BY model""")
def q_response_detection_rates(spark, sf):
    d = fx.table(spark, sf, "documents").join(fx.table(spark, sf, "labels"), "doc_id")
    r = d.withColumn("m", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        F.concat(F.lit("model"), F.col("m").cast("string")).alias("model"), (F.col("toxic") == 1).alias("hq"),
        ((F.col("doc_id") + F.col("m")) % 3 != 0).alias("flagged"), ((F.col("doc_id") * (F.col("m") + 1)) % 4 == 0).alias("hr"))
    return R.response_detection_rates(r, "model", "hq", "flagged", "hr")
