"""Registered queries: sources (S1-S8) and sinks (K1-K7).

Each writes tables derived from the driver tables to a fresh folder below the
session's shared checkpoint folder (``spark.checkpoint.dir``) and reads them
back through the reader under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from protolens.functions import vec as V
from protolens.plans.catalog import register
from protolens.plans.q_meta import META_COEFFICIENTS_SQL
from protolens.plans.common import layer_vectors, long_array, rnd
from protolens.sources import fixtures as fx
from protolens.sources import readers as RD
from protolens.sources import sinks as SK
from protolens.sources.fixtures import with_views
from protolens.session import scratch_path


def _write_reference_layout(spark, sf) -> str:
    """Vector fixture as reference-style per-layer files: one folder per ``layer_{i}_hidden_states.parquet``."""
    v = fx.vectors(spark, sf)
    out = v.select(
        F.concat(F.lit("layer_"), F.col("layer").cast("string"), F.lit("_hidden_states.parquet")).alias("layer_file"),
        "example_id", F.col("label").cast("float").alias("labels"),
        F.transform("vector", lambda x: x.cast("float")).alias("hidden_state"))
    path = scratch_path(spark, "layer_vectors")
    out.write.mode("overwrite").partitionBy("layer_file").parquet(path)
    return path


# S1 ---------------------------------------------------------------------------
@register("read_layer_vectors", with_views("""
SELECT layer, 'last' AS pooling, example_id, CAST(label AS DOUBLE) AS labels,
       CAST(unnest(range(len(vector))) AS INTEGER) AS i, round(unnest(vector), 6) AS value FROM vectors""", "vectors"))
def q_read_layer_vectors(spark, sf):
    r = RD.read_layer_vectors(spark, _write_reference_layout(spark, sf))
    r = r.select("layer", "pooling", "example_id", F.col("labels").cast("double").alias("labels"),
                 V.to_double("hidden_state").alias("hidden_state"))
    return long_array(r, ["layer", "pooling", "example_id", "labels"], "hidden_state")


# S2 ---------------------------------------------------------------------------
@register("select_layers", with_views("""
SELECT layer, count(*) AS n, round(sum(list_sum(vector)), 6) AS total FROM vectors WHERE layer <> 0 GROUP BY layer""",
                                      "vectors"))
def q_select_layers(spark, sf):
    r = RD.select_layers(RD.read_layer_vectors(spark, _write_reference_layout(spark, sf)), exclude=(0,))
    return r.groupBy("layer").agg(F.count(F.lit(1)).alias("n"),
                                  rnd(F.sum(V.vsum(V.to_double("hidden_state")))).alias("total"))


# S3 ---------------------------------------------------------------------------
@register("scan_benchmarks", with_views("""
SELECT CASE WHEN prompt_harmfulness THEN 'harmful' ELSE 'non_harmful' END AS dataset_type, source AS dataset,
       count(*) AS n FROM prompts GROUP BY 1, 2""", "prompts"))
def q_scan_benchmarks(spark, sf):
    p = fx.prompts(spark, sf).withColumn(
        "dataset_type", F.when(F.col("prompt_harmfulness"), "harmful").otherwise("non_harmful")) \
        .withColumn("dataset", F.col("source"))
    root = scratch_path(spark, "benchmarks")
    p.write.mode("overwrite").partitionBy("dataset_type", "dataset").parquet(root)
    s = RD.scan_benchmarks(spark, root)
    return s.groupBy("dataset_type", "dataset").agg(F.count(F.lit(1)).alias("n"))


# S4 ---------------------------------------------------------------------------
_S4_LEVELS = ("model", "num_samples", "seed", "dataset_type", "dataset")


@register("scan_result_scores", with_views("""
SELECT model, num_samples, seed, dataset_type, dataset, 'f1' AS metric, round(f1, 6) AS value FROM result_scores
UNION ALL SELECT model, num_samples, seed, dataset_type, dataset, 'accuracy', round(accuracy, 6) FROM result_scores""",
                                           "result_scores"))
def q_scan_result_scores(spark, sf):
    """One flat score file per run folder model/num_samples/seed/type/dataset, scanned back in one read."""
    root = scratch_path(spark, "results")
    rs = fx.result_scores(spark, sf)
    files = rs.select(*_S4_LEVELS, F.to_json(F.struct("f1", "accuracy")).alias("value"))
    files.repartition(*_S4_LEVELS).write.mode("overwrite").partitionBy(*_S4_LEVELS).text(root)
    r = RD.scan_result_scores(spark, root, levels=_S4_LEVELS, file_glob="*.txt")
    return r.select(*_S4_LEVELS, "metric", rnd("value").alias("value"))


# S5 ---------------------------------------------------------------------------
@register("read_jsonl", """
SELECT doc_id, lang, source, n_chars, text FROM documents""")
def q_read_jsonl(spark, sf):
    root = scratch_path(spark, "jsonl")
    fx.table(spark, sf, "documents").write.mode("overwrite").option("compression", "gzip").json(root)
    return RD.read_jsonl(spark, root, "doc_id bigint, text string, lang string, source string, n_chars bigint") \
        .select("doc_id", "lang", "source", "n_chars", "text")


# S6 ---------------------------------------------------------------------------
@register("flatten_keyed_json", """
SELECT role AS key, conv_id, turn, text FROM conversations""")
def q_flatten_keyed_json(spark, sf):
    """One JSON object per conversation, {role: [records]}; a conversation is a bounded group."""
    c = fx.table(spark, sf, "conversations")
    per_role = c.groupBy("conv_id", "role").agg(F.collect_list(F.struct("conv_id", "turn", "text")).alias("recs"))
    obj = per_role.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "recs"))).alias("m"))
    root = scratch_path(spark, "keyed_json")
    obj.select(F.to_json("m").alias("value")).write.mode("overwrite").text(root)
    schema = T.StructType([T.StructField("m", T.MapType(T.StringType(), T.ArrayType(
        T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                      T.StructField("text", T.StringType())]))))])
    raw = spark.read.text(root).select(F.from_json("value", schema["m"].dataType).alias("m"))
    return RD.flatten_keyed_json(raw, "m", "key")


# S7 ---------------------------------------------------------------------------
@register("read_delimited", """
SELECT item_id, CASE WHEN item_id % 7 = 0 THEN '' ELSE text END AS text FROM benchmark""")
def q_read_delimited(spark, sf):
    b = fx.table(spark, sf, "benchmark").select(
        "item_id", F.when(F.col("item_id") % 7 == 0, F.lit("")).otherwise(F.col("text")).alias("text"))
    root = scratch_path(spark, "tsv")
    b.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(root)
    r = RD.read_delimited(spark, root, sep="\t", schema="item_id bigint, text string", multi_line=True)
    return r


# S8 ---------------------------------------------------------------------------
@register("read_two_row_header_csv", with_views("""
SELECT model AS id0, dataset_type, dataset, CAST(round(avg(f1), 6) AS VARCHAR) AS value FROM result_scores GROUP BY ALL""",
                                                "result_scores"))
def q_read_two_row_header_csv(spark, sf):
    rs = fx.result_scores(spark, sf)
    cells = rs.groupBy("model", "dataset_type", "dataset").agg(rnd(F.avg("f1")).cast("string").alias("v"))
    cols = sorted((r.dataset_type, r.dataset) for r in cells.select("dataset_type", "dataset").distinct().collect())
    wide = cells.withColumn("k", F.concat_ws("|", "dataset_type", "dataset")).groupBy("model") \
        .pivot("k", [f"{a}|{b}" for a, b in cols]).agg(F.first("v"))
    header = spark.createDataFrame([(0, "", *[a for a, _ in cols]), (1, "", *[b for _, b in cols])],
                                   ["_o", "model"] + [f"{a}|{b}" for a, b in cols])
    body = wide.withColumn("_o", F.lit(2)).select(header.columns)
    root = scratch_path(spark, "two_row_header")
    # one file so the two header lines come first (a small report table)
    header.unionByName(body).coalesce(1).sortWithinPartitions("_o", "model").drop("_o") \
        .write.mode("overwrite").option("header", "false").csv(root)
    return RD.read_two_row_header_csv(spark, root, id_cols=1)


# K1 ---------------------------------------------------------------------------
@register("write_layer_vectors", with_views("""
SELECT layer, 'last' AS pooling, count(*) AS n FROM vectors GROUP BY layer""", "vectors"))
def q_write_layer_vectors(spark, sf):
    v = fx.vectors(spark, sf).withColumn("pooling", F.lit("last"))
    path = scratch_path(spark, "vectors_by_layer")
    SK.write_layer_vectors(v, path)
    SK.write_layer_vectors(v.where("layer = 2"), path)  # replaces only the layer-2 partition
    back = spark.read.parquet(path)
    return back.groupBy("layer", "pooling").agg(F.count(F.lit(1)).alias("n"))


# K2 ---------------------------------------------------------------------------
@register("write_predictions", with_views("""
SELECT dataset_type, dataset, count(*) AS n FROM vectors WHERE layer <> 0 AND split = 'test' GROUP BY ALL""", "vectors"))
def q_write_predictions(spark, sf):
    from protolens.plans.q_metrics import scored

    s = scored(spark, sf).select("example_id", "layer", "dataset_type", "dataset", "probs", "label")
    path = scratch_path(spark, "predictions")
    SK.write_predictions(s, path)
    return spark.read.parquet(path).groupBy("dataset_type", "dataset").agg(F.count(F.lit(1)).alias("n"))


# K3 ---------------------------------------------------------------------------
def _k3_sql():
    from protolens.plans.q_metrics import _CONF
    from protolens.plans.sqlparts import vec_base

    return vec_base(_CONF + """
SELECT CASE WHEN dataset = 'ds2' THEN 'non_harmful' ELSE 'harmful' END AS dataset_type, dataset,
       concat('nmc_layer', CAST(layer AS VARCHAR)) AS method,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM cf""")


@register("write_scores", _k3_sql())
def q_write_scores(spark, sf):
    from protolens.operators import metrics as M
    from protolens.plans.q_metrics import scored

    s = scored(spark, sf).withColumn("method", F.concat(F.lit("nmc_layer"), F.col("layer").cast("string")))
    rec = M.binary_scores(s, ["dataset_type", "dataset", "method"], "score", "label")
    path = scratch_path(spark, "scores")
    SK.write_scores(rec, path)
    back = RD.scan_result_scores(spark, path, levels=("dataset_type", "dataset"), nested=True, file_glob="*.txt")
    return back.where(F.col("metric") == "f1").select("dataset_type", "dataset", "method", rnd("value").alias("f1"))


# K4 ---------------------------------------------------------------------------
@register("write_meta_coefficients", META_COEFFICIENTS_SQL)
def q_write_meta_coefficients(spark, sf):
    from protolens.plans.q_meta import q_meta_coefficients

    path = scratch_path(spark, "coefficients")
    SK.write_meta_coefficients(q_meta_coefficients(spark, sf), path)
    return spark.read.schema("layer int, coefficient double").json(path)


# K5 ---------------------------------------------------------------------------
def _k5_sql():
    from protolens.plans.q_contrast import _OD, _sql

    return _sql(_OD)


@register("load_directions", _k5_sql())
def q_load_directions(spark, sf):
    """K5 read side: directions written by ``save_directions`` and loaded for the requested layers."""
    from protolens.plans.q_contrast import _directions

    d, _ = _directions(spark, sf)
    path = scratch_path(spark, "directions_load")
    SK.save_directions(d, path)
    return long_array(SK.load_directions(spark, path, layers=[1, 2, 3]), ["layer"], "direction")


@register("save_directions", _k5_sql())
def q_save_directions(spark, sf):
    """Directions written as Parquet and read back; requesting a missing layer raises."""
    from protolens.plans.q_contrast import _directions

    d, _ = _directions(spark, sf)
    path = scratch_path(spark, "directions")
    SK.save_directions(d, path)
    back = SK.load_directions(spark, path, layers=[1, 2, 3])
    try:
        SK.load_directions(spark, path, layers=[1, 99])
        raise AssertionError("missing layer accepted")
    except ValueError:
        pass
    return long_array(back, ["layer"], "direction")


# K6 ---------------------------------------------------------------------------
@register("write_corpus", with_views("""
SELECT CASE WHEN prompt_harmfulness IS NULL THEN 'general_capabilities' ELSE 'harmfulness/prompt' END AS task,
       source AS dataset, count(*) AS n FROM prompts GROUP BY 1, 2""", "prompts"))
def q_write_corpus(spark, sf):
    p = fx.prompts(spark, sf).withColumn(
        "task", F.when(F.col("prompt_harmfulness").isNull(), "general_capabilities").otherwise("harmfulness/prompt")) \
        .withColumn("dataset", F.col("source"))
    path = scratch_path(spark, "corpus")
    SK.write_corpus(p, path)
    return spark.read.parquet(path).groupBy("task", "dataset").agg(F.count(F.lit(1)).alias("n"))


# K7 ---------------------------------------------------------------------------
@register("write_summary_csv", with_views("""
SELECT model, dataset_type, round(avg(f1), 6) AS mean_score FROM result_scores GROUP BY ALL""", "result_scores"))
def q_write_summary_csv(spark, sf):
    m = fx.result_scores(spark, sf).groupBy("model", "dataset_type").agg(rnd(F.avg("f1")).alias("mean_score"))
    path = scratch_path(spark, "summary_csv")
    SK.write_summary_csv(m, path)
    return spark.read.option("header", "true").schema("model string, dataset_type string, mean_score double").csv(path)
