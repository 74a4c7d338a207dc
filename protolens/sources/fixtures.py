"""Derived views that give the driver tables the shapes the operators consume.

Each view has a Spark builder and a DuckDB text twin (used by the SQL oracles
in ``plans.catalog``).  Both dialects compute the same rows; views are lazy
projections and joins over whole tables, so their cost grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _slices(emb: DataFrame, col_name: str) -> DataFrame:
    """One row per (vec_id, slice) with the 16-wide double slice of the embedding."""
    return emb.select("*", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias(col_name)).withColumn(
        "vector",
        F.transform(F.slice("embedding", F.col(col_name) * 16 + 1, 16), lambda x: x.cast("double")),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors(example_id, layer, label, category, split, dataset, dataset_type, vector)."""
    emb = table(spark, sf_dir, "embeddings")
    v = _slices(emb, "layer")
    vid = F.col("vec_id")
    return v.select(
        vid.alias("example_id"),
        F.col("layer").cast("int").alias("layer"),
        (F.col("label") % 2).cast("int").alias("label"),
        F.col("label").alias("category"),
        F.when(vid % 5 == 0, "test").otherwise("train").alias("split"),
        F.concat(F.lit("ds"), (vid % 3).cast("string")).alias("dataset"),
        F.when(vid % 3 == 2, "non_harmful").otherwise("harmful").alias("dataset_type"),
        "vector",
    )


def signal_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vectors`` with a label that they carry: the sign of the sum of the fifth entry of layers 1 to 3."""
    emb = table(spark, sf_dir, "embeddings")
    sign = sum((F.element_at("embedding", i).cast("double") for i in (21, 37, 53)), F.lit(0.0))
    own = emb.select(F.col("vec_id").alias("example_id"), (sign > 0).cast("int").alias("_sign"))
    return vectors(spark, sf_dir).join(own, "example_id").withColumn("label", F.col("_sign")).drop("_sign")


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_vectors(example_id, pos, mask, vector)."""
    emb = table(spark, sf_dir, "embeddings")
    v = _slices(emb, "pos")
    return v.select(
        F.col("vec_id").alias("example_id"),
        F.col("pos").cast("int").alias("pos"),
        F.when(F.col("pos") <= F.col("vec_id") % 4, 1).otherwise(0).alias("mask"),
        "vector",
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").alias("d")
    lab = table(spark, sf_dir, "labels").alias("l")
    j = d.join(lab, F.col("d.doc_id") == F.col("l.doc_id"), "left")
    return j.select(
        F.col("d.doc_id").alias("prompt_id"),
        F.trim(F.col("d.text")).alias("prompt"),
        F.col("d.lang").alias("lang"),
        F.col("d.source").alias("source"),
        (F.col("l.toxic") == 1).alias("prompt_harmfulness"),
        F.when(F.col("d.doc_id") % 4 == 0, "adversarial").otherwise("vanilla").alias("prompt_type"),
        F.array(
            F.when(F.col("l.toxic") == 1, "Toxic").otherwise("Safe"),
            F.when(F.col("l.quality") == 0, "Spam").otherwise("Safe"),
            F.when(F.col("d.n_chars") % 3 == 0, "Other").otherwise("Safe"),
        ).alias("annotations"),
    )


LETTERS = ["e", "t", "a", "o", "i", "n", "s", "r"]


def doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").alias("d")
    lab = table(spark, sf_dir, "labels").alias("l")
    j = d.join(lab, F.col("d.doc_id") == F.col("l.doc_id"), "inner")
    txt = F.col("d.text")
    return j.select(
        F.col("d.doc_id").alias("example_id"),
        F.col("l.toxic").alias("label"),
        F.col("d.lang").alias("category"),
        F.col("d.source").alias("dataset"),
        F.transform(
            F.array(*[F.lit(c) for c in LETTERS]),
            lambda c: (F.length(txt) - F.length(F.replace(txt, c, F.lit("")))).cast("double") / F.length(txt),
        ).alias("vector"),
    )


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    return conv.groupBy("conv_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: m["text"]), "\n"
        ).alias("rendered"),
        F.count(F.lit(1)).alias("n_turns"),
    )


def result_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    uid = F.col("user_id")
    g = ev.groupBy(
        F.concat(F.lit("model"), (uid % 3).cast("string")).alias("model"),
        F.col("event_type").alias("dataset"),
        F.when(F.col("event_type").isin("error", "click", "purchase"), "harmful")
        .otherwise("non_harmful")
        .alias("dataset_type"),
        F.concat(F.lit("seed_"), (uid % 5).cast("string")).alias("seed"),
        F.concat((F.lit(10) + uid % 4).cast("string"), F.lit("_samples")).alias("num_samples"),
    )
    return g.agg((F.avg("value") / 500).alias("f1"), (F.avg("value") / 400).alias("accuracy"))


# DuckDB twins of the views above (used as CTEs by the SQL oracles).
DUCK = {
    "vectors": """
SELECT vec_id AS example_id, CAST(layer AS INTEGER) AS layer, CAST(label % 2 AS INT) AS label, label AS category,
 CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
 concat('ds', CAST(vec_id % 3 AS VARCHAR)) AS dataset,
 CASE WHEN vec_id % 3 = 2 THEN 'non_harmful' ELSE 'harmful' END AS dataset_type,
 CAST(embedding[layer*16+1 : layer*16+16] AS DOUBLE[]) AS vector
FROM embeddings, (SELECT unnest([0,1,2,3]) AS layer) t""",
    "signal_vectors": """
SELECT vec_id AS example_id, CAST(layer AS INTEGER) AS layer,
 CAST(0.0::DOUBLE + embedding[21]::DOUBLE + embedding[37]::DOUBLE + embedding[53]::DOUBLE > 0 AS INT) AS label, label AS category,
 CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
 concat('ds', CAST(vec_id % 3 AS VARCHAR)) AS dataset,
 CASE WHEN vec_id % 3 = 2 THEN 'non_harmful' ELSE 'harmful' END AS dataset_type,
 CAST(embedding[layer*16+1 : layer*16+16] AS DOUBLE[]) AS vector
FROM embeddings, (SELECT unnest([0,1,2,3]) AS layer) t""",
    "token_vectors": """
SELECT vec_id AS example_id, CAST(pos AS INTEGER) AS pos, CASE WHEN pos <= vec_id % 4 THEN 1 ELSE 0 END AS mask,
 CAST(embedding[pos*16+1 : pos*16+16] AS DOUBLE[]) AS vector
FROM embeddings, (SELECT unnest([0,1,2,3]) AS pos) t""",
    "prompts": """
SELECT d.doc_id AS prompt_id, trim(d.text) AS prompt, d.lang, d.source, l.toxic = 1 AS prompt_harmfulness,
 CASE WHEN d.doc_id % 4 = 0 THEN 'adversarial' ELSE 'vanilla' END AS prompt_type,
 [CASE WHEN l.toxic = 1 THEN 'Toxic' ELSE 'Safe' END, CASE WHEN l.quality = 0 THEN 'Spam' ELSE 'Safe' END,
  CASE WHEN d.n_chars % 3 = 0 THEN 'Other' ELSE 'Safe' END] AS annotations
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "doc_vectors": """
SELECT d.doc_id AS example_id, l.toxic AS label, d.lang AS category, d.source AS dataset,
 list_transform(['e','t','a','o','i','n','s','r'], lambda c: CAST(length(d.text) - length(replace(d.text, c, '')) AS DOUBLE) / length(d.text)) AS vector
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "chats": """
SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS rendered, count(*) AS n_turns
FROM conversations GROUP BY conv_id""",
    "result_scores": """
SELECT concat('model', CAST(user_id % 3 AS VARCHAR)) AS model, event_type AS dataset,
 CASE WHEN event_type IN ('error','click','purchase') THEN 'harmful' ELSE 'non_harmful' END AS dataset_type,
 concat('seed_', CAST(user_id % 5 AS VARCHAR)) AS seed, concat(CAST(10 + user_id % 4 AS VARCHAR), '_samples') AS num_samples,
 avg(value) / 500 AS f1, avg(value) / 400 AS accuracy
FROM events GROUP BY 1, 2, 3, 4, 5""",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with DuckDB CTEs for the named views (in dependency order)."""
    ctes = ",\n".join(f"{n} AS ({DUCK[n]}\n)" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
