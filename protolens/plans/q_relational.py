"""Registered queries: filters (F1-F8) and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from protolens.operators import corpus as C
from protolens.plans.catalog import register
from protolens.plans.sqlparts import strip
from protolens.sources import fixtures as fx
from protolens.sources.fixtures import with_views


# F1 ---------------------------------------------------------------------------
@register("drop_null_labels", with_views("""
SELECT prompt_id, prompt_harmfulness FROM prompts WHERE prompt_harmfulness IS NOT NULL""", "prompts"))
def q_drop_null_labels(spark, sf):
    return C.drop_null_labels(fx.prompts(spark, sf), "prompt_harmfulness").select("prompt_id", "prompt_harmfulness")


# F2 ---------------------------------------------------------------------------
@register("user_messages_only", """
SELECT conv_id, turn FROM conversations WHERE role = 'user'""")
def q_user_messages_only(spark, sf):
    c = fx.table(spark, sf, "conversations")
    return C.user_messages_only(c, "role", "user").select("conv_id", "turn")


# F3 ---------------------------------------------------------------------------
@register("non_empty_prompt", f"""
SELECT doc_id FROM documents WHERE {strip('text')} <> ''""")
def q_non_empty_prompt(spark, sf):
    return C.non_empty(fx.table(spark, sf, "documents"), "text").select("doc_id")


# F4 ---------------------------------------------------------------------------
@register("isin_filter", with_views("""
SELECT prompt_id, lang FROM prompts WHERE lang IN ('en', 'de')""", "prompts"))
def q_isin_filter(spark, sf):
    return C.isin_filter(fx.prompts(spark, sf), "lang", ["en", "de"]).select("prompt_id", "lang")


# F5 ---------------------------------------------------------------------------
_F5_SRC = """
WITH r AS (SELECT conv_id, max(text) FILTER (WHERE turn = 1) AS r0, max(text) FILTER (WHERE turn = 3) AS r1
           FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, r0, r1, length(r0) % 2 = 0 AS s0, length(r1) % 2 = 0 AS s1 FROM r
      WHERE r0 IS NOT NULL AND r1 IS NOT NULL)"""


@register("discordant_pairs", _F5_SRC + """
SELECT conv_id, 0 AS which, r0 AS response, NOT s0 AS response_harmfulness FROM s WHERE s0 <> s1
UNION ALL SELECT conv_id, 1, r1, NOT s1 FROM s WHERE s0 <> s1""")
def q_discordant_pairs(spark, sf):
    c = fx.table(spark, sf, "conversations")
    r = c.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("r0"),
                                 F.max(F.when(F.col("turn") == 3, F.col("text"))).alias("r1"))
    r = r.where(F.col("r0").isNotNull() & F.col("r1").isNotNull())
    s = r.select("conv_id", "r0", "r1", (F.length("r0") % 2 == 0).alias("s0"), (F.length("r1") % 2 == 0).alias("s1"))
    return C.discordant_pairs(s, ["conv_id"], "r0", "r1", "s0", "s1")


# F6 ---------------------------------------------------------------------------
@register("annotated_only", """
SELECT doc_id FROM labels WHERE quality = 1""")
def q_annotated_only(spark, sf):
    return C.annotated_only(fx.table(spark, sf, "labels"), "quality").select("doc_id")


# F7 ---------------------------------------------------------------------------
@register("split_by_label", with_views("""
SELECT example_id, CASE WHEN label = 1 THEN 'positive' ELSE 'negative' END AS side FROM doc_vectors
WHERE label IN (0, 1)""", "doc_vectors"))
def q_split_by_label(spark, sf):
    pos, neg = C.split_by_label(fx.doc_vectors(spark, sf), "label")
    return pos.select("example_id", F.lit("positive").alias("side")).unionByName(
        neg.select("example_id", F.lit("negative").alias("side")))


# F8 ---------------------------------------------------------------------------
_MODEL_NAME_SQL = ("CASE model WHEN 'model0' THEN 'llama3_8b_inst' WHEN 'model1' THEN 'qwen3_8b' "
                   "ELSE 'mistral7b' END")


def _model_name():
    return F.when(F.col("model") == "model0", "llama3_8b_inst").when(F.col("model") == "model1", "qwen3_8b") \
        .otherwise("mistral7b")


@register("result_filter", with_views(f"""
SELECT {_MODEL_NAME_SQL} AS model, dataset, seed, CAST(split_part(num_samples, '_', 1) AS INTEGER) AS num_samples,
       round(f1, 6) AS f1
FROM result_scores
WHERE ({_MODEL_NAME_SQL} LIKE '%inst' OR contains({_MODEL_NAME_SQL}, 'qwen'))
  AND CAST(split_part(num_samples, '_', 1) AS INTEGER) >= 11 AND dataset = 'click'""", "result_scores"))
def q_result_filter(spark, sf):
    r = fx.result_scores(spark, sf).select(
        _model_name().alias("model"), "dataset", "seed",
        F.element_at(F.split("num_samples", "_"), 1).cast("int").alias("num_samples"), F.round("f1", 6).alias("f1"))
    return C.result_filter(r, "model", "num_samples", "click", min_samples=11)


# J1 ---------------------------------------------------------------------------
@register("redacted_lookup", with_views("""
WITH p AS (SELECT prompt_id, CASE WHEN prompt_id % 7 = 0 THEN 'REDACTED' ELSE prompt END AS prompt,
                  prompt_id + 1 AS ref FROM prompts)
SELECT p.prompt_id, CASE WHEN p.prompt = 'REDACTED' THEN d.text ELSE p.prompt END AS prompt,
       p.prompt = 'REDACTED' AND d.doc_id IS NULL AS missing
FROM p LEFT JOIN documents d ON p.ref = d.doc_id""", "prompts"))
def q_redacted_lookup(spark, sf):
    p = fx.prompts(spark, sf).select(
        "prompt_id", F.when(F.col("prompt_id") % 7 == 0, F.lit("REDACTED")).otherwise(F.col("prompt")).alias("prompt"),
        (F.col("prompt_id") + 1).alias("ref"))
    d = fx.table(spark, sf, "documents")
    return C.redacted_lookup(p, d, "prompt", "ref", "doc_id", "text").select("prompt_id", "prompt", "missing")


# J2 ---------------------------------------------------------------------------
@register("instruction_join", """
WITH ins AS (SELECT replace(concat('Python/', CAST(item_id % 25 AS VARCHAR)), 'Python', 'HumanEval') AS k,
                    arg_max(text, item_id) AS instruction FROM benchmark GROUP BY 1),
pr AS (SELECT doc_id, concat('HumanEval/', CAST(doc_id % 30 AS VARCHAR)) AS task_id FROM documents)
SELECT pr.doc_id, pr.task_id, ins.instruction FROM pr JOIN ins ON pr.task_id = ins.k""")
def q_instruction_join(spark, sf):
    b = fx.table(spark, sf, "benchmark").select(
        F.concat(F.lit("Python/"), (F.col("item_id") % 25).cast("string")).alias("ikey"),
        F.col("text").alias("instruction"), "item_id")
    pr = fx.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("HumanEval/"), (F.col("doc_id") % 30).cast("string")).alias("task_id"))
    return C.instruction_join(pr, b, "task_id", "ikey", "item_id").select("doc_id", "task_id", "instruction")


# J4 ---------------------------------------------------------------------------
@register("attach_response", """
WITH p AS (SELECT conv_id, arg_min(text, turn) AS prompt, arg_max(text, turn) AS response FROM conversations GROUP BY conv_id)
SELECT p.conv_id, p.prompt, p.response, l.toxic = 1 AS harmfulness_label FROM p JOIN labels l ON p.conv_id = l.doc_id""")
def q_attach_response(spark, sf):
    c = fx.table(spark, sf, "conversations")
    prompts = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"))
    gens = c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("response"))
    lab = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("conv_id"),
                                                (F.col("toxic") == 1).alias("harmfulness_label"))
    return C.attach_response(prompts, gens, lab, "conv_id")


# J5 ---------------------------------------------------------------------------
@register("key_set_check", with_views("""
WITH a AS (SELECT DISTINCT lang FROM documents), b AS (SELECT DISTINCT lang FROM prompts WHERE prompt_harmfulness IS NOT NULL)
SELECT count(*) FILTER (WHERE side = 'left') AS only_left, count(*) FILTER (WHERE side = 'right') AS only_right
FROM (SELECT 'left' AS side FROM a WHERE lang NOT IN (SELECT lang FROM b)
      UNION ALL SELECT 'right' FROM b WHERE lang NOT IN (SELECT lang FROM a))""", "prompts"))
def q_key_set_check(spark, sf):
    a = fx.table(spark, sf, "documents")
    b = fx.prompts(spark, sf).where(F.col("prompt_harmfulness").isNotNull())
    diff = C.key_set_check(a, b, "lang")
    return diff.agg(F.count(F.when(F.col("side") == "left", 1)).alias("only_left"),
                    F.count(F.when(F.col("side") == "right", 1)).alias("only_right"))


# J6 ---------------------------------------------------------------------------
@register("join_task_prompt", f"""
WITH pr AS (SELECT concat('src', CAST(item_id % 20 AS VARCHAR)) AS task_name, arg_max(text, item_id) AS cot_prompt
            FROM benchmark GROUP BY 1)
SELECT d.source AS task_name, d.doc_id, concat({strip('pr.cot_prompt')}, chr(10), chr(10), 'Q: ', d.text) AS instruction
FROM documents d JOIN pr ON d.source = pr.task_name""")
def q_join_task_prompt(spark, sf):
    # one prompt per task: the benchmark items are spread over the 20 task names, the last item wins
    pr = fx.table(spark, sf, "benchmark").groupBy(
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("task_name")) \
        .agg(F.max_by("text", "item_id").alias("cot_prompt"))
    inputs = fx.table(spark, sf, "documents").select(F.col("source").alias("task_name"), "doc_id", "text")
    j = C.join_task_prompt(inputs, pr, "task_name", "text", "cot_prompt")
    return j.select("task_name", "doc_id", "instruction")


# J9 ---------------------------------------------------------------------------
DISPLAY = {"model0": ("Llama3 8B", 32), "model1": ("Mistral 7B", 32)}


@register("display_name_map", with_views("""
WITH m AS (SELECT 'model0' AS k, 'Llama3 8B' AS display_name, 32 AS n_layers UNION ALL SELECT 'model1', 'Mistral 7B', 32)
SELECT r.model, r.dataset, r.seed, r.num_samples, m.display_name, coalesce(m.display_name, r.model) AS display_keep,
       CAST(m.n_layers AS INTEGER) AS n_layers
FROM result_scores r LEFT JOIN m ON r.model = m.k""", "result_scores"))
def q_display_name_map(spark, sf):
    r = fx.result_scores(spark, sf).select("model", "dataset", "seed", "num_samples")
    j = C.display_name_map(r, DISPLAY)
    return j.withColumn("display_keep", F.coalesce("display_name", "model"))


# J10 --------------------------------------------------------------------------
@register("contrastive_zip", with_views("""
WITH r AS (SELECT example_id, label, row_number() OVER (PARTITION BY label
             ORDER BY md5(concat(CAST(example_id AS VARCHAR), ':42')), example_id) AS rk FROM doc_vectors)
SELECT CAST(p.rk AS BIGINT) AS rank, p.example_id AS pos_id, n.example_id AS neg_id
FROM r p JOIN r n ON p.rk = n.rk AND p.label = 1 AND n.label = 0""", "doc_vectors"))
def q_contrastive_zip(spark, sf):
    return C.contrastive_zip(fx.doc_vectors(spark, sf), "example_id", "label")


# F9 ------------------------------------------------------------------------------
_WIDTH = 16  # of the vectors fixture
_EXTREMES = "[" + ", ".join(f"{{f}}(vector[{i}]) FILTER (WHERE drawn) OVER w" for i in range(1, _WIDTH + 1)) + "]"


def _uniform(what: str) -> str:
    """The number that a node's split draws from its path."""
    return f"CAST('0x' || substr(md5(concat(layer, '|', label, '|', tree, '|42|', path, '|{what}')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


def _average_path(n: str) -> str:
    return (f"CASE WHEN {n} <= 1 THEN 0.0::DOUBLE WHEN {n} = 2 THEN 1.0::DOUBLE ELSE "
            f"2.0::DOUBLE * (ln({n} - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * ({n} - 1.0::DOUBLE) / {n} END")


#: the split of the node where each row stands: sample size, extremes, feature and threshold
_SPLIT = f"""
SELECT layer, label, tree, example_id, vector, drawn, most, path, n,
       CASE WHEN n > 1 AND length(path) < most AND len(usable) > 0
            THEN usable[1 + CAST(floor({_uniform("feature")} * len(usable)) AS BIGINT)] END AS q, lo, hi
FROM (SELECT *, list_filter(range(1, {_WIDTH + 1}), lambda i: hi[i] > lo[i]) AS usable
      FROM (SELECT *, count(*) FILTER (WHERE drawn) OVER w AS n, {_EXTREMES.format(f="min")} AS lo, {_EXTREMES.format(f="max")} AS hi
            FROM {{src}} WINDOW w AS (PARTITION BY layer, label, tree, path)))"""

#: the same trees, every row carried down all levels at once (samples of classes up to 448 rows, which no prefilter thins)
F9_SQL = with_views(f"""
WITH s AS (SELECT example_id, layer, label, vector, CAST(tree AS INTEGER) AS tree,
       row_number() OVER (PARTITION BY layer, label, tree ORDER BY sha256(concat(example_id, ':', tree, ':42')), example_id) <= 256 AS drawn,
       least(256, count(*) OVER (PARTITION BY layer, label, tree)) AS psi
     FROM vectors, (SELECT unnest(range(100)) AS tree) WHERE layer <> 0),
start AS (SELECT layer, label, tree, example_id, vector, drawn, CAST(greatest(1, ceil(log2(greatest(psi, 2)))) AS BIGINT) AS most, '' AS path FROM s),
r AS ({_SPLIT.format(src="start")}
      UNION ALL
      {_SPLIT.format(src=f"""(SELECT layer, label, tree, example_id, vector, drawn, most, path || CASE WHEN vector[q] < lo[q] + {_uniform("threshold")} * (hi[q] - lo[q])
       THEN 'L' ELSE 'R' END AS path FROM r WHERE q IS NOT NULL)""")}),
h AS (SELECT layer, label, example_id, avg(length(path) + {_average_path("n")}) AS h FROM r WHERE q IS NULL GROUP BY layer, label, example_id),
o AS (SELECT example_id, layer, label, -pow(2.0::DOUBLE, -h / greatest({_average_path("psi")}, 1e-12)) AS score
      FROM h JOIN (SELECT DISTINCT layer, label, psi FROM s) USING (layer, label))
SELECT example_id, layer, label, round(score, 6) AS outlier_score, score >= -0.5 AS keep FROM o""", "vectors").replace("WITH ", "WITH RECURSIVE ", 1)


@register("outlier_filter", F9_SQL)
def q_outlier_filter(spark, sf):
    """Per (layer, class) isolation forests on the vector table; rows of every class scored by their own forest."""
    from protolens.operators import outliers as O
    from protolens.plans.common import layer_vectors

    v = layer_vectors(spark, sf).select("example_id", "layer", "label", "vector")
    forests = O.fit_forests(v, ["layer", "label"], n_trees=100, max_samples=256)
    s = O.outlier_scores(v, forests, ["layer", "label"])
    return s.select("example_id", "layer", "label", F.round("outlier_score", 6).alias("outlier_score"), "keep")
