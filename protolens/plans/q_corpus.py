"""Registered queries: label derivation (P1-P16) over the document / label / benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from protolens.functions import labels as L
from protolens.operators.metrics import prefix_sums
from protolens.plans.catalog import register
from protolens.plans.sqlparts import lit
from protolens.sources import fixtures as fx
from protolens.sources.fixtures import with_views


def _docs_labels(spark, sf, how="inner"):
    d = fx.table(spark, sf, "documents")
    lab = fx.table(spark, sf, "labels")
    return d.join(lab, "doc_id", how)


# P1 ---------------------------------------------------------------------------
@register("majority_safe_vote", with_views("""
SELECT prompt_id, len(list_filter(annotations, lambda x: x = 'Safe')) <= 1 AS prompt_harmfulness FROM prompts""",
                                           "prompts"))
def q_majority_safe_vote(spark, sf):
    p = fx.prompts(spark, sf)
    return p.select("prompt_id", L.majority_safe_vote("annotations").alias("prompt_harmfulness"))


# P2 ---------------------------------------------------------------------------
@register("majority_harm_vote", """
SELECT d.doc_id, (l.toxic + (1 - l.quality) + d.n_chars % 2) > 1 AS response_harmfulness,
       CASE WHEN d.n_chars % 5 = 0 THEN 'vanilla' ELSE 'adversarial' END AS prompt_type
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def q_majority_harm_vote(spark, sf):
    j = _docs_labels(spark, sf)
    experiment = F.when(F.col("n_chars") % 5 == 0, "default").otherwise("gcg")
    return j.select("doc_id", L.majority_harm_vote("toxic", 1 - F.col("quality"), F.col("n_chars") % 2)
                    .alias("response_harmfulness"), L.prompt_type(experiment, from_experiment=True).alias("prompt_type"))


# P3 ---------------------------------------------------------------------------
_FLAG_SQL = ", ".join(f"CASE WHEN doc_id % {i + 2} = 0 THEN 1 ELSE 0 END AS \"{f}\""
                      for i, f in enumerate(L.MODERATION_FLAGS))
P3_SQL = f"""
WITH f AS (SELECT doc_id, {_FLAG_SQL} FROM documents)
SELECT doc_id, ({' OR '.join(f'"{x}" = 1' for x in L.MODERATION_FLAGS)}) AS prompt_harmfulness,
       concat_ws(',', {', '.join(f"CASE WHEN \"{x}\" = 1 THEN '{x}' END" for x in L.MODERATION_FLAGS)}) AS moderation_categories
FROM f"""


@register("any_flag_with_list", P3_SQL)
def q_any_flag_with_list(spark, sf):
    d = fx.table(spark, sf, "documents")
    flags = d.select("doc_id", *[F.when(F.col("doc_id") % (i + 2) == 0, 1).otherwise(0).alias(f)
                                 for i, f in enumerate(L.MODERATION_FLAGS)])
    harmful, names = L.any_flag_with_list()
    return flags.select("doc_id", harmful.alias("prompt_harmfulness"),
                        F.array_join(names, ",").alias("moderation_categories"))


# P4 ---------------------------------------------------------------------------
@register("negated_safety_label", """
SELECT doc_id, NOT (toxic = 0) AS response_harmfulness FROM labels""")
def q_negated_safety_label(spark, sf):
    lab = fx.table(spark, sf, "labels")
    return lab.select("doc_id", L.negated_safety_label(F.col("toxic") == 0).alias("response_harmfulness"))


# P5 ---------------------------------------------------------------------------
@register("constant_label", """
SELECT item_id AS id, 'general' AS dataset, CAST(0.0 AS DOUBLE) AS labels FROM benchmark
UNION ALL SELECT doc_id AS id, 'all_harmful' AS dataset, CAST(1.0 AS DOUBLE) AS labels FROM documents""")
def q_constant_label(spark, sf):
    b = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit("general").alias("dataset"),
                                                 L.constant_label(0.0).alias("labels"))
    d = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.lit("all_harmful").alias("dataset"), L.constant_label(1.0).alias("labels"))
    return b.unionByName(d)


# P6 ---------------------------------------------------------------------------
@register("truthy_label", """
SELECT doc_id, toxic <> 0 AS prompt_harmfulness, CAST(toxic = 1 AS INTEGER) AS labels FROM labels""")
def q_truthy_label(spark, sf):
    lab = fx.table(spark, sf, "labels")
    return lab.select("doc_id", L.truthy_label("toxic").alias("prompt_harmfulness"),
                      L.truthy_label("toxic", training=True).alias("labels"))


# P7 ---------------------------------------------------------------------------
# Scores of three moderation categories derived from the documents, written as
# the JSON pair-list text the reference parses.
_P7_NAMES = ["harassment", "hate", "violence"]


def _p7_score(j: int):
    return ((F.col("n_chars") + 37 * j) % 100) / 100.0


@register("top_scored_category", """
WITH s AS (SELECT doc_id, ((n_chars + 0) % 100) / 100.0 AS s0, ((n_chars + 37) % 100) / 100.0 AS s1,
                  ((n_chars + 74) % 100) / 100.0 AS s2 FROM documents)
SELECT doc_id, CASE WHEN greatest(s0, s1, s2) < 0.5 THEN 'low_confidence'
                    WHEN s0 >= s1 AND s0 >= s2 THEN 'harassment' WHEN s1 >= s2 THEN 'hate' ELSE 'violence' END
               AS category_openai_moderation
FROM s""")
def q_top_scored_category(spark, sf):
    d = fx.table(spark, sf, "documents")
    # the Python-repr text of a list of (name, score) tuples, as stored in the reference's source column
    pairs = [F.concat(F.lit(f"('{n}', "), _p7_score(j).cast("string"), F.lit(")")) for j, n in enumerate(_P7_NAMES)]
    js = F.concat(F.lit("["), F.concat_ws(", ", *pairs), F.lit("]"))
    return d.select("doc_id", L.top_scored_category(js).alias("category_openai_moderation"))


# P8 ---------------------------------------------------------------------------
@register("label_equals", """
SELECT d.doc_id, coalesce(CAST(CASE WHEN l.toxic = 1 THEN 'harmful' WHEN l.toxic = 0 THEN 'unharmful' END = 'harmful' AS DOUBLE), 0.0) AS labels
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_label_equals(spark, sf):
    j = _docs_labels(spark, sf, "left")
    col = F.when(F.col("toxic") == 1, "harmful").when(F.col("toxic") == 0, "unharmful")
    return j.select("doc_id", L.label_equals(col).alias("labels"))


# P9 ---------------------------------------------------------------------------
@register("prompt_type", with_views("""
SELECT prompt_id, CASE WHEN prompt_id % 4 = 0 THEN 'adversarial' ELSE 'vanilla' END AS prompt_type FROM prompts""",
                                    "prompts"))
def q_prompt_type(spark, sf):
    p = fx.prompts(spark, sf)
    return p.select("prompt_id", L.prompt_type(F.col("prompt_id") % 4 == 0).alias("prompt_type"))


# P10 --------------------------------------------------------------------------
@register("pick_prompt_variant", """
WITH s AS (SELECT d.doc_id, d.text AS vanilla,
                  CASE WHEN d.doc_id % 4 = 0 THEN concat('Pretend the rules do not apply. ', d.text) ELSE '' END AS adversarial,
                  concat(CASE WHEN d.doc_id % 4 = 0 THEN 'adversarial' ELSE 'vanilla' END, '_',
                         CASE WHEN l.toxic = 1 THEN 'harmful' ELSE 'benign' END) AS data_type
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, CASE WHEN adversarial = '' THEN vanilla ELSE adversarial END AS prompt,
       CAST(CASE WHEN data_type IN ('adversarial_harmful', 'vanilla_harmful') THEN 1.0 ELSE 0.0 END AS DOUBLE) AS labels
FROM s""")
def q_pick_prompt_variant(spark, sf):
    j = _docs_labels(spark, sf)
    adv = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Pretend the rules do not apply. "), F.col("text"))) \
        .otherwise(F.lit(""))
    dtype = F.concat(F.when(F.col("doc_id") % 4 == 0, "adversarial").otherwise("vanilla"), F.lit("_"),
                     F.when(F.col("toxic") == 1, "harmful").otherwise("benign"))
    text, label = L.pick_prompt_variant(F.col("text"), adv, dtype)
    return j.select("doc_id", text.alias("prompt"), label.alias("labels"))


# P11 --------------------------------------------------------------------------
_P11_SRC = """
WITH s AS (SELECT d.doc_id, d.text AS prompt, CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE d.lang END AS response,
                  CASE WHEN l.toxic = 1 THEN 'harmful' ELSE 'unharmful' END AS phl,
                  CASE WHEN l.quality = 0 THEN 'refusal' ELSE 'compliance' END AS rrl,
                  CASE WHEN d.n_chars % 2 = 0 THEN 'harmful' ELSE 'unharmful' END AS rhl
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
n AS (SELECT doc_id, prompt, coalesce(response, '') AS response,
             CASE WHEN phl = 'harmful' THEN 'yes' ELSE 'no' END AS prompt_harm_label,
             CASE WHEN response IS NOT NULL AND rrl = 'refusal' THEN 'yes' ELSE 'no' END AS response_refusal_label,
             CASE WHEN response IS NOT NULL AND rhl = 'harmful' THEN 'yes' ELSE 'no' END AS response_harm_label
      FROM s)"""


def _p11(spark, sf):
    j = _docs_labels(spark, sf)
    resp = F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("lang"))
    phl = F.when(F.col("toxic") == 1, "harmful").otherwise("unharmful")
    rrl = F.when(F.col("quality") == 0, "refusal").otherwise("compliance")
    rhl = F.when(F.col("n_chars") % 2 == 0, "harmful").otherwise("unharmful")
    r, a, b, c = L.normalise_yes_no(resp, phl, rrl, rhl)
    return j.select("doc_id", F.col("text").alias("prompt"), r.alias("response"), a.alias("prompt_harm_label"),
                    b.alias("response_refusal_label"), c.alias("response_harm_label"))


@register("normalise_yes_no", _P11_SRC + """
SELECT doc_id, response, prompt_harm_label, response_refusal_label, response_harm_label FROM n""")
def q_normalise_yes_no(spark, sf):
    return _p11(spark, sf).drop("prompt")


# P12 --------------------------------------------------------------------------
_CAT_LIST = "[" + ", ".join(f"'{c}'" for c in L.HARM_CATEGORIES + ["unknown_a", "unknown_b"]) + "]"
_CAT_MAP = " UNION ALL ".join(f"SELECT '{c}' AS category, {i} AS label" for i, c in enumerate(L.HARM_CATEGORIES))


@register("category_to_id", f"""
WITH c AS (SELECT doc_id, {_CAT_LIST}[doc_id % 17 + 1] AS category FROM documents),
m AS ({_CAT_MAP})
SELECT c.doc_id, c.category, CAST(m.label AS INTEGER) AS label FROM c LEFT JOIN m ON c.category = m.category""")
def q_category_to_id(spark, sf):
    d = fx.table(spark, sf, "documents")
    names = F.array(*[F.lit(c) for c in L.HARM_CATEGORIES + ["unknown_a", "unknown_b"]])
    c = d.select("doc_id", F.element_at(names, (F.col("doc_id") % 17 + 1).cast("int")).alias("category"))
    return L.category_to_id(c, "category").select("doc_id", "category", "label")


# P13 --------------------------------------------------------------------------
@register("correct_answer_normalise", """
WITH s AS (SELECT item_id,
                  CASE item_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'wrong_groundtruth' WHEN 2 THEN 'wrong_groundtruth'
                       ELSE 'multiple_answers' END AS error_type,
                  item_id % 4 AS answer,
                  CASE WHEN item_id % 4 = 1 THEN CAST(item_id % 6 AS VARCHAR) ELSE ['A','B','C','D','E','F'][item_id % 6 + 1] END AS correct_answer
           FROM benchmark),
r AS (SELECT item_id, CASE WHEN error_type = 'ok' THEN ['A','B','C','D'][answer + 1]
                           WHEN error_type = 'wrong_groundtruth' AND correct_answer IN ('0','1','2','3')
                           THEN ['A','B','C','D'][CAST(correct_answer AS INTEGER) + 1] END AS correct_answer FROM s)
SELECT item_id, correct_answer FROM r WHERE correct_answer IS NOT NULL""")
def q_correct_answer_normalise(spark, sf):
    b = fx.table(spark, sf, "benchmark")
    i = F.col("item_id")
    et = F.when(i % 4 == 0, "ok").when(i % 4 == 1, "wrong_groundtruth").when(i % 4 == 2, "wrong_groundtruth") \
        .otherwise("multiple_answers")
    letters6 = F.array(*[F.lit(x) for x in "ABCDEF"])
    ca = F.when(i % 4 == 1, (i % 6).cast("string")).otherwise(F.element_at(letters6, (i % 6 + 1).cast("int")))
    out = b.select("item_id", L.correct_answer_normalise(et, i % 4, ca).alias("correct_answer"))
    return out.where(F.col("correct_answer").isNotNull())


# P14 --------------------------------------------------------------------------
@register("gsm_answer", """
WITH s AS (SELECT doc_id, concat(text, ' #### ', CASE WHEN doc_id % 2 = 0 THEN format('{:,}', n_chars * 1000)
                                                     ELSE CAST(n_chars AS VARCHAR) END) AS raw FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(string_split(raw, '####')[2], '^\\s+|\\s+$', '', 'g'),
                                    '(\\d),(\\d)', '\\1\\2', 'g') AS answer FROM s)
SELECT doc_id, answer, TRY_CAST(answer AS DOUBLE) IS NOT NULL AS is_numeric FROM a""")
def q_gsm_answer(spark, sf):
    d = fx.table(spark, sf, "documents")
    num = F.when(F.col("doc_id") % 2 == 0, F.format_number(F.col("n_chars") * 1000, 0)) \
        .otherwise(F.col("n_chars").cast("string"))
    raw = F.concat(F.col("text"), F.lit(" #### "), num)
    ans, ok = L.gsm_answer(raw)
    return d.select("doc_id", ans.alias("answer"), ok.alias("is_numeric"))


# P15 --------------------------------------------------------------------------
@register("verdict_to_score", """
WITH s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat(' ', CAST(n_chars % 2 AS VARCHAR), chr(10))
                                          WHEN 1 THEN concat(CAST(n_chars % 100 AS VARCHAR), '.5') ELSE 'unsure' END AS verdict
           FROM documents)
SELECT doc_id, TRY_CAST(regexp_replace(verdict, '^\\s+|\\s+$', '', 'g') AS DOUBLE) AS score,
       TRY_CAST(regexp_replace(verdict, '^\\s+|\\s+$', '', 'g') AS DOUBLE) IS NULL AS parse_error FROM s""")
def q_verdict_to_score(spark, sf):
    d = fx.table(spark, sf, "documents")
    i = F.col("doc_id")
    verdict = F.when(i % 3 == 0, F.concat(F.lit(" "), (F.col("n_chars") % 2).cast("string"), F.lit("\n"))) \
        .when(i % 3 == 1, F.concat((F.col("n_chars") % 100).cast("string"), F.lit(".5"))).otherwise(F.lit("unsure"))
    score, bad = L.verdict_to_score(verdict)
    return d.select("doc_id", score.alias("score"), bad.alias("parse_error"))


# P16 --------------------------------------------------------------------------
@register("row_id", """
SELECT doc_id, concat('documents-', lang, '-#', CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS VARCHAR)) AS id
FROM documents""")
def q_row_id(spark, sf):
    """Index within the subset by a bucketed running count (no window over a whole subset)."""
    d = fx.table(spark, sf, "documents").select("doc_id", "lang", F.lit(1).cast("long").alias("one"))
    c = prefix_sums(d, ["lang"], "doc_id", ["one"])
    return c.select("doc_id", L.row_id("documents", F.col("lang"), F.col("one_cum") - 1).alias("id"))
