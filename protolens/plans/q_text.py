"""Registered queries: message and prompt columns (T1-T18) over conversations, documents, benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from protolens.functions import templates as TPL
from protolens.functions import text as TX
from protolens.functions.labels import py_strip
from protolens.operators.metrics import prefix_sums
from protolens.operators.sampling import hash_order
from protolens.plans.catalog import register
from protolens.plans.q_corpus import _P11_SRC, _p11
from protolens.plans.sqlparts import fill_sql, lit, strip
from protolens.sources import fixtures as fx

SYSTEM_PROMPT = "You are a careful assistant."
SPECIAL_TOKENS = ["<s>", "</s>", "<pad>", "<unk>"]


def _long_messages(df, key, col="messages"):
    ex = df.select(key, F.posexplode(col).alias("pos", "m"))
    return ex.select(key, F.col("pos").cast("int").alias("pos"), F.col("m.role").alias("role"),
                     F.col("m.content").alias("content"))


def _conv_messages(spark, sf):
    return TX.messages_from_turns(fx.table(spark, sf, "conversations"), "conv_id")


_TURN01 = """
t0 AS (SELECT conv_id, text FROM conversations WHERE turn = 0),
t1 AS (SELECT conv_id, text FROM conversations WHERE turn = 1)"""


# T1 ---------------------------------------------------------------------------
@register("to_messages", f"""
WITH {_TURN01}
SELECT t0.conv_id, 0 AS pos, 'user' AS role, t0.text AS content FROM t0 JOIN t1 USING (conv_id)
UNION ALL SELECT t1.conv_id, 1, 'assistant', t1.text FROM t0 JOIN t1 USING (conv_id)""")
def q_to_messages(spark, sf):
    c = fx.table(spark, sf, "conversations")
    t0 = c.where("turn = 0").select("conv_id", F.col("text").alias("prompt"))
    t1 = c.where("turn = 1").select("conv_id", F.col("text").alias("response"))
    m = t0.join(t1, "conv_id").select("conv_id", TX.to_messages("prompt", "response").alias("messages"))
    return _long_messages(m, "conv_id")


# T2 ---------------------------------------------------------------------------
@register("messages_or_prompt", """
WITH has AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id AS doc_id, CAST(c.turn AS INTEGER) AS pos, c.role, c.text AS content FROM conversations c
  JOIN documents d ON d.doc_id = c.conv_id
UNION ALL
SELECT d.doc_id, 0, 'user', d.text FROM documents d WHERE d.doc_id NOT IN (SELECT conv_id FROM has)""")
def q_messages_or_prompt(spark, sf):
    d = fx.table(spark, sf, "documents")
    m = _conv_messages(spark, sf).withColumnRenamed("conv_id", "doc_id")
    j = d.join(m, "doc_id", "left").select("doc_id", TX.messages_or_prompt("messages", "text").alias("messages"))
    return _long_messages(j, "doc_id")


# T3 ---------------------------------------------------------------------------
@register("prompt_only", """
SELECT conv_id, arg_min(role, turn) AS role, arg_min(text, turn) AS content FROM conversations GROUP BY conv_id""")
def q_prompt_only(spark, sf):
    m = _conv_messages(spark, sf).select("conv_id", TX.prompt_only("messages").alias("m"))
    return m.select("conv_id", F.col("m")[0]["role"].alias("role"), F.col("m")[0]["content"].alias("content"))


# T4 ---------------------------------------------------------------------------
@register("prepend_system_prompt", f"""
SELECT conv_id, 0 AS pos, 'system' AS role, {lit(SYSTEM_PROMPT)} AS content FROM conversations GROUP BY conv_id
UNION ALL
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS pos, role, text FROM conversations""")
def q_prepend_system_prompt(spark, sf):
    m = _conv_messages(spark, sf).select("conv_id", TX.prepend_system_prompt("messages", SYSTEM_PROMPT).alias("messages"))
    return _long_messages(m, "conv_id")


# T5 ---------------------------------------------------------------------------
@register("append_response_turn", """
WITH g AS (SELECT conv_id, arg_max(text, turn) AS generation FROM conversations GROUP BY conv_id),
f AS (SELECT conv_id, arg_min(role, turn) AS role, arg_min(text, turn) AS content FROM conversations GROUP BY conv_id)
SELECT conv_id, 0 AS pos, role, content FROM f
UNION ALL SELECT conv_id, 1 AS pos, 'assistant' AS role, generation FROM g""")
def q_append_response_turn(spark, sf):
    c = fx.table(spark, sf, "conversations")
    gen = c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("generation"))
    base = _conv_messages(spark, sf).select("conv_id", TX.prompt_only("messages").alias("messages"))
    j = base.join(gen, "conv_id").select("conv_id", TX.append_response_turn("messages", "generation").alias("messages"))
    return _long_messages(j, "conv_id")


# T6 ---------------------------------------------------------------------------
@register("first_turn_instruction", f"""
SELECT conv_id, {strip('arg_min(text, turn)')} AS instruction FROM conversations GROUP BY conv_id""")
def q_first_turn_instruction(spark, sf):
    c = fx.table(spark, sf, "conversations")
    turns = c.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("turns"))
    return turns.select("conv_id", TX.first_turn_instruction("turns").alias("instruction"))


# T7 ---------------------------------------------------------------------------
@register("render_base_chat", """
SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id""")
def q_render_base_chat(spark, sf):
    return _conv_messages(spark, sf).select("conv_id", TX.render_base_chat("messages").alias("rendered"))


# T8, T9 -------------------------------------------------------------------------
_LAST = """
WITH lu AS (SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), '') AS u,
                   coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant'), '') AS a
            FROM conversations GROUP BY conv_id)"""

_T8_EXPR = ("concat(" + fill_sql(TPL.JUDGE_HEAD, bos="''", user="u") + ", CASE WHEN a <> '' THEN "
            + fill_sql(TPL.JUDGE_ASSISTANT_BLOCK, assistant="a") + " ELSE '' END, " + lit(TPL.JUDGE_TAIL) + ")")


@register("render_classifier_prompt", _LAST + f"""
SELECT conv_id, {_T8_EXPR} AS prompt FROM lu""")
def q_render_classifier_prompt(spark, sf):
    return _conv_messages(spark, sf).select("conv_id", TX.render_classifier_prompt("messages").alias("prompt"))


_T9_EXPR = ("concat(" + fill_sql(TPL.POLICY_HEAD, user="u") + ", CASE WHEN a <> '' THEN "
            + fill_sql(TPL.POLICY_ASSISTANT_BLOCK, assistant="a") + " ELSE '' END, " + lit(TPL.POLICY_TAIL) + ")")


@register("render_policy_prompt", _LAST + f"""
SELECT conv_id, {_T9_EXPR} AS prompt FROM lu""")
def q_render_policy_prompt(spark, sf):
    return _conv_messages(spark, sf).select(
        "conv_id", TX.render_policy_prompt("messages").alias("prompt"))


# T10 --------------------------------------------------------------------------
_T10_EXPR = fill_sql(TPL.MMLU_TEMPLATE, question="text", a="string_split(text, ' ')[1]", b="string_split(text, ' ')[2]",
                     c="string_split(text, ' ')[3]", d="string_split(text, ' ')[4]")


@register("render_task_template", f"""
SELECT item_id, {_T10_EXPR} AS prompt FROM benchmark""")
def q_render_task_template(spark, sf):
    b = fx.table(spark, sf, "benchmark")
    choices = F.slice(F.split("text", " "), 1, 4)
    return b.select("item_id", TX.render_task_template(F.col("text"), choices).alias("prompt"))


# T11 --------------------------------------------------------------------------
_T11_ONE = fill_sql(TPL.CLASSIFICATION_TEMPLATE, prompt="f.content")
_T11_PAIR = fill_sql(TPL.RESPONSE_CLASSIFICATION_TEMPLATE, prompt="f.content", response="s.content")


@register("wrap_classification_prompt", f"""
WITH f AS (SELECT conv_id, arg_min(text, turn) AS content, count(*) AS n FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, text AS content FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
      FROM conversations) WHERE rn = 2)
SELECT f.conv_id, 'prompt' AS mode, CAST(f.n AS INTEGER) AS n_messages, {_T11_ONE} AS content FROM f
UNION ALL
SELECT f.conv_id, 'pair' AS mode, 1 AS n_messages, {_T11_PAIR} AS content FROM f JOIN s USING (conv_id)""")
def q_wrap_classification_prompt(spark, sf):
    m = _conv_messages(spark, sf)
    one = m.select("conv_id", F.lit("prompt").alias("mode"),
                   TX.wrap_classification_prompt("messages", TPL.CLASSIFICATION_TEMPLATE).alias("w"))
    pair = m.select("conv_id", F.lit("pair").alias("mode"),
                    TX.wrap_classification_prompt("messages", TPL.RESPONSE_CLASSIFICATION_TEMPLATE, False).alias("w"))
    u = one.unionByName(pair)
    return u.select("conv_id", "mode", F.size("w").cast("int").alias("n_messages"),
                    F.col("w")[0]["content"].alias("content"))


# T12 --------------------------------------------------------------------------
_T12_EXPR = fill_sql(TPL.INSTRUCTION_FORMAT, prompt="prompt", response="response", harmful_request="prompt_harm_label",
                     refusal="response_refusal_label", harmful_response="response_harm_label")


@register("instruction_training_text", _P11_SRC + f"""
SELECT doc_id, {_T12_EXPR} AS text FROM n""")
def q_instruction_training_text(spark, sf):
    p = _p11(spark, sf)
    return p.select("doc_id", TX.instruction_training_text("prompt", "response", "prompt_harm_label",
                                                           "response_refusal_label", "response_harm_label").alias("text"))


# T13 --------------------------------------------------------------------------
@register("few_shot_prefix", f"""
WITH ex AS (SELECT item_id, text FROM benchmark
            ORDER BY md5(concat(CAST(item_id AS VARCHAR), ':42')), item_id LIMIT 3),
pre AS (SELECT concat({lit(TPL.FEW_SHOT_HEAD)},
                      string_agg(concat('Question: ', text, chr(10), 'Answer: ', text),
                                 chr(10) || chr(10) ORDER BY md5(concat(CAST(item_id AS VARCHAR), ':42')), item_id),
                      chr(10) || chr(10)) AS prefix FROM ex)
SELECT d.doc_id, concat(pre.prefix, 'Question: ', {strip('d.text')}) AS instruction FROM documents d, pre""")
def q_few_shot_prefix(spark, sf):
    b = fx.table(spark, sf, "benchmark")
    h = hash_order("item_id", 42)
    ex = b.withColumn("_h", h).orderBy("_h", "item_id").limit(3)  # n exemplars: the feature itself
    ex = ex.withColumn("_o", F.struct("_h", "item_id"))
    prefix = TX.few_shot_prefix(ex, "text", "text", "_o").first()["prefix"]  # n exemplars: bounded
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", F.concat(F.lit(prefix), F.lit("Question: "), py_strip("text")).alias("instruction"))


# T14 --------------------------------------------------------------------------
def _cot_prompt_spark(b):
    return F.concat(F.lit("Solve the task.\n\nQ: "), F.col("text"), F.lit("\nA: Let us think. So the answer is ("),
                    (F.col("item_id") % 4).cast("string"),
                    F.lit(").\n\nQ: Is the sky blue?\nA: It is daytime. So the answer is yes."))


_COT_SQL = ("concat('Solve the task.', chr(10), chr(10), 'Q: ', text, chr(10), 'A: Let us think. So the answer is (', "
            "CAST(item_id % 4 AS VARCHAR), ').', chr(10), chr(10), 'Q: Is the sky blue?', chr(10), "
            "'A: It is daytime. So the answer is yes.')")


@register("strip_cot", f"""
WITH p AS (SELECT item_id, {_COT_SQL} AS cot FROM benchmark),
b AS (SELECT item_id, unnest(string_split(cot, chr(10) || chr(10))) AS blk, generate_subscripts(string_split(cot, chr(10) || chr(10)), 1) AS k FROM p),
f AS (SELECT item_id, k, CASE WHEN starts_with(blk, 'Q:')
                         THEN concat({strip("string_split(blk, chr(10) || 'A:')[1]")}, chr(10), 'A: ',
                                     {strip("string_split(blk, 'So the answer is')[-1]")})
                         ELSE blk END AS blk FROM b)
SELECT item_id, string_agg(blk, chr(10) || chr(10) ORDER BY k) AS prompt FROM f GROUP BY item_id""")
def q_strip_cot(spark, sf):
    b = fx.table(spark, sf, "benchmark")
    return b.select("item_id", TX.strip_cot(_cot_prompt_spark(b)).alias("prompt"))


# T15 --------------------------------------------------------------------------
@register("cut_after_think", """
WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN concat('<think>', text, '</think> final answer') ELSE text END AS t
           FROM conversations)
SELECT conv_id, turn, concat(string_split(t, '</think>')[1], '</think>') AS cut FROM s""")
def q_cut_after_think(spark, sf):
    c = fx.table(spark, sf, "conversations")
    t = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("<think>"), F.col("text"), F.lit("</think> final answer"))) \
        .otherwise(F.col("text"))
    return c.select("conv_id", "turn", TX.cut_after_think(t).alias("cut"))


# T16 --------------------------------------------------------------------------
def _t16_sql():
    e = "concat('<s>', text, '</s>', CASE WHEN doc_id % 3 = 0 THEN '<pad><pad>' ELSE '' END, '<unk>')"
    for t in SPECIAL_TOKENS:
        e = f"replace({e}, '{t}', '{TX.neutral_form(t)}')"
    return e


@register("neutralise_special_tokens", f"""
SELECT doc_id, {_t16_sql()} AS cleaned FROM documents""")
def q_neutralise_special_tokens(spark, sf):
    d = fx.table(spark, sf, "documents")
    raw = F.concat(F.lit("<s>"), F.col("text"), F.lit("</s>"),
                   F.when(F.col("doc_id") % 3 == 0, F.lit("<pad><pad>")).otherwise(F.lit("")), F.lit("<unk>"))
    return d.select("doc_id", TX.neutralise_special_tokens(raw, SPECIAL_TOKENS).alias("cleaned"))


# T17 --------------------------------------------------------------------------
@register("suffix_expansion", f"""
WITH {_TURN01},
pairs AS (SELECT t0.conv_id, t0.text AS positive, t1.text AS negative FROM t0 JOIN t1 USING (conv_id)),
sfx AS (SELECT suffix, CAST(dense_rank() OVER (ORDER BY suffix) - 1 AS INTEGER) AS suffix_idx
        FROM (SELECT DISTINCT concat(' ', string_split(text, ' ')[1]) AS suffix FROM benchmark))
SELECT suffix_idx, conv_id, concat(positive, suffix) AS positive, concat(negative, suffix) AS negative
FROM pairs, sfx""")
def q_suffix_expansion(spark, sf):
    c = fx.table(spark, sf, "conversations")
    t0 = c.where("turn = 0").select("conv_id", F.col("text").alias("positive"))
    t1 = c.where("turn = 1").select("conv_id", F.col("text").alias("negative"))
    pairs = t0.join(t1, "conv_id")
    b = fx.table(spark, sf, "benchmark")
    sfx = b.select(F.concat(F.lit(" "), F.element_at(F.split("text", " "), 1)).alias("suffix")).distinct()
    ranked = prefix_sums(sfx.withColumn("one", F.lit(1).cast("long")), [], "suffix", ["one"])  # place in order, no global window
    sfx = ranked.select("suffix", (F.col("one_cum") - 1).cast("int").alias("suffix_idx"))
    return TX.suffix_expansion(pairs, sfx, "conv_id", "suffix_idx")


# T18 --------------------------------------------------------------------------
@register("rename_and_prune", """
SELECT item_id, text AS instruction FROM benchmark""")
def q_rename_and_prune(spark, sf):
    b = fx.table(spark, sf, "benchmark").withColumnRenamed("text", "Question").withColumn("source_col", F.lit("x"))
    return TX.rename_and_prune(b, {"Question": "instruction"}, ["item_id", "Question"])
