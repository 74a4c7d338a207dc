"""Relational corpus steps: filters (F1-F8) and joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolens.functions.labels import py_strip
from protolens.operators.params import attach_params
from protolens.operators.sampling import hash_order, rank_cut


# ---------------------------------------------------------------- filters
def drop_null_labels(df: DataFrame, label: str, response: str | None = None) -> DataFrame:
    """label (and response) not null."""
    return df.dropna(subset=[label] + ([response] if response else []))


def user_messages_only(df: DataFrame, col: str = "text_type", value: str = "user_message") -> DataFrame:
    """F2."""
    return df.where(F.col(col) == value)


def non_empty(df: DataFrame, col) -> DataFrame:
    """stripped content is not empty."""
    c = F.col(col) if isinstance(col, str) else col
    return df.where(py_strip(c) != "")


def isin_filter(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """membership in a parameter set (``isin`` is a hash-set probe inside the scan stage)."""
    return df.where(F.col(col).isin(list(values)))


def discordant_pairs(df: DataFrame, keys: Sequence[str], r0: str, r1: str, safe0: str, safe1: str) -> DataFrame:
    """rows whose two responses differ in safety, unpivoted to (keys, which, response, response_harmfulness)."""
    keys = list(keys)
    d = df.where(F.col(safe0) != F.col(safe1))
    stacked = F.inline(F.array(
        F.struct(F.lit(0).alias("which"), F.col(r0).alias("response"), (~F.col(safe0)).alias("response_harmfulness")),
        F.struct(F.lit(1).alias("which"), F.col(r1).alias("response"), (~F.col(safe1)).alias("response_harmfulness")),
    ))
    return d.select(*keys, stacked)


def annotated_only(df: DataFrame, col: str) -> DataFrame:
    """truthy annotation flag."""
    return df.where(F.col(col).cast("boolean"))


def split_by_label(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(positives, negatives)."""
    return df.where(F.col(label) == 1), df.where(F.col(label) == 0)


def result_filter(df: DataFrame, model: str = "model", num_samples: str = "num_samples", dataset: str | None = None,
                  min_samples: int = 10, dataset_col: str = "dataset") -> DataFrame:
    """F8: instruct or qwen models, enough samples, optionally one dataset."""
    m = F.col(model)
    cond = (m.endswith("inst") | m.contains("qwen")) & (F.col(num_samples) >= min_samples)
    if dataset is not None:
        cond = cond & (F.col(dataset_col) == dataset)
    return df.where(cond)


# ---------------------------------------------------------------- joins
def redacted_lookup(df: DataFrame, texts: DataFrame, prompt: str, ref_id: str, text_id: str, text: str,
                    marker: str = "REDACTED") -> DataFrame:
    """Redacted prompts replaced by the text looked up by id; ``missing`` marks failed lookups."""
    t = texts.select(F.col(text_id).alias("_tid"), F.col(text).alias("_ttext"))
    j = df.join(t, F.col(ref_id) == F.col("_tid"), "left")
    red = F.col(prompt) == marker
    return j.withColumn("missing", red & F.col("_tid").isNull()) \
        .withColumn(prompt, F.when(red, F.col("_ttext")).otherwise(F.col(prompt))).drop("_tid", "_ttext")


def instruction_join(df: DataFrame, instructions: DataFrame, key: str, ikey: str, order: str,
                     rewrite: tuple[str, str] = ("Python", "HumanEval")) -> DataFrame:
    """Inner join on the rewritten key; for duplicate keys the last row (by ``order``) wins."""
    rk = F.replace(F.col(ikey), F.lit(rewrite[0]), F.lit(rewrite[1]))
    last = instructions.withColumn("_k", rk).groupBy("_k").agg(F.max_by(F.struct(*instructions.columns),
                                                                          F.col(order)).alias("_ins"))
    j = attach_params(df.withColumn("_k", F.col(key)), last, ["_k"])  # one row per key, measured
    return j.select(*df.columns, "_ins.*").drop(ikey, order)


def attach_response(prompts: DataFrame, generations: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Prompt, generated response and label assembled into one record by equi joins on ``key``."""
    return prompts.join(generations, key).join(labels, key)


def key_set_check(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys only in ``a`` / only in ``b`` (two anti joins); equal sets give zero rows."""
    ka, kb = a.select(key).distinct(), b.select(key).distinct()
    only_a = ka.join(kb, key, "left_anti").withColumn("side", F.lit("left"))
    only_b = kb.join(ka, key, "left_anti").withColumn("side", F.lit("right"))
    return only_a.unionByName(only_b)


def join_task_prompt(inputs: DataFrame, prompts: DataFrame, task: str, inp: str, prompt: str) -> DataFrame:
    """Every task input with its task's prompt (prompts: one per task, a bounded table)."""
    j = attach_params(inputs, prompts, [task])
    return j.withColumn("instruction", F.concat(py_strip(prompt), F.lit("\n\nQ: "), F.col(inp)))


def display_name_map(df: DataFrame, mapping: Mapping[str, tuple[str, int]], col: str = "model",
                     keep_unmapped: bool = False) -> DataFrame:
    """Model id -> (display name, layer count); unmapped -> NULL or kept."""
    spark = df.sparkSession
    m = spark.createDataFrame([(k, v[0], int(v[1])) for k, v in mapping.items()],
                              "_mk string, display_name string, n_layers int")
    j = df.join(F.broadcast(m), F.col(col) == F.col("_mk"), "left").drop("_mk")
    if keep_unmapped:
        j = j.withColumn("display_name", F.coalesce("display_name", F.col(col)))
    return j


def contrastive_zip(df: DataFrame, id_col: str, label: str = "label", seed: int = 42) -> DataFrame:
    """I-th positive with i-th negative in seeded hash order (rank by bucketed windows, join on rank)."""
    h = df.withColumn("_h", hash_order(id_col, seed))
    ranked = rank_cut(h, [label], "_h", id_col, None, "rank")  # every row ranked, no cut
    pos = ranked.where(F.col(label) == 1).select("rank", F.col(id_col).alias("pos_id"))
    neg = ranked.where(F.col(label) == 0).select("rank", F.col(id_col).alias("neg_id"))
    return pos.join(neg, "rank")
