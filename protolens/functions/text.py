"""Message and prompt columns (survey T1-T18).

Messages are ``ARRAY<STRUCT<role STRING, content STRING>>``; every function
is a column expression over whole tables, or a small relational step where a
key join or a grouped turn table is needed.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protolens.functions import templates as TPL
from protolens.functions.labels import py_strip

MSG_TYPE = "array<struct<role:string,content:string>>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def message(role, content) -> Column:
    r = F.lit(role) if isinstance(role, str) and role in ("user", "assistant", "system") else _c(role)
    return F.struct(r.alias("role"), _c(content).alias("content"))


def to_messages(prompt, response=None) -> Column:
    """Prompt (and response) as a message array."""
    if response is None:
        return F.array(message("user", prompt))
    return F.array(message("user", prompt), message("assistant", response))


def messages_or_prompt(messages, prompt) -> Column:
    """Existing messages, else a one-turn array from the prompt."""
    return F.coalesce(_c(messages), to_messages(prompt))


def prompt_only(messages) -> Column:
    """Keep the first message."""
    return F.slice(_c(messages), 1, 1)


def prepend_system_prompt(messages, system_prompt: str) -> Column:
    """T4: system message in front."""
    return F.concat(F.array(message("system", F.lit(system_prompt))), _c(messages))


def append_response_turn(messages, response) -> Column:
    """T5: add an assistant turn with the generated text."""
    return F.concat(_c(messages), F.array(message("assistant", response)))


def first_turn_instruction(turns) -> Column:
    """Stripped first turn."""
    return py_strip(F.try_element_at(_c(turns), F.lit(1)))


def messages_from_turns(turns: DataFrame, key: str, order: str = "turn", role: str = "role",
                        text: str = "text") -> DataFrame:
    """Turn table -> one message array per conversation (a conversation is a bounded group)."""
    srt = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"),
                                               F.col(text).alias("content"))))
    return turns.groupBy(key).agg(
        F.transform(srt, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def render_base_chat(messages) -> Column:
    """Contents joined by a newline."""
    return F.array_join(F.transform(_c(messages), lambda m: m["content"]), "\n")


def _last_content(messages, role: str) -> Column:
    picked = F.filter(_c(messages), lambda m: m["role"] == role)
    return F.coalesce(F.try_element_at(picked, F.lit(-1))["content"], F.lit(""))


def render_classifier_prompt(messages, bos_token: str = "") -> Column:
    """Last user and last assistant message in the judge prompt (Q13);
    the assistant block is omitted when that text is empty."""
    user = _last_content(messages, "user")
    asst = _last_content(messages, "assistant")
    head = TPL.fill(TPL.JUDGE_HEAD, bos=bos_token, user=user)
    block = F.when(asst != "", TPL.fill(TPL.JUDGE_ASSISTANT_BLOCK, assistant=asst)).otherwise(F.lit(""))
    return F.concat(head, block, F.lit(TPL.JUDGE_TAIL))


def render_policy_prompt(messages) -> Column:
    """Same extraction, policy prompt."""
    user = _last_content(messages, "user")
    asst = _last_content(messages, "assistant")
    block = F.when(asst != "", TPL.fill(TPL.POLICY_ASSISTANT_BLOCK, assistant=asst)).otherwise(F.lit(""))
    return F.concat(TPL.fill(TPL.POLICY_HEAD, user=user), block, F.lit(TPL.POLICY_TAIL))


def render_task_template(question, choices, prompt_template: str | None = None) -> Column:
    """Multiple-choice prompt from a question and four choices (optionally wrapped)."""
    ch = _c(choices)
    def choice(i):  # a missing choice renders empty instead of failing the job
        return F.coalesce(F.try_element_at(ch, F.lit(i)), F.lit(""))

    body = TPL.fill(TPL.MMLU_TEMPLATE, question=_c(question), a=choice(1), b=choice(2), c=choice(3), d=choice(4))
    return body if prompt_template is None else TPL.fill(prompt_template, prompt=body)


def wrap_classification_prompt(messages, template: str, prompt_only_mode: bool = True) -> Column:
    """First message content substituted into ``template``; pairs keep the first message only."""
    m = _c(messages)
    first = F.element_at(m, 1)
    if prompt_only_mode:
        content = TPL.fill(template, prompt=first["content"])
        return F.concat(F.array(F.struct(first["role"].alias("role"), content.alias("content"))), F.slice(m, 2, F.size(m)))
    content = TPL.fill(template, prompt=first["content"], response=F.element_at(m, 2)["content"])
    return F.array(F.struct(first["role"].alias("role"), content.alias("content")))


def instruction_training_text(prompt, response, harmful_request, refusal, harmful_response) -> Column:
    """Judge prompt followed by the three yes/no answers."""
    return TPL.fill(TPL.INSTRUCTION_FORMAT, prompt=_c(prompt), response=_c(response),
                    harmful_request=_c(harmful_request), refusal=_c(refusal), harmful_response=_c(harmful_response))


def few_shot_prefix(exemplars: DataFrame, question: str, answer: str, order: str) -> DataFrame:
    """One-row table holding the prefix built from ``exemplars`` (a bounded table of n rows)."""
    demo = F.concat(F.lit("Question: "), F.col(question), F.lit("\nAnswer: "), F.col(answer))
    agg = exemplars.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), demo.alias("d")))).alias("ds"))
    return agg.select(
        F.when(F.size("ds") > 0, F.concat(F.lit(TPL.FEW_SHOT_HEAD),
                                          F.array_join(F.transform("ds", lambda x: x["d"]), "\n\n"), F.lit("\n\n")))
        .otherwise(F.lit(TPL.ZERO_SHOT_HEAD)).alias("prefix"))


def strip_cot(prompt) -> Column:
    """In every blank-line block starting with 'Q:', keep the question and the final answer."""
    blocks = F.split(_c(prompt), "\n\n")

    def fix(b):
        question = py_strip(F.substring_index(b, "\nA:", 1))
        answer = py_strip(F.substring_index(b, "So the answer is", -1))
        return F.when(b.startswith("Q:"), F.concat(question, F.lit("\nA: "), answer)).otherwise(b)

    return F.array_join(F.transform(blocks, fix), "\n\n")


def cut_after_think(text, tag: str = "</think>") -> Column:
    """Text up to the first closing tag, with the tag appended (also when absent)."""
    return F.concat(F.substring_index(_c(text), tag, 1), F.lit(tag))


#: places of a bar in a neutralised token: after its first character and before its last
_BARS = re.compile(r"(?<=\A.)(?=.)|(?<=.)(?=.\Z)", re.DOTALL)


def neutral_form(token: str) -> str:
    """A token that no longer reads as special: bars at ``_BARS``; one character becomes a space."""
    return _BARS.sub("|", token) if len(token) > 1 else " "


def neutralise_special_tokens(text, tokens: Sequence[str]) -> Column:
    """Replace each special token (in the given order) by its neutral form."""
    return functools.reduce(lambda c, t: F.replace(c, F.lit(t), F.lit(neutral_form(t))), filter(None, tokens), _c(text))


def suffix_expansion(pairs: DataFrame, suffixes: DataFrame, pair_order: str, suffix_order: str,
                     positive: str = "positive", negative: str = "negative") -> DataFrame:
    """Every pair with every suffix, suffix-major.  ``suffixes`` has ``suffix`` or (``pos_suffix``,
    ``neg_suffix``) columns and ``suffix_order`` = 0 .. n - 1.

    A generator gives each pair the n suffix numbers; the texts join on the number, broadcast when the
    suffix table is measured small and through a salted shuffle otherwise."""
    from protolens.operators.params import attach_params

    tup = "pos_suffix" in suffixes.columns
    table = suffixes.select(F.col(suffix_order), F.col("pos_suffix" if tup else "suffix").alias("_ps"),
                            F.col("neg_suffix" if tup else "suffix").alias("_ns"))
    n = suffixes.count()
    kind = suffixes.schema[suffix_order].dataType.simpleString()
    numbers = F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array()
    each = pairs.select("*", F.explode(numbers.cast(f"array<{kind}>")).alias(suffix_order))
    j = attach_params(each, table, [suffix_order])
    return j.select(F.col(suffix_order), F.col(pair_order), F.concat(F.col(positive), F.col("_ps")).alias("positive"),
                    F.concat(F.col(negative), F.col("_ns")).alias("negative"))


def rename_and_prune(df: DataFrame, renames: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """Keep columns, renaming on the way."""
    return df.select(*[F.col(c).alias(renames.get(c, c)) for c in keep])
