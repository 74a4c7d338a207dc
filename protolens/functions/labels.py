"""Label derivation as column expressions (survey P1-P16).

Each function returns a Column (or a small tuple of Columns) to be used in
one ``select`` over a whole corpus table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference).
# ---------------------------------------------------------------------------
MODERATION_FLAGS = ["S", "H", "V", "HR", "SH", "S3", "H2", "V2"]
HARM_CATEGORIES = [
    "benign",
    "others",
    "social_stereotypes_and_unfair_discrimination",
    "disseminating_false_or_misleading_information_encouraging_disinformation_campaigns",
    "sensitive_information_organization_government",
    "toxic_language_hate_speech",
    "violence_and_physical_harm",
    "private_information_individual",
    "defamation_encouraging_unethical_or_unsafe_actions",
    "fraud_assisting_illegal_activities",
    "sexual_content",
    "mental_health_over-reliance_crisis",
    "copyright_violations",
    "cyberattack",
    "causing_material_harm_by_disseminating_misinformation",
]
DATA_TYPE_LABELS = {
    "vanilla_benign": 0.0,
    "adversarial_benign": 0.0,
    "adversarial_harmful": 1.0,
    "vanilla_harmful": 1.0,
}
ANSWER_LETTERS = ["A", "B", "C", "D"]
LOW_CONFIDENCE = "low_confidence"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def majority_safe_vote(annotations, safe: str = "Safe") -> Column:
    """Harmful iff at most one annotator said ``safe``."""
    return F.size(F.filter(_c(annotations), lambda x: x == safe)) <= 1


def majority_harm_vote(*votes) -> Column:
    """Harmful iff more than one of the integer votes is 1 (sum > 1)."""
    total = F.lit(0)
    for v in votes:
        total = total + _c(v)
    return total > 1


def any_flag_with_list(flags: Sequence[str] = tuple(MODERATION_FLAGS)) -> tuple[Column, Column]:
    """(any flag == 1, names of the set flags in fixed order)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).alias("v")) for f in flags])
    harmful = F.exists(pairs, lambda p: p["v"] == 1)
    names = F.transform(F.filter(pairs, lambda p: p["v"].cast("boolean")), lambda p: p["name"])
    return harmful, names


def negated_safety_label(is_safe) -> Column:
    """harmful = not is_safe."""
    return ~_c(is_safe)


def constant_label(value) -> Column:
    """P5: every row of the set carries the same label."""
    return F.lit(value)


def truthy_label(col, training: bool = False) -> Column:
    """Toxic != 0 (evaluation) or toxic == 1 as 0/1 (training copy)."""
    c = _c(col)
    return (c == 1).cast("int") if training else (c != 0)


def top_scored_category(json_pairs, threshold: float = 0.5) -> Column:
    """Argmax of a list of [name, score] pairs (first wins on ties);
    ``low_confidence`` when the best score is below ``threshold``.

    Accepts JSON and the Python-repr form with single quotes or tuples (the
    reference ``eval``s the text); no code is evaluated.
    """
    text = F.translate(_c(json_pairs), "'()", '"[]')
    parsed = F.from_json(text, "array<array<string>>")
    items = F.transform(parsed, lambda p: F.struct(p[0].alias("name"), p[1].cast("double").alias("score")))
    first = F.try_element_at(items, F.lit(1))
    best = F.aggregate(F.slice(items, 2, F.greatest(F.size(items), F.lit(0))), first,
                       lambda acc, x: F.when(x["score"] > acc["score"], x).otherwise(acc))
    return F.when(best["score"] < threshold, F.lit(LOW_CONFIDENCE)).otherwise(best["name"])


def label_equals(col, value: str = "harmful") -> Column:
    """float(col == value); NULL counts as 0.0."""
    return F.coalesce((_c(col) == value).cast("double"), F.lit(0.0))


def prompt_type(adversarial, from_experiment: bool = False) -> Column:
    """P9: 'adversarial' / 'vanilla' from a flag, or from experiment != 'default'."""
    flag = (_c(adversarial) != "default") if from_experiment else _c(adversarial).cast("boolean")
    return F.when(flag, "adversarial").otherwise("vanilla")


def pick_prompt_variant(vanilla, adversarial, data_type) -> tuple[Column, Column]:
    """P10: empty adversarial text -> vanilla text; data_type -> 0/1 label."""
    text = F.when(_c(adversarial) == "", _c(vanilla)).otherwise(_c(adversarial))
    mapping = F.create_map(*[x for k, v in DATA_TYPE_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return text, mapping[_c(data_type)]


def normalise_yes_no(response, prompt_harm, refusal, response_harm) -> tuple[Column, ...]:
    """Missing response -> '' with 'N/A' response labels; then yes/no ('N/A' -> 'no')."""
    missing = _c(response).isNull()
    ref = F.when(missing, "N/A").otherwise(_c(refusal))
    harm = F.when(missing, "N/A").otherwise(_c(response_harm))

    def yn(c, positive):
        return F.when(c == positive, "yes").otherwise("no")

    return (F.coalesce(_c(response), F.lit("")), yn(_c(prompt_harm), "harmful"), yn(ref, "refusal"),
            yn(harm, "harmful"))


def category_map(spark, names: Sequence[str] = tuple(HARM_CATEGORIES)) -> DataFrame:
    """P12 mapping table: ordered names -> 0..K-1 (parameter-sized, broadcast)."""
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "category string, label int")


def category_to_id(df: DataFrame, col: str, names: Sequence[str] = tuple(HARM_CATEGORIES),
                   out: str = "label") -> DataFrame:
    """Broadcast left join; unknown names -> NULL."""
    m = category_map(df.sparkSession, names).withColumnRenamed("category", "_cat").withColumnRenamed("label", out)
    return df.join(F.broadcast(m), F.col(col) == F.col("_cat"), "left").drop("_cat")


def correct_answer_normalise(error_type, answer, correct_answer) -> Column:
    """P13: 'ok' -> letter of the int answer; 'wrong_groundtruth' -> letter of a digit answer; NULL = drop.

    Letter-corrected answers are dropped, as the reference's if/else does (Q15).
    """
    letters = F.array(*[F.lit(x) for x in ANSWER_LETTERS])
    ca = _c(correct_answer).cast("string")
    ok = F.try_element_at(letters, _c(answer).cast("int") + 1)  # out-of-range answers: NULL (row dropped)
    wrong = F.when(ca.isin("0", "1", "2", "3"), F.try_element_at(letters, ca.cast("int") + 1))
    return F.when(_c(error_type) == "ok", ok).when(_c(error_type) == "wrong_groundtruth", wrong)


def gsm_answer(text) -> tuple[Column, Column]:
    """Text after '####', stripped, digit-grouping commas removed; plus a numeric check (0 accepted)."""
    raw = F.try_element_at(F.split(_c(text), "####"), F.lit(2))  # no '####': NULL, not numeric
    ans = F.regexp_replace(py_strip(raw), r"(\d),(\d)", "$1$2")
    return ans, ans.try_cast("double").isNotNull()


def verdict_to_score(text) -> tuple[Column, Column]:
    """Stripped model text as a number; unparsable rows flagged (the reference raises)."""
    v = py_strip(_c(text)).try_cast("double")
    return v, v.isNull()


def py_strip(c) -> Column:
    """Whitespace strip on both ends (Python ``str.strip`` for ASCII whitespace)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def row_id(source: str, subset, index) -> Column:
    """P16: '{source}-{subset}-#{index}'."""
    return F.concat(F.lit(source.replace("/", "-") + "-"), _c(subset), F.lit("-#"), _c(index).cast("string"))
