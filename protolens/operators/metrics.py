"""Classification metrics grouped by (model, method, dataset...) (survey M1-M15).

Counting metrics are one grouped aggregation.  Ranking metrics (ROC AUC,
average precision) first collapse rows to one row per distinct score and
group (map-side combined), then need counts below each score.  A window
partitioned only by the group would put a hot group (one dataset may hold a
third of all rows) into one task, so counts are cumulated over score bins and
only inside the bins that hold a positive over rows.  ``prefix_sums`` gives
running sums of any order in the same spirit, over contiguous ranges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protolens.functions import vec as V
from protolens.operators.params import attach_params, materialize

DEFAULT_BUCKETS = None  # ranges sized from the row count (ROWS_PER_RANGE rows each)


def _k(keys) -> list[str]:
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


# ---------------------------------------------------------------- M1, M12, M13, M14
def threshold_predict(scores: Column, width: int | None = None) -> Column:
    """M1: 1 or 2 columns -> positive score > 0.5; more columns -> argmax."""
    if width is None or width <= 2:
        pos = scores if width is None else (scores if width == 1 else F.element_at(scores, 2))
        return (pos > 0.5).cast("int")
    return V.argmax(scores)


def binarize_multiclass(pred: Column) -> Column:
    """Any class id >= 1 is harmful."""
    return (pred >= 1).cast("int")


def collapse_positive_ids(pred: Column, probs: Column, ids: Sequence[int]) -> tuple[Column, Column]:
    """Prediction in ``ids``; score = sum of the probabilities at ``ids``."""
    arr = F.array(*[F.lit(int(i)) for i in ids])
    pred_c = F.array_contains(arr, pred).cast("int")
    score = V.vsum(F.filter(probs, lambda x, i: F.array_contains(arr, i)))
    return pred_c, score


def collapse_dataset_protos(probs: Column) -> tuple[Column, Column]:
    """Argmax mod 2 = 1 is harmful; score = sum of odd columns."""
    return (V.argmax(probs) % 2 == 1).cast("int"), V.odd_sum(probs)


# ---------------------------------------------------------------- M2-M6
def confusion_counts(df: DataFrame, keys, pred: str = "pred", label: str = "label") -> DataFrame:
    """M2/M6: tn, fp, fn, tp and supports per group."""
    keys = _k(keys)
    p, y = F.col(pred), F.col(label)

    def c(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    return df.groupBy(*keys).agg(
        c((y == 0) & (p == 0)).alias("tn"),
        c((y == 0) & (p == 1)).alias("fp"),
        c((y == 1) & (p == 0)).alias("fn"),
        c((y == 1) & (p == 1)).alias("tp"),
        F.avg((p == y).cast("double")).alias("accuracy"),
    )


def counting_metrics(conf: DataFrame) -> DataFrame:
    """M3-M6 from confusion counts (0 when undefined, as the reference)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return conf.select(
        "*",
        F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0)).alias("f1"),
        F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0)).alias("true_positive_rate"),
        F.when(tn + fp > 0, tn / (tn + fp)).otherwise(F.lit(0.0)).alias("true_negative_rate"),
        (tn + fp).alias("negative_support"),
        (tp + fn).alias("positive_support"),
    )


# ---------------------------------------------------------------- prefix sums
ROWS_PER_RANGE = 1_000_000


def prefix_sums(df: DataFrame, keys, order: str, cols: Sequence[str], buckets: int | None = None,
                descending: bool = False, suffix: str = "_cum", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Inclusive running sums of ``cols`` per group in ``order``, with no task holding a whole group.

    ``df`` has one row per (keys, order) value.  Rows are range-partitioned on
    (keys, order) into ``buckets`` partitions (default: rows / ``rows_per_range``),
    so a hot group is spread over many contiguous ranges.  Each range is
    sorted and cumulated in one streaming pass (``mapInPandas``); the ranged
    table is written once so both of its uses see the same ranges; per-range
    totals (a #groups x #ranges table) give each range its offset.
    """
    keys = _k(keys)
    cols = list(cols)
    spark = df.sparkSession
    if not keys:
        df = df.withColumn("_pk_all", F.lit(0))
        keys = ["_pk_all"]
    if buckets is None:
        n = df.count()
        buckets = max(1, -(-n // max(1, rows_per_range)))
    o = F.col(order).desc() if descending else F.col(order).asc()
    ranged = df.repartitionByRange(int(buckets), *[F.col(k) for k in keys], o) \
        .sortWithinPartitions(*[F.col(k) for k in keys], o).withColumn("_range", F.spark_partition_id())
    # sums of whole numbers are 64-bit whatever the input's width
    kind = {c: T.DoubleType() if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else T.LongType() for c in cols}
    out_schema = T.StructType(ranged.schema.fields + [T.StructField(c + "_loc", kind[c]) for c in cols])

    def cumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry: dict = {}  # running sums per group across the batches of one sorted range
        for pdf in batches:
            if pdf.empty:
                yield pdf.assign(**{c + "_loc": pdf[c] for c in cols})
                continue
            g = pdf.groupby(keys, sort=False, dropna=False)
            loc = pdf[cols].astype({c: "float64" if isinstance(kind[c], T.DoubleType) else "int64" for c in cols})
            loc = loc.groupby([pdf[k] for k in keys], sort=False, dropna=False).cumsum()
            if carry:  # only a batch's first group can have begun before it; the batch is sorted by group
                first = tuple(pdf[keys].iloc[0])
                if first in carry:
                    rows = g.ngroup() == g.ngroup().iloc[0]
                    loc.loc[rows] = loc.loc[rows] + carry[first]
                carry = {}
            last = pdf[keys].assign(**{c: loc[c] for c in cols}).groupby(keys, sort=False, dropna=False).last()
            for k, row in last.iterrows():
                carry[k if isinstance(k, tuple) else (k,)] = [row[c] for c in cols]
            yield pdf.assign(**{c + "_loc": loc[c] for c in cols})

    local = materialize(ranged.mapInPandas(cumulate, out_schema))
    totals = local.groupBy(*keys, "_range").agg(*[F.sum(c).alias(c + "_rt") for c in cols])
    wr = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_range",
                            *[F.coalesce(F.sum(c + "_rt").over(wr), F.lit(0)).alias(c + "_off") for c in cols])
    j = attach_params(local, offsets, keys + ["_range"], uniform_keys=True)  # one row per (group, range)
    out = j.select(*[F.col(c) for c in df.columns],
                   *[(F.col(c + "_loc") + F.col(c + "_off")).cast(kind[c]).alias(c + suffix)
                     for c in cols])
    return out.drop("_pk_all") if "_pk_all" in out.columns else out


def score_table(df: DataFrame, keys, score: str = "score", label: str = "label") -> DataFrame:
    """One row per (group, distinct score) with positive / negative counts."""
    keys = _k(keys)
    y = F.col(label)
    return df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(y == 1, 0).otherwise(1)).cast("long").alias("neg"),
    )


# ---------------------------------------------------------------- M7, M8
#: score bins of a group
BINS = 256


def ranking_metrics(table: DataFrame, keys, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """M7 + M8 from a (keys, score, pos, neg) table in two passes: counts by bin, then ranks inside bins.

    Bins are cut at approximate quantiles of each group's scores (they decide the balance, not the result), their counts
    are cumulated, and only rows of bins that hold a positive are ordered, within their bin: no range sort of all rows
    and no task with a whole group.

    ROC AUC = sum pos(s) * (negatives below s + neg(s) / 2) / (P N)   (ties count 1/2)
    AP      = sum pos(s) / P * TP(>= s) / ALL(>= s) over distinct thresholds, descending,
    where the counts at or above s are totals minus the ascending sums below s.
    Both are NULL for a group with one class.
    """
    keys = _k(keys)
    whole = not keys
    if whole:
        table, keys = table.withColumn("_all", F.lit(0)), ["_all"]
    shares = [i / BINS for i in range(1, BINS)]
    groups = materialize(table.groupBy(*keys).agg(
        F.percentile_approx("score", shares, 10 * BINS).alias("_edges"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n")))
    bin_ = F.size(F.filter("_edges", lambda e: e < F.col("score")))
    rows = attach_params(table, groups, keys, materialized=True).withColumn("_bin", bin_).drop("_edges")
    bins = rows.groupBy(*keys, "_bin").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows a group
    bins = materialize(bins.select("*", F.coalesce(F.sum("_bp").over(before), F.lit(0)).alias("_p0"),
                                   F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_n0")))
    # a bin without positives adds nothing; the others are ranked inside, one task a (group, bin)
    live = bins.where(F.col("_bp") > 0).select(*keys, "_bin", "_p0", "_n0")
    inner = rows.join(live, [*keys, "_bin"])  # bins hold about equal parts of a group
    upto = Window.partitionBy(*keys, "_bin").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inner.select("*", (F.col("_p0") + F.sum("pos").over(upto)).alias("pos_cum"), (F.col("_n0") + F.sum("neg").over(upto)).alias("neg_cum"))
    j = ranked.where(F.col("pos") > 0)
    pos_below = F.col("pos_cum") - F.col("pos")
    neg_below = F.col("neg_cum") - F.col("neg")
    tp_ge = F.col("_p") - pos_below
    all_ge = F.col("_p") + F.col("_n") - pos_below - neg_below
    agg = j.groupBy(*keys).agg(
        F.sum(F.col("pos") * (neg_below + 0.5 * F.col("neg"))).alias("_u"),
        F.sum(F.col("pos") * tp_ge / all_ge).alias("_s"))
    # groups without positives have no row to rank: their totals make them null
    agg = groups.select(*keys, "_p", "_n").join(agg, keys, "left")
    if whole:
        agg, keys = agg.drop("_all"), []
    ok = (F.col("_p") > 0) & (F.col("_n") > 0)
    return agg.select(*keys, F.when(ok, F.col("_u") / (F.col("_p") * F.col("_n"))).alias("roc_auc"),
                      F.when(ok, F.col("_s") / F.col("_p")).alias("average_precision"))


def roc_auc(df: DataFrame, keys, score: str = "score", label: str = "label",
            buckets: int = DEFAULT_BUCKETS, table: DataFrame | None = None) -> DataFrame:
    """M7: tie-aware ROC AUC (Mann-Whitney, ties count 1/2); NULL with one class.

    ``table``: a materialized ``score_table`` to reuse (else built from ``df``).
    """
    keys = _k(keys)
    st = table if table is not None else materialize(score_table(df, keys, score, label))
    return ranking_metrics(st, keys, buckets).select(*keys, "roc_auc")


def average_precision(df: DataFrame, keys, score: str = "score", label: str = "label",
                      buckets: int = DEFAULT_BUCKETS, table: DataFrame | None = None) -> DataFrame:
    """M8: sum over distinct thresholds (descending) of (R_n - R_n-1) P_n; NULL with one class."""
    keys = _k(keys)
    st = table if table is not None else materialize(score_table(df, keys, score, label))
    return ranking_metrics(st, keys, buckets).select(*keys, "average_precision")


def binary_scores(df: DataFrame, keys, score: str = "score", label: str = "label", pred: str | None = None,
                  calculate_auc: bool = True, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """M15 building block: every metric of the reference's score record per group."""
    keys = _k(keys)
    if pred is not None:
        out = counting_metrics(confusion_counts(df, keys, pred, label)).drop("tn", "fp", "fn", "tp")
        if not calculate_auc:
            return out
        st = materialize(score_table(df, keys, score, label))
    else:
        # every metric from one materialized distinct-score table: the scored rows are computed once
        st = materialize(score_table(df, keys, score, label))
        above = F.col("score") > 0.5
        conf = st.groupBy(*keys).agg(
            F.sum(F.when(~above, F.col("neg")).otherwise(0)).cast("long").alias("tn"),
            F.sum(F.when(above, F.col("neg")).otherwise(0)).cast("long").alias("fp"),
            F.sum(F.when(~above, F.col("pos")).otherwise(0)).cast("long").alias("fn"),
            F.sum(F.when(above, F.col("pos")).otherwise(0)).cast("long").alias("tp"))
        conf = conf.withColumn("accuracy", (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))
        out = counting_metrics(conf).drop("tn", "fp", "fn", "tp")
        if not calculate_auc:
            return out
    return out.join(ranking_metrics(st, keys, buckets), keys, "left")


# ---------------------------------------------------------------- M9-M11
def macro_f1(df: DataFrame, keys, pred: str = "pred", label: str = "label") -> DataFrame:
    """M9: per-class F1 over the union of true and predicted classes, averaged."""
    keys = _k(keys)
    t = df.groupBy(*keys, F.col(label).alias("cls")).agg(F.count(F.lit(1)).alias("n_true"))
    p = df.groupBy(*keys, F.col(pred).alias("cls")).agg(F.count(F.lit(1)).alias("n_pred"))
    tp = df.where(F.col(label) == F.col(pred)).groupBy(*keys, F.col(label).alias("cls")).agg(
        F.count(F.lit(1)).alias("tp")
    )
    u = t.join(p, keys + ["cls"], "full").join(tp, keys + ["cls"], "left").fillna(0, ["n_true", "n_pred", "tp"])
    f1 = F.when(F.col("n_true") + F.col("n_pred") > 0,
                2 * F.col("tp") / (F.col("n_true") + F.col("n_pred"))).otherwise(0.0)
    return u.groupBy(*keys).agg(F.avg(f1).alias("macro_f1"))


def one_vs_rest(df: DataFrame, keys, probs: str = "probs", label: str = "label") -> DataFrame:
    """Unpivot class probabilities to (keys..., cls, score, label01) rows."""
    keys = _k(keys)
    ex = df.select(*keys, label, F.posexplode(probs).alias("cls", "score"))
    return ex.select(
        *keys, F.col("cls").cast("int").alias("cls"), "score", (F.col(label) == F.col("cls")).cast("int").alias("y")
    )


def ovr_auc(df: DataFrame, keys, probs: str = "probs", label: str = "label",
            buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Macro one-vs-rest ROC AUC."""
    keys = _k(keys)
    per = roc_auc(one_vs_rest(df, keys, probs, label), keys + ["cls"], "score", "y", buckets)
    return per.groupBy(*keys).agg(F.avg("roc_auc").alias("ovr_auc"))


def multiclass_ap(df: DataFrame, keys, probs: str = "probs", label: str = "label",
                  buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Macro average precision of one-vs-rest."""
    keys = _k(keys)
    per = average_precision(one_vs_rest(df, keys, probs, label), keys + ["cls"], "score", "y", buckets)
    return per.groupBy(*keys).agg(F.avg("average_precision").alias("multiclass_ap"))
