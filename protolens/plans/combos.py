"""Prototypes merged over dataset combinations (the reference's multiple-dataset evaluation).

One scan computes class means and scatter per (layer, dataset, class).  Every
non-empty combination of datasets is then fitted from those additive
statistics in one (combo, layer)-keyed job:
  * prototypes: all class means of the combination's datasets (A13), class = proto_id mod 2;
  * precision: merged covariance sum_j cov_j (n_j - 1) / (sum n_j - 1) (A11), Bayes precision (A6);
  * GDA over the stacked prototypes (A8).
The sums of all sets of datasets come from a walk over the lattice of sets, one addition a set.
Each benchmark vector meets the models of all 2^k - 1 sets in one place; scores are collapsed with
M14 (argmax mod 2, sum of odd-class probabilities) before rows are made of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from protolens.functions import vec as V
from protolens.operators import blocks as B
from protolens.operators import metrics as M
from protolens.operators import scoring as SC
from protolens.operators import stats as S
from protolens.operators.params import attach_params, materialize


def combo_prototype_scores(train: DataFrame, bench: DataFrame, datasets=None, bench_keys=("dataset",), remove_outliers: bool = False) -> DataFrame:
    """``train``: (example_id, layer, dataset, label, vector); ``bench``: (example_id, layer, label, vector, bench keys).

    ``remove_outliers`` drops training rows that the isolation forest of their own layer, dataset and class flags (F9)
    before anything is fitted.  Returns one score record per (combo, layer, bench keys).
    """
    bench_keys = list(bench_keys)
    if remove_outliers:
        from protolens.operators.outliers import outlier_filter

        train = materialize(outlier_filter(train.select("example_id", "layer", "dataset", "label", "vector"), ["layer", "dataset", "label"]))
    means = materialize(S.class_means(train, ["layer", "dataset"], "label"))
    if datasets is None:  # dataset names (a parameter) from the small means table
        datasets = sorted(r[0] for r in means.select("dataset").distinct().collect())
    scatter = S.class_scatter(train, ["layer", "dataset"], "label", means=means, means_materialized=True)
    per_ds = materialize(S.pooled_covariance(scatter, ["layer", "dataset"]))
    merged = S.merge_combination_covariances(per_ds, ["layer"], datasets)
    precision = materialize(S.bayes_precision(merged, ["mask", "layer"]))
    protos = materialize(S.stack_prototypes(means, datasets, ["layer"], "label").select("mask", "layer", "proto_id", "mean", "n"))
    params = S.gda_params(protos, precision, ["mask", "layer"], "proto_id")
    # the models of all sets side by side, so a vector meets them in one place
    place = Window.partitionBy("layer").orderBy("mask", "proto_id")
    params = materialize(params.withColumn("_cls", F.row_number().over(place) - 1))
    layout = params.groupBy("layer", "mask").agg(F.min("_cls").alias("at"), F.count("*").cast("int").alias("size"))
    layout = layout.groupBy("layer").agg(F.collect_list(F.struct("mask", "at", "size")).alias("_sets"))
    blocks = B.vector_blocks(params, ["layer"], "_cls", F.concat("w", F.array("b")))
    rows = B.score(bench, blocks, ["layer"], "vector", "_s", B.logits, keep=["layer", *bench_keys, "label"])
    rows = attach_params(rows, layout, ["layer"]).select("layer", *bench_keys, "label", "_s", F.inline("_sets"))
    probs = V.softmax(F.slice("_s", F.col("at") + 1, F.col("size")))
    pred, score = M.collapse_dataset_protos(F.col("probs"))
    scored = rows.select(S.combination_name(F.col("mask"), datasets).alias("combo"), "layer", *bench_keys, "label", probs.alias("probs"))
    scored = scored.withColumn("pred", pred).withColumn("score", score).drop("probs")
    return M.binary_scores(scored, ["combo", "layer"] + bench_keys, "score", "label", pred="pred")


def combo_multilayer_stack(train: DataFrame, bench: DataFrame, datasets=None, C: float = 0.1,
                           bench_keys=("dataset",)) -> DataFrame:
    """Multi-layer stack per dataset combination (G9 features + G11 fit, C = 0.1).

    Per-layer GDA models are fitted per (layer, dataset) in one grouped job; every
    training and benchmark row is scored against every dataset's model of its
    layer (rows x k datasets, a parameter); each combination fits its L1 stack on
    the rows of its own datasets with only its own models' features (Q14), all
    2^k - 1 of them in the same passes.
    """
    from protolens.operators import meta as ME
    from protolens.plans.flagship import RECORD_COLS

    bench_keys = list(bench_keys)
    fit = S.fit_gda(train, ["layer", "dataset"], "label")
    params = fit["params"].withColumnRenamed("dataset", "model")
    keys = params.select("layer", "model").distinct().collect()  # small fitted table, not another scan
    layers = sorted({r.layer for r in keys})
    if datasets is None:
        datasets = sorted({r.model for r in keys})

    def features(rows, id_cols):
        r = rows.withColumn("model", F.explode(F.array(*[F.lit(d) for d in datasets])))
        s = SC.softmax_probs(SC.gda_logits(r, params, ["layer", "model"], "label"))
        s = s.withColumn("_f", F.concat(F.lit("layer"), F.col("layer").cast("string"), F.lit("_"), F.col("model")))
        cols = [f"layer{l}_{d}" for l in layers for d in datasets]
        wide = s.groupBy(*id_cols).pivot("_f", cols).agg(F.first(F.element_at("probs", 2)))
        return materialize(wide), cols

    tr_feat, cols = features(train, ["example_id", "dataset", "label"])
    b_feat, _ = features(bench, ["example_id", *bench_keys, "label"])
    combos = sorted(S.dataset_combinations(train.sparkSession, datasets).groupBy("combo").agg(
        F.collect_list("dataset").alias("members")).collect(), key=lambda r: r.combo)  # 2^k - 1 rows
    used = [[f"layer{l}_{d}" for l in layers for d in sorted(c.members)] for c in combos]
    models = ME.fit_stacks(tr_feat, cols, "label", [ME.Problem(C, F.col("dataset").isin(list(c.members)), u) for c, u in zip(combos, used)])
    # one slim row an example and combination, from one scan of the features
    scores = F.explode(F.array(*[F.struct(F.lit(c.combo).alias("combo"), ME.stack_score(m, cols).alias("score")) for c, m in zip(combos, models)]))
    scored = b_feat.select(*bench_keys, "label", scores.alias("_s")).select(*bench_keys, "label", "_s.combo", "_s.score")
    out = M.binary_scores(scored, ["combo", *bench_keys], "score", "label")
    return out.select("combo", *bench_keys, *RECORD_COLS)


def shared_covariance_stack(train: DataFrame, bench: DataFrame, datasets=None, C: float = 0.1, bench_keys=("dataset",)) -> DataFrame:
    """Multi-layer stack per dataset combination with one covariance a combination and each member's own means.

    The precision of a combination comes from its merged covariance (A11, A6); with it every member's class means give a GDA
    model (A8), and the probabilities of all (layer, member) models are the features of the combination's L1 stack, fitted on
    the rows of its members.  All models of a layer stand side by side, and all stacks are fitted in the same passes.
    """
    from protolens.operators import meta as ME
    from protolens.plans.flagship import RECORD_COLS

    bench_keys = list(bench_keys)
    means = materialize(S.class_means(train, ["layer", "dataset"], "label"))
    if datasets is None:  # dataset names (a parameter) from the small means table
        datasets = sorted(r[0] for r in means.select("dataset").distinct().collect())
    layers = [r[0] for r in means.select("layer").distinct().orderBy("layer").collect()]
    scatter = S.class_scatter(train, ["layer", "dataset"], "label", means=means, means_materialized=True)
    merged = S.merge_combination_covariances(materialize(S.pooled_covariance(scatter, ["layer", "dataset"])), ["layer"], datasets)
    precision = materialize(S.bayes_precision(merged, ["mask", "layer"]))
    member = means.where(F.col("dataset").isin(datasets)).withColumn("mask", F.explode(S.dataset_masks(datasets)))
    models = member.select("mask", "layer", "dataset").distinct()
    own = precision.join(models, ["mask", "layer"])  # parameter-sized: one matrix for each member of a set
    params = S.gda_params(member.select("mask", "layer", "dataset", "label", "mean"), own, ["mask", "layer", "dataset"], "label")
    k, sets = len(datasets), (1 << len(datasets)) - 1
    place = ((F.col("mask") - 1) * k + S._position(datasets, "dataset")) * 2 + F.col("label")
    blocks = B.vector_blocks(params.withColumn("_cls", place.cast("int")), ["layer"], "_cls", F.concat("w", F.array("b")))
    # classes that exist, in order: the places of (mask, member) pairs in the array of scores
    pairs = [(m, r) for m in range(1, sets + 1) for r in range(k) if m >> r & 1]
    names = [f"l{x}_m{m}_{r}" for x in layers for m, r in pairs]

    def features(rows: DataFrame, own_cols: list[str]) -> DataFrame:
        scored = B.score(rows, blocks, ["layer"], "vector", "_s", B.logits, keep=["example_id", "layer", *own_cols])
        probs = F.array(*[F.element_at(V.softmax(F.slice("_s", 2 * i + 1, 2)), 2) for i in range(len(pairs))])
        wide = scored.select("example_id", "layer", *own_cols, probs.alias("_p")).groupBy("example_id", *own_cols).agg(
            *[F.first(F.when(F.col("layer") == x, F.col("_p")), ignorenulls=True).alias(f"_p{i}") for i, x in enumerate(layers)])
        return wide.select("example_id", *own_cols, F.concat(*[f"_p{i}" for i in range(len(layers))]).alias("x"))

    def members(m: int) -> list[str]:
        return [d for r, d in enumerate(datasets) if m >> r & 1]

    stacks = ME.fit_array_stacks(features(train, ["dataset", "label"]), F.col("x"), names, "label", [
        ME.Problem(C, F.col("dataset").isin(members(m)), [n for n in names if f"_m{m}_" in n]) for m in range(1, sets + 1)])
    weights = train.sparkSession.createDataFrame([("+".join(members(m)), [float(v) for v in q.coefficients]) for m, q in enumerate(stacks, 1)],
                                                 "combo string, _w array<double>")
    listed = weights.agg(F.collect_list(F.struct("combo", "_w")).alias("_all")).withColumn("_one", F.lit(1))  # 2^k - 1 weight vectors
    data = attach_params(features(bench, [*bench_keys, "label"]).withColumn("_one", F.lit(1)), listed, ["_one"])
    scored = data.select(*bench_keys, "label", "x", F.inline("_all"))
    z = V.dot("x", F.slice("_w", 1, len(names))) + F.element_at("_w", -1)
    scored = scored.select("combo", *bench_keys, "label", (1.0 / (1.0 + F.exp(-z))).alias("score"))
    return M.binary_scores(scored, ["combo", *bench_keys], "score", "label").select("combo", *bench_keys, *RECORD_COLS)
