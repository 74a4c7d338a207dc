"""Category growth (the reference's per-category evaluation, survey section 3 "category growth").

Step i treats categories 0..i as classes.  Means and scatter are computed once
per category and summed per step (A15), so every (step, layer) model comes
from one grouped job.  Test rows with category <= i are scored by GDA, nearest
mean and Mahalanobis; multi-class predictions are binarised (any class >= 1 is
harmful, M12), and the harmful score is the summed probability of the non-benign
classes (M13).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolens.functions import vec as V
from protolens.operators import blocks as B
from protolens.operators import meta as ME
from protolens.operators import metrics as M
from protolens.operators import scoring as SC
from protolens.operators import stats as S
from protolens.operators.params import attach_params


def category_steps_report(train: DataFrame, test: DataFrame, max_step: int | None = None,
                          category: str = "category", bench_keys=("dataset",)) -> DataFrame:
    """Score records per (step, layer, method, bench keys) for category steps 1..max_step."""
    bench_keys = list(bench_keys)
    if max_step is None:
        max_step = int(train.agg(F.max(category)).first()[0])
    fit = S.fit_gda_steps(train, ["layer"], category, max_step)
    means = S.incremental_steps(fit["means"], category, max_step)
    rows = S.incremental_steps(test, category, max_step)
    keys = ["step", "layer"]

    def harmful(df, probs="probs"):
        pred = M.binarize_multiclass(V.argmax(probs))
        score = 1.0 - F.element_at(probs, 1)  # sum of the non-benign class probabilities
        return df.withColumn("pred", pred).withColumn("score", score).withColumn(
            "y", (F.col(category) >= 1).cast("int"))

    gda = harmful(SC.softmax_probs(SC.gda_logits(rows, fit["params"], keys, category))).withColumn("method", F.lit("gda"))
    nmc = harmful(SC.nmc_pred(rows, means, keys, category)).withColumn("method", F.lit("nmc"))
    maha = harmful(SC.mahalanobis_pred(SC.mahalanobis_sq(rows, means, fit["precision"], keys, category))) \
        .withColumn("method", F.lit("mahalanobis"))
    cols = ["step", "layer", "method", *bench_keys, "y", "pred", "score"]
    long = gda.select(*cols).unionByName(nmc.select(*cols)).unionByName(maha.select(*cols))
    return M.binary_scores(long, ["step", "layer", "method", *bench_keys], "score", "y", pred="pred")


def category_growth_stack(train: DataFrame, bench: DataFrame, C: float = 0.01, max_step: int | None = None,
                          category: str = "category", id_col: str = "example_id", bench_keys=("dataset",)) -> DataFrame:
    """Multi-layer stack refitted at every category step: score records per (step, bench keys).

    Step i fits GDA per layer on the training rows of categories 0..i, takes the probabilities of classes 1..i of every
    layer as features and fits an L1 stack for "any class above 0" on the same rows; every benchmark row is scored.
    A vector meets the models of all steps of its layer in one place, and all stacks are fitted in the same passes.
    """
    bench_keys = list(bench_keys)
    if max_step is None:
        max_step = int(train.agg(F.max(category)).first()[0])
    params = S.fit_gda_steps(train, ["layer"], category, max_step)["params"]
    layers = [r[0] for r in params.select("layer").distinct().orderBy("layer").collect()]  # one row a layer
    # step i has i + 1 classes: its models begin after those of the steps before
    cls = (F.col("step") - 1) * (F.col("step") + 2) / 2 + F.col(category)
    blocks = B.vector_blocks(params.withColumn("_cls", cls.cast("int")), ["layer"], "_cls", F.concat("w", F.array("b")))

    def features(rows: DataFrame, own: list[str]) -> DataFrame:
        """(id, own, step, x): the probabilities by layer and class, zeros for classes past the step."""
        scored = B.score(rows, blocks, ["layer"], "vector", "_s", B.logits, keep=[id_col, "layer", *own])
        of_step = [F.concat(F.slice(V.softmax(F.slice("_s", (i - 1) * (i + 2) // 2 + 1, i + 1)), 2, i),
                            F.array_repeat(F.lit(0.0), max_step - i)) for i in range(1, max_step + 1)]
        wide = scored.select(id_col, "layer", *own, F.array(*of_step).alias("_f")).groupBy(id_col, *own).agg(
            *[F.first(F.when(F.col("layer") == x, F.col("_f")), ignorenulls=True).alias(f"_f{k}") for k, x in enumerate(layers)])
        steps = F.sequence(F.lit(1), F.lit(max_step))
        flat = F.concat(*[F.element_at(f"_f{k}", F.col("step")) for k in range(len(layers))])
        return wide.withColumn("step", F.explode(steps)).select(id_col, *own, "step", flat.alias("x"))

    data = features(train, [category]).where(F.col(category) <= F.col("step")).withColumn("_y", (F.col(category) >= 1).cast("int"))
    width = max_step * len(layers)
    stacks = ME.fit_array_stacks(data, F.col("x"), range(width), "_y", [
        ME.Problem(C, F.col("step") == i, [j for j in range(width) if j % max_step < i]) for i in range(1, max_step + 1)])
    weights = train.sparkSession.createDataFrame([(i + 1, [float(v) for v in m.coefficients]) for i, m in enumerate(stacks)], "step int, _w array<double>")
    scored = attach_params(features(bench, [category, *[c for c in bench_keys if c != category]]), weights, ["step"])
    z = V.dot("x", F.slice("_w", 1, width)) + F.element_at("_w", -1)
    scored = scored.select("step", *bench_keys, (F.col(category) >= 1).cast("int").alias("y"), (1.0 / (1.0 + F.exp(-z))).alias("score"))
    return M.binary_scores(scored, ["step", *bench_keys], "score", "y")
