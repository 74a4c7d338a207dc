"""Flagship: multi-layer prototype moderation evaluation (survey section 3.1).

fit job:   vectors -> class means + pooled scatter per layer -> precision ->
           GDA params -> per-layer class-1 probability of train rows ->
           per-example layer features -> L1 logistic stack
score job: test rows -> per-layer probabilities -> features -> stack ->
           every metric per (dataset, method)

Shuffles: Gram partials by (layer, class, row), feature pivot by example_id,
metric groups by (dataset, method).  Parameters (K x d, d x d per layer) are
checkpointed once and attached by measured broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protolens.operators import meta as ME
from protolens.operators import metrics as M
from protolens.operators import scoring as SC
from protolens.operators import stats as S
from protolens.plans.common import rnd, signal_split
from protolens.operators.params import materialize
from protolens.session import ensure_checkpoint_dir

RECORD_COLS = ["accuracy", "f1", "true_positive_rate", "true_negative_rate", "negative_support", "positive_support",
               "roc_auc", "average_precision"]


def fit_layers(train: DataFrame, keys=("layer",), label: str = "label") -> dict:
    return S.fit_gda(train, list(keys), label)  # parameters come back materialized


def layer_probabilities(rows: DataFrame, params: DataFrame, label: str = "label", use_logits: bool = False) -> DataFrame:
    """Per-layer class-1 probability, or the class-1 logit with ``use_logits`` (one flag for
    training and evaluation, Q7)."""
    s = SC.softmax_probs(SC.gda_logits(rows, params, ["layer"], label))
    score = F.element_at("logits", 2) if use_logits else SC.positive_score("probs")
    return s.withColumn("score", score)


def features(scored: DataFrame, layers, own: tuple | list = ()) -> tuple[DataFrame, list[str]]:
    """One row an example: its scores by layer (columns named in the list) and its own columns ``own``."""
    wide = scored.groupBy("example_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in own],
                                            *[F.max(F.when(F.col("layer") == x, F.col("score"))).alias(f"layer_{x}") for x in layers])
    return wide, [f"layer_{x}" for x in layers]


def sample_training_ids(train: DataFrame, num_samples_per_class: int | None = None,
                        num_frac_data: float | None = None, seed: int = 42) -> DataFrame:
    """Training rows restricted to ids drawn once (from one layer) and reused for every layer (Q10)."""
    from protolens.operators import sampling as SP

    if num_samples_per_class is None and num_frac_data is None:
        return train
    first_layer = train.agg(F.min("layer")).first()[0]
    ids = train.where(F.col("layer") == first_layer).select("example_id", "label")
    if num_frac_data is not None:
        ids = SP.sample_fraction(ids, num_frac_data, "example_id", seed)
    if num_samples_per_class is not None:
        ids = SP.sample_per_class(ids, num_samples_per_class, [], "label", "example_id", seed, strict=True)
    return train.join(ids.select("example_id"), "example_id", "left_semi")


def stack_evaluate(train: DataFrame, bench: DataFrame, C: float = 1.0, use_logits: bool = False,
                   bench_keys=("dataset",), num_samples_per_class: int | None = None,
                   num_frac_data: float | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """Fit per-layer GDA + the L1 stack on ``train`` and score ``bench``.

    ``train``: (example_id, layer, label, vector); ``bench``: the same plus
    ``bench_keys``.  Optional training subsample: a fraction and/or n rows per
    class, drawn once and used for every layer.  Returns score records per
    (bench keys, method), the prediction rows and the stack coefficients.
    """
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    bench_keys = list(bench_keys)
    train = sample_training_ids(train, num_samples_per_class, num_frac_data, seed)
    fit = fit_layers(train)
    params = fit["params"]
    # layer ids (a parameter) from the small fitted table, not from another scan of the vectors
    layers = sorted(r[0] for r in params.select("layer").distinct().collect())

    tr_feat, cols = features(layer_probabilities(train, params, use_logits=use_logits), layers, ["label"])
    model = ME.meta_fit(tr_feat, cols, "label", C)

    # one id per benchmark example: the example id is only unique within its benchmark
    uid = F.concat_ws("|", *[F.col(k).cast("string") for k in bench_keys], F.col("example_id").cast("string"))
    b = bench.withColumn("_uid", uid)
    b_scored = layer_probabilities(b.drop("example_id").withColumnRenamed("_uid", "example_id"), params,
                                   use_logits=use_logits)
    # used twice (stack features, per-layer records): keep the slim scores, not the vectors, and scan once
    b_scored = materialize(b_scored.select("example_id", "layer", *bench_keys, "label", "score"))
    b_feat, _ = features(b_scored, layers, [*bench_keys, "label"])
    stacked = ME.meta_predict(model, b_feat, cols, "score")
    stacked = stacked.withColumn("method", F.lit("multilayer_gda"))

    per_layer = b_scored.select(*bench_keys, "label", "score",
                                F.concat(F.lit("gda_layer"), F.col("layer").cast("string")).alias("method"))
    long = stacked.select(*bench_keys, "label", "score", "method").unionByName(per_layer)
    rec = M.binary_scores(long, bench_keys + ["method"], "score", "label")
    records = rec.select(*bench_keys, "method",
                         *[rnd(c).alias(c) if c not in ("negative_support", "positive_support") else F.col(c)
                           for c in RECORD_COLS])
    coefs = ME.meta_coefficients(spark, model, layers, C)
    preds = stacked.select("example_id", *bench_keys, "label", "score")
    return {"records": records, "predictions": preds, "coefficients": coefs}


def multilayer_report(spark: SparkSession, sf: str, C: float = 1.0, use_logits: bool = False) -> DataFrame:
    """The flagship on the vector fixture: train split to fit, test split scored per dataset."""
    tr, te = signal_split(spark, sf)
    return stack_evaluate(tr, te, C, use_logits, ["dataset"])["records"]


def evaluate_files(spark: SparkSession, train_dir: str, bench_root: str, out_dir: str | None = None,
                   C: float = 1.0, use_logits: bool = False, **sample) -> DataFrame:
    """The reference's multi-layer evaluation from files.

    ``train_dir``: ``layer_{i}_hidden_states.parquet`` files (layer 0 excluded);
    ``bench_root``: ``{dataset_type}/{dataset}/layer_{i}_hidden_states.parquet``.
    Writes predictions (K2), score records (K3) and stack coefficients (K4)
    below ``out_dir`` when given; returns the score records.  ``sample``:
    ``num_samples_per_class`` / ``num_frac_data`` / ``seed`` as in ``stack_evaluate``.
    """
    from protolens.sources import readers as RD
    from protolens.sources import sinks as SK

    def prep(df):
        return RD.select_layers(df, exclude=(0,)).select(
            *[c for c in df.columns if c in ("dataset_type", "dataset")], "example_id", "layer",
            F.col("labels").cast("int").alias("label"),
            F.transform("hidden_state", lambda x: x.cast("double")).alias("vector"))

    train = prep(RD.read_layer_vectors(spark, train_dir))
    bench = prep(RD.read_benchmark_vectors(spark, bench_root))
    out = stack_evaluate(train, bench, C, use_logits, ["dataset_type", "dataset"], **sample)
    if out_dir:
        SK.write_predictions(out["predictions"], f"{out_dir}/predictions")
        SK.write_scores(out["records"], f"{out_dir}/scores")
        SK.write_meta_coefficients(out["coefficients"], f"{out_dir}/meta_model_coefficients")
    return out["records"]
