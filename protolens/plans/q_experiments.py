"""Registered queries: grids of nested experiments (G19 and the evaluated form of SP7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protolens.operators import experiments as X
from protolens.operators import metrics as M
from protolens.plans.catalog import register
from protolens.plans.common import layer_vectors, train_test
from protolens.plans.q_metrics import RANK_SQL, CONFUSION_SQL, round_record
from protolens.plans.sqlparts import DISTANCE, gda_ctes, vec_base

# The seeds and sample sizes of the reference's sweeps, and the fraction of its layer sweep.
SEEDS = (0, 1, 2, 3, 4)
SIZES = (10, 50, 100, 500, 1000, 5000, 10000, 20000, 40000)
FRACTION = 0.9

_ORDER = "ORDER BY md5(concat(CAST(example_id AS VARCHAR), ':', CAST(seed AS VARCHAR))), example_id"


def _records_sql(sample: str, keys: str) -> str:
    """Score records of the three methods for models fitted on ``smp`` by ``keys`` (which contain layer)."""
    cell = "concat_ws('|', " + keys + ")"
    kj = ", ".join("p." + k.strip() for k in keys.split(","))
    kq = " AND ".join(f"p.{k.strip()} = q.{k.strip()}" for k in keys.split(","))
    return vec_base(sample + gda_ctes(keys=keys, src="smp").lstrip() + f""",
lg AS (SELECT {kj}, te.example_id, te.dataset, te.label, p.cls, list_dot_product(te.vector, p.w) + p.b AS s, 'gda' AS kind
       FROM te JOIN g_params p ON te.layer = p.layer),
nd AS (SELECT {kj}, te.example_id, te.dataset, te.label, p.cls, -list_distance(te.vector, p.m) AS s, 'nmc' AS kind
       FROM te JOIN g_params p ON te.layer = p.layer),
zz AS (SELECT {kj}, te.example_id, te.dataset, te.label, p.cls, q.p, list_transform(te.vector, lambda x, c: x - p.m[c]) AS z
       FROM te JOIN g_params p ON te.layer = p.layer JOIN g_prec q ON {kq}),
md AS (SELECT {keys}, example_id, dataset, label, cls, -({DISTANCE}) AS s, 'mahalanobis' AS kind FROM zz),
every AS (SELECT * FROM lg UNION ALL SELECT * FROM nd UNION ALL SELECT * FROM md),
soft AS (SELECT *, exp(s - max(s) OVER w) AS e FROM every WINDOW w AS (PARTITION BY kind, {keys}, example_id)),
ps AS (SELECT kind, {keys}, dataset, label, cls, e / sum(e) OVER (PARTITION BY kind, {keys}, example_id) AS prob FROM soft),
preds AS (SELECT concat(kind, '|', {cell}) AS layer, dataset, label, prob AS score FROM ps WHERE cls = 1)""" + CONFUSION_SQL + RANK_SQL + """
SELECT split_part(layer, '|', 1) AS method, {parts}, dataset, round(accuracy, 6) AS accuracy,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS true_positive_rate,
       round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 6) AS true_negative_rate,
       tn + fp AS negative_support, tp + fn AS positive_support,
       round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision
FROM cf JOIN rk USING (layer, dataset)""".replace("{parts}", ", ".join(
        f"CAST(split_part(layer, '|', {i + 2}) AS INTEGER) AS {k.strip()}" for i, k in enumerate(keys.split(",")))))


def _records(spark: SparkSession, train: DataFrame, test: DataFrame, cells: DataFrame, sizes) -> DataFrame:
    fit = X.fit_cells(train, cells, len(SEEDS), len(sizes))
    scored = X.score_cells(test, fit, len(sizes), keep=("dataset", "label"))
    scored = scored.select("method", F.element_at(F.array(*map(F.lit, SEEDS)), F.col("_seed") + 1).alias("seed"),
                           F.element_at(F.array(*map(F.lit, sizes)), F.col("_size") + 1).alias("size"), "layer", "dataset", "label", "score")
    return M.binary_scores(scored, ["method", "seed", "size", "layer", "dataset"], "score", "label")


@register("layer_sweep", _records_sql(f"""
seeds AS (SELECT unnest([{", ".join(map(str, SEEDS))}]) AS seed),
smp AS (SELECT tr.*, seed FROM tr, seeds
        QUALIFY row_number() OVER (PARTITION BY seed, layer {_ORDER}) <= round_even({FRACTION} * count(*) OVER (PARTITION BY seed, layer), 0)),
""", "seed, layer"))
def q_layer_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """The whole single-layer evaluation for every layer and seed, on nine tenths of the training rows."""
    tr, te = train_test(spark, sf)
    cells = X.cells_by_fraction(tr.select("example_id").distinct(), SEEDS, FRACTION)
    return round_record(_records(spark, tr, te, cells, (0,)), ["method", "seed", "layer", "dataset"])


@register("sample_size_sweep", _records_sql(f"""
cells AS (SELECT seed, unnest([{", ".join(map(str, SIZES))}]) AS size FROM (SELECT unnest([{", ".join(map(str, SEEDS))}]) AS seed)),
smp AS (SELECT tr.*, seed, size FROM tr, cells QUALIFY row_number() OVER (PARTITION BY seed, size, layer, label {_ORDER}) <= size),
""", "seed, size, layer"))
def q_sample_size_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """SP7 evaluated: every seed and sample size per class, all layers, all three methods, a record a benchmark."""
    tr, te = train_test(spark, sf)
    cells = X.cells_by_size(tr.select("example_id", "label").distinct(), SEEDS, SIZES)
    return round_record(_records(spark, tr, te, cells, SIZES), ["method", "seed", "size", "layer", "dataset"])
