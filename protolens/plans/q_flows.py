"""Registered queries: whole evaluation flows (survey section 3) over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from protolens.plans import categories, combos, flagship
from protolens.plans.catalog import register
from protolens.plans.common import layer_vectors, rnd, signal_split, train_test
from protolens.plans.condition import condition_search
from protolens.plans.q_contrast import CONDITION_SEARCH_SQL
from protolens.plans.q_meta import _stack_sql
from protolens.plans.q_metrics import CONFUSION_SQL, RANK_SQL, RECORD_SQL
from protolens.plans.q_vectors import DATASET_COMBOS_SQL
from protolens.plans.sqlparts import DISTANCE, gda_ctes, l1_ctes, precision_ctes, scatter_ctes, vec_base


_BY_PRED = CONFUSION_SQL.replace("CAST(score > 0.5 AS INTEGER)", "pred")


def _rounded(df):
    return df.select(*[rnd(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


MULTILAYER_SQL = _stack_sql("1.0", """,
own AS (SELECT DISTINCT example_id, dataset, label FROM te),
preds AS (SELECT 'multilayer_gda' AS layer, dataset, label, round(1 / (1 + exp(-list_dot_product(x, w))), 9) AS score FROM ft2 JOIN own ON rid = example_id, l1
          UNION ALL SELECT concat('gda_layer', CAST(layer AS VARCHAR)), dataset, own.label, e / total
          FROM (SELECT *, sum(e) OVER (PARTITION BY example_id, layer) AS total FROM pr2) q JOIN own USING (example_id) WHERE cls = 1)"""
    + CONFUSION_SQL + RANK_SQL + """
SELECT dataset, layer AS method, """ + RECORD_SQL)


@register("multilayer_report", MULTILAYER_SQL)
def q_multilayer_report(spark, sf):
    """Stacked layers evaluated on every benchmark."""
    return _rounded(flagship.multilayer_report(spark, sf))


@register("condition_search", CONDITION_SEARCH_SQL)
def q_condition_search(spark, sf):
    """Pairs -> principal directions -> similarities -> threshold grid -> best cell -> predictions."""
    v = layer_vectors(spark, sf)
    layers = [r["layer"] for r in v.select("layer").distinct().orderBy("layer").collect()]  # one row a layer
    return condition_search(v.select("example_id", "layer", "label", "vector"), layers, max_layers=2)["predictions"]


_STEPPED = """
stp AS (SELECT tr.*, step FROM tr, (SELECT unnest(range(1, (SELECT max(category) FROM tr) + 1)) AS step) WHERE category <= step),
""" + gda_ctes("category", "step, layer", "stp").lstrip()

CATEGORY_STEPS_SQL = vec_base(_STEPPED + f""",
me AS (SELECT p.step, p.cls, p.m, p.w, p.b, te.example_id, te.layer, te.dataset, te.category, te.vector
       FROM te JOIN g_params p ON te.layer = p.layer AND te.category <= p.step),
zz AS (SELECT me.step, me.layer, me.example_id, me.dataset, me.category, me.cls, q.p, list_transform(me.vector, lambda x, c: x - me.m[c]) AS z
       FROM me JOIN g_prec q ON q.step = me.step AND q.layer = me.layer),
every AS (SELECT 'gda' AS kind, step, layer, example_id, dataset, category, cls, list_dot_product(vector, w) + b AS s FROM me
          UNION ALL SELECT 'nmc', step, layer, example_id, dataset, category, cls, -list_distance(vector, m) FROM me
          UNION ALL SELECT 'mahalanobis', step, layer, example_id, dataset, category, cls, -({DISTANCE}) FROM zz),
soft AS (SELECT *, max(s) OVER o AS top, exp(s - max(s) OVER o) AS e FROM every WINDOW o AS (PARTITION BY kind, step, layer, example_id)),
preds AS (SELECT concat_ws('|', kind, step, layer) AS layer, dataset, CAST(any_value(category) >= 1 AS INTEGER) AS label,
                 CAST(min(cls) FILTER (WHERE s = top) >= 1 AS INTEGER) AS pred, 1 - sum(e) FILTER (WHERE cls = 0) / sum(e) AS score
          FROM soft GROUP BY kind, step, soft.layer, example_id, dataset)""" + _BY_PRED + RANK_SQL + """
SELECT split_part(layer, '|', 1) AS method, CAST(split_part(layer, '|', 2) AS INTEGER) AS step, CAST(split_part(layer, '|', 3) AS INTEGER) AS layer,
       dataset, """ + RECORD_SQL)


@register("category_steps", CATEGORY_STEPS_SQL)
def q_category_steps(spark, sf):
    """Score records for every step of category growth."""
    tr, te = train_test(spark, sf)
    return _rounded(categories.category_steps_report(tr, te))


COMBO_SCORES_SQL = vec_base(scatter_ctes("label", "layer, dataset") + "," + DATASET_COMBOS_SQL + """,
cn AS (SELECT layer, dataset, count(*) AS n FROM g_x GROUP BY ALL),
cb AS (SELECT DISTINCT m, combo FROM combos),
mn AS (SELECT combo, layer, sum(n) AS nn FROM cn JOIN combos USING (dataset) GROUP BY ALL),
ms AS (SELECT combo, layer, nn, i, j, sum(s) AS s FROM g_se JOIN combos USING (dataset) JOIN mn USING (combo, layer) GROUP BY ALL),
""" + precision_ctes("combo, layer", "ms", "mp").lstrip() + """,
pt AS (SELECT combo, g_mu.layer, m, row_number() OVER (PARTITION BY combo, g_mu.layer ORDER BY dataset, cls) - 1 AS cls,
              count(*) OVER (PARTITION BY combo, g_mu.layer) AS kk FROM (SELECT layer, dataset, cls, m FROM g_mu) g_mu JOIN (SELECT combo, dataset FROM combos) USING (dataset)),
pw AS (SELECT combo, layer, pt.m, cls, kk, list_transform(p, lambda r: list_dot_product(r, pt.m)) AS w FROM pt JOIN mp USING (combo, layer)),
lg AS (SELECT combo, te.layer, te.example_id, te.dataset, te.label, cls,
              list_dot_product(te.vector, w) + ln(1.0 / kk) - 0.5 * list_dot_product(w, m) AS s FROM te JOIN pw USING (layer)),
sx AS (SELECT *, exp(s - max(s) OVER o) AS e, max(s) OVER o AS top FROM lg WINDOW o AS (PARTITION BY combo, layer, example_id)),
preds AS (SELECT concat(combo, '|', CAST(layer AS VARCHAR)) AS layer, dataset, any_value(label) AS label,
                 CAST(min(cls) FILTER (WHERE s = top) % 2 AS INTEGER) AS pred, sum(e) FILTER (WHERE cls % 2 = 1) / sum(e) AS score
          FROM sx GROUP BY combo, sx.layer, example_id, dataset)""" + _BY_PRED + RANK_SQL + """
SELECT split_part(layer, '|', 1) AS combo, CAST(split_part(layer, '|', 2) AS INTEGER) AS layer, dataset, """ + RECORD_SQL + """""")


@register("combo_prototype_scores", COMBO_SCORES_SQL)
def q_combo_prototype_scores(spark, sf):
    """Score records of prototypes merged over every dataset combination."""
    tr, te = train_test(spark, sf)
    return _rounded(combos.combo_prototype_scores(tr, te))


_STEP_FEATURES = """
lg{n} AS (SELECT p.step, t.example_id, t.layer, t.dataset, t.category, p.cls, list_dot_product(t.vector, p.w) + p.b AS s
       FROM {rows} t JOIN g_params p ON t.layer = p.layer {only}),
pr{n} AS (SELECT *, exp(s - max(s) OVER o) AS e FROM lg{n} WINDOW o AS (PARTITION BY step, example_id, layer)),
ft{n} AS (SELECT CAST(step AS VARCHAR) AS grp, example_id AS rid, any_value(dataset) AS dataset, CAST(any_value(category) >= 1 AS INTEGER) AS y,
              list_append(list(prob ORDER BY layer, cls) FILTER (WHERE cls >= 1), 1.0::DOUBLE) AS x
       FROM (SELECT step, example_id, layer, dataset, category, cls, e / sum(e) OVER (PARTITION BY step, example_id, layer) AS prob FROM pr{n})
       GROUP BY step, example_id)"""

# scores to 9 places: a weight that is zero in the optimum is only nearly so after these steps
CATEGORY_STACK_SQL = vec_base("""
stp AS (SELECT tr.*, step FROM tr, (SELECT unnest(range(1, (SELECT max(category) FROM tr) + 1)) AS step) WHERE category <= step),
""" + gda_ctes("category", "step, layer", "stp").lstrip() + "," + _STEP_FEATURES.format(n=1, rows="tr", only="AND t.category <= p.step") + ","
    + _STEP_FEATURES.format(n=2, rows="te", only="") + """,
cs AS (SELECT DISTINCT grp, 0.01::DOUBLE AS C FROM ft1),""" + l1_ctes("ft1", "cs", steps=600) + """,
preds AS (SELECT f.grp AS layer, dataset, y AS label, round(1 / (1 + exp(-list_dot_product(x, w))), 9) AS score FROM ft2 f JOIN l1 ON l1.grp = f.grp)"""
    + CONFUSION_SQL + RANK_SQL + """
SELECT CAST(layer AS INTEGER) AS step, dataset, """ + RECORD_SQL + """""")


@register("category_growth_stack", CATEGORY_STACK_SQL)
def q_category_growth_stack(spark, sf):
    """Score records of the stack refitted at every category step on per-class features (C = 0.01)."""
    tr, te = train_test(spark, sf)
    return _rounded(categories.category_growth_stack(tr, te))


_MODEL_FEATURES = """
lg{n} AS (SELECT t.example_id, t.layer, t.label, t.dataset, p.dataset AS model, p.cls, list_dot_product(t.vector, p.w) + p.b AS s
       FROM {rows} t JOIN g_params p ON t.layer = p.layer),
pr{n} AS (SELECT *, exp(s - max(s) OVER o) AS e FROM lg{n} WINDOW o AS (PARTITION BY example_id, layer, model)),
ft{n} AS (SELECT combo AS grp, example_id AS rid, any_value(q.dataset) AS dataset, any_value(label) AS y, list_append(list(prob ORDER BY layer, model), 1.0::DOUBLE) AS x
       FROM (SELECT example_id, layer, label, dataset, model, cls, e / sum(e) OVER (PARTITION BY example_id, layer, model) AS prob FROM pr{n}) q
       JOIN (SELECT combo, dataset AS model FROM combos) USING (model) WHERE cls = 1 GROUP BY combo, example_id)"""

COMBO_STACK_SQL = vec_base(gda_ctes(keys="layer, dataset") + "," + DATASET_COMBOS_SQL + "," + _MODEL_FEATURES.format(n=1, rows="tr") + ","
    + _MODEL_FEATURES.format(n=2, rows="te") + """,
fit AS (SELECT ft1.* FROM ft1 JOIN combos ON combos.combo = ft1.grp AND combos.dataset = ft1.dataset),
cs AS (SELECT DISTINCT grp, 0.1::DOUBLE AS C FROM fit),""" + l1_ctes("fit", "cs", steps=1500) + """,
preds AS (SELECT f.grp AS layer, dataset, y AS label, round(1 / (1 + exp(-list_dot_product(x, w))), 9) AS score FROM ft2 f JOIN l1 ON l1.grp = f.grp)"""
    + CONFUSION_SQL + RANK_SQL + """
SELECT layer AS combo, dataset, """ + RECORD_SQL, "signal_vectors")


@register("combo_multilayer_stack", COMBO_STACK_SQL)
def q_combo_multilayer_stack(spark, sf):
    """Score records of the per-combination stack over per-dataset models."""
    tr, te = signal_split(spark, sf)
    return _rounded(combos.combo_multilayer_stack(tr, te))


SHARED_COVARIANCE_SQL = vec_base(scatter_ctes("label", "layer, dataset") + "," + DATASET_COMBOS_SQL + """,
cn AS (SELECT layer, dataset, count(*) AS n FROM g_x GROUP BY ALL),
mn AS (SELECT combo, layer, sum(n) AS nn FROM cn JOIN combos USING (dataset) GROUP BY ALL),
ms AS (SELECT combo, layer, nn, i, j, sum(s) AS s FROM g_se JOIN combos USING (dataset) JOIN mn USING (combo, layer) GROUP BY ALL),
""" + precision_ctes("combo, layer", "ms", "mp").lstrip() + """,
pw AS (SELECT combo, layer, dataset AS model, cls, mu.m, list_transform(p, lambda r: list_dot_product(r, mu.m)) AS w
       FROM (SELECT layer, dataset, cls, m FROM g_mu) mu JOIN (SELECT combo, dataset FROM combos) USING (dataset) JOIN mp USING (combo, layer)),""" + ",".join(f"""
lg{n} AS (SELECT combo, t.layer, model, t.example_id, t.dataset, t.label, cls, list_dot_product(t.vector, w) + ln(0.5::DOUBLE) - 0.5 * list_dot_product(w, m) AS s
       FROM {rows} t JOIN pw ON t.layer = pw.layer),
pr{n} AS (SELECT *, exp(s - max(s) OVER o) AS e FROM lg{n} WINDOW o AS (PARTITION BY combo, layer, model, example_id)),
ft{n} AS (SELECT combo AS grp, example_id AS rid, any_value(dataset) AS dataset, any_value(label) AS y, list_append(list(prob ORDER BY layer, model), 1.0::DOUBLE) AS x
       FROM (SELECT *, e / sum(e) OVER (PARTITION BY combo, layer, model, example_id) AS prob FROM pr{n}) WHERE cls = 1 GROUP BY combo, example_id)"""
    for n, rows in ((1, "tr"), (2, "te"))) + """,
fit AS (SELECT ft1.* FROM ft1 JOIN combos ON combos.combo = ft1.grp AND combos.dataset = ft1.dataset),
cs AS (SELECT DISTINCT grp, 0.1::DOUBLE AS C FROM fit),""" + l1_ctes("fit", "cs", steps=1500) + """,
preds AS (SELECT f.grp AS layer, dataset, y AS label, round(1 / (1 + exp(-list_dot_product(x, w))), 9) AS score FROM ft2 f JOIN l1 ON l1.grp = f.grp)"""
    + CONFUSION_SQL + RANK_SQL + """
SELECT layer AS combo, dataset, """ + RECORD_SQL, "signal_vectors")


@register("shared_covariance_stack", SHARED_COVARIANCE_SQL)
def q_shared_covariance_stack(spark, sf):
    """Score records of the stack with one covariance a dataset combination and each member's own means."""
    tr, te = signal_split(spark, sf)
    return _rounded(combos.shared_covariance_stack(tr, te))
