"""Registered queries: contrastive directions and conditions.

Pairs: the i-th positive with the i-th negative example in seeded hash order
(J10), with their vectors per layer.  Directions for the strict checks of
similarity / behaviour queries are class-mean differences (expressible in
SQL); principal directions are checked on the 2-dim slice (closed form).
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolens.functions import vec as V
from protolens.operators import contrast as CT
from protolens.operators.corpus import contrastive_zip
from protolens.plans.catalog import register
from protolens.plans.common import layer_vectors, long_array, rnd
from protolens.sources import fixtures as fx
from protolens.sources.fixtures import with_views

THRESHOLD = 0.2


def _vecs(spark, sf) -> DataFrame:
    return layer_vectors(spark, sf)


def _pairs(spark, sf) -> DataFrame:
    v = _vecs(spark, sf)
    ids = contrastive_zip(v.where("layer = 1").select("example_id", "label"), "example_id", "label")
    return CT.pair_vectors(v, ids, ["layer"])


def mean_diff_direction(rows: DataFrame, keys=("layer",), label: str = "label", vec: str = "vector") -> DataFrame:
    """Condition / behaviour vector used by the checks: mean(label 1) - mean(label 0) per layer."""
    keys = list(keys)
    m = rows.groupBy(*keys).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vec)), F.when(F.col(label) == 1, 1.0).otherwise(0.0)))
        .alias("m1"),
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vec)), F.when(F.col(label) == 0, 1.0).otherwise(0.0)))
        .alias("m0"))
    return m.select(*keys, V.sub("m1", "m0").alias("direction"))


def _sims(spark, sf) -> DataFrame:
    v = _vecs(spark, sf)
    return CT.condition_similarity(v, mean_diff_direction(v), ["layer"])


_BASE = """
vv AS (SELECT example_id, layer, label, vector FROM vectors WHERE layer <> 0),
r AS (SELECT example_id, label, row_number() OVER (PARTITION BY label
        ORDER BY md5(concat(CAST(example_id AS VARCHAR), ':42')), example_id) AS rk FROM vectors WHERE layer = 1),
pairs AS (SELECT p.rk AS rank, p.example_id AS pos_id, n.example_id AS neg_id FROM r p JOIN r n
          ON p.rk = n.rk AND p.label = 1 AND n.label = 0),
pv AS (SELECT pairs.rank, pairs.pos_id, pairs.neg_id, a.layer, a.vector AS pos, b.vector AS neg
       FROM pairs JOIN vv a ON a.example_id = pairs.pos_id JOIN vv b ON b.example_id = pairs.neg_id AND b.layer = a.layer),
pe AS (SELECT layer, rank, pos_id, neg_id, CAST(unnest(range(len(pos))) AS INTEGER) AS i, unnest(pos) AS a, unnest(neg) AS b FROM pv)"""


def _sql(body: str) -> str:
    sql = with_views("WITH " + _BASE + ",\n" + body, "vectors")
    return sql.replace("WITH ", "WITH RECURSIVE ", 1) if "pw_" in body else sql


# C1 ---------------------------------------------------------------------------
@register("contrast_matrix_diff", _sql("""
x AS (SELECT 1)
SELECT layer, CAST(rank AS BIGINT) AS rank, i, round(a - b, 6) AS value FROM pe"""))
def q_contrast_matrix_diff(spark, sf):
    d = CT.contrast_matrix_diff(_pairs(spark, sf))
    return long_array(d, ["layer", "rank"], "vector")


# C2 ---------------------------------------------------------------------------
@register("contrast_matrix_center", _sql("""
mem AS (SELECT layer, pos_id AS example_id, i, a AS x FROM pe UNION ALL SELECT layer, neg_id, i, b FROM pe),
mu AS (SELECT layer, i, avg(x) AS m FROM mem GROUP BY ALL)
SELECT mem.layer, mem.example_id, mem.i, round(mem.x - mu.m, 6) AS value FROM mem JOIN mu USING (layer, i)"""))
def q_contrast_matrix_center(spark, sf):
    p = _pairs(spark, sf)
    members = p.select("layer", F.col("pos_id").alias("example_id"), F.col("pos").alias("vector")).unionByName(
        p.select("layer", F.col("neg_id").alias("example_id"), F.col("neg").alias("vector")))
    c = CT.contrast_matrix_center(members, ["layer"])
    return long_array(c, ["layer", "example_id"], "vector")


# C3 ---------------------------------------------------------------------------
@register("contrast_matrix_pairwise", _sql("""
x AS (SELECT 1)
SELECT layer, CAST(rank AS BIGINT) AS rank, 0 AS side, i, round(a - (a + b) / 2, 6) AS value FROM pe
UNION ALL SELECT layer, CAST(rank AS BIGINT), 1, i, round(b - (a + b) / 2, 6) FROM pe"""))
def q_contrast_matrix_pairwise(spark, sf):
    c = CT.contrast_matrix_pairwise(_pairs(spark, sf))
    return long_array(c, ["layer", "rank", "side"], "vector")


# C4-C6, C16 -------------------------------------------------------------------
def _axis(source: str, name: str) -> str:
    """Largest axis of the matrices ``source`` (layer, m[][]): ``name`` (layer, v[], l).

    Repeated squaring, scaled by the trace, tends to v v^T; the entry of largest size is made positive."""
    return f"""
pw_{name} AS (SELECT layer, 0 AS k, m FROM {source}
  UNION ALL
  SELECT layer, k + 1, list_transform(q, lambda r: list_transform(r, lambda x: x / t))
  FROM (SELECT layer, k, q, list_sum(list_transform(range(1, len(q) + 1), lambda c: q[c][c])) AS t
        FROM (SELECT layer, k, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b))) AS q
              FROM pw_{name} WHERE k < 40))),
top_{name} AS (SELECT layer, m, list_transform(range(1, len(m) + 1), lambda c: m[c][c]) AS g FROM pw_{name} WHERE k = 40),
unit_{name} AS (SELECT layer, list_transform(m[list_position(g, list_max(g))], lambda x: x / sqrt(list_max(g))) AS v FROM top_{name}),
{name} AS (SELECT layer, v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l
           FROM unit_{name} JOIN {source} USING (layer))"""


_PCA = """
tr AS (SELECT layer, rank, 0 AS side, list_transform(range(1, len(pos) + 1), lambda c: (pos[c] - neg[c]) / 2) AS x FROM pv
       UNION ALL SELECT layer, rank, 1, list_transform(range(1, len(pos) + 1), lambda c: (neg[c] - pos[c]) / 2) FROM pv),
te AS (SELECT layer, rank, side, unnest(range(len(x))) AS i, unnest(x) AS x FROM tr),
mu AS (SELECT layer, i, avg(x) AS m FROM te GROUP BY ALL),
tc AS (SELECT te.layer, rank, side, te.i, x - m AS x FROM te JOIN mu ON te.layer = mu.layer AND te.i = mu.i),
ce AS (SELECT a.layer, a.i, b.i AS j, sum(a.x * b.x) / (count(*) - 1) AS c
       FROM tc a JOIN tc b ON a.layer = b.layer AND a.rank = b.rank AND a.side = b.side GROUP BY a.layer, a.i, b.i),
cr AS (SELECT layer, i, list(c ORDER BY j) AS r FROM ce GROUP BY layer, i),
cm AS (SELECT layer, list(r ORDER BY i) AS m FROM cr GROUP BY layer),
tt AS (SELECT layer, sum(c) AS t FROM ce WHERE i = j GROUP BY layer),""" + _axis("cm", "ax") + """,
dirs AS (SELECT layer, v AS d, l / t AS evr FROM ax JOIN tt USING (layer)),
votes AS (SELECT pv.layer,
                 avg(CAST(list_dot_product(pos, d) < list_dot_product(neg, d) AS DOUBLE)) AS sm,
                 avg(CAST(list_dot_product(pos, d) > list_dot_product(neg, d) AS DOUBLE)) AS lg
          FROM pv JOIN dirs USING (layer) GROUP BY pv.layer),
od AS (SELECT layer, CASE WHEN sm > lg THEN list_transform(d, lambda x: -x) ELSE d END AS d, evr FROM dirs JOIN votes USING (layer))"""

_OD = _PCA + """
SELECT layer, CAST(unnest(range(len(d))) AS INTEGER) AS i, round(unnest(d), 6) AS value FROM od"""


def _directions(spark, sf, oriented=True):
    p = _pairs(spark, sf)
    if oriented:
        return CT.read_directions(p, ["layer"]), p
    train = CT.contrast_matrix_pairwise(p)
    return CT.principal_directions(train, ["layer"], "vector", 1), p


@register("first_direction", _sql(_PCA + """
SELECT layer, CAST(unnest(range(len(d))) AS INTEGER) AS i, round(unnest(d), 6) AS value, round(evr, 6) AS evr FROM dirs"""))
def q_first_direction(spark, sf):
    d, _ = _directions(spark, sf, oriented=False)
    return long_array(d.withColumn("evr", rnd("evr")), ["layer", "evr"], "direction")


@register("orient_direction", _sql(_OD))
def q_orient_direction(spark, sf):
    d, _ = _directions(spark, sf)
    return long_array(d, ["layer"], "direction")


@register("project_direction", _sql(_PCA + """,
mem AS (SELECT layer, pos_id AS example_id, pos AS v FROM pv UNION ALL SELECT layer, neg_id, neg FROM pv)
SELECT mem.layer, mem.example_id, round(list_dot_product(v, d) / sqrt(list_dot_product(d, d)), 6) AS projection
FROM mem JOIN od USING (layer)"""))
def q_project_direction(spark, sf):
    d, p = _directions(spark, sf)
    mem = p.select("layer", F.col("pos_id").alias("example_id"), F.col("pos").alias("vector")).unionByName(
        p.select("layer", F.col("neg_id").alias("example_id"), F.col("neg").alias("vector")))
    pr = CT.project_direction(mem, d, ["layer"])
    return pr.select("layer", "example_id", rnd("projection").alias("projection"))


@register("explained_variance_scaling", _sql(_PCA + """
SELECT layer, CAST(unnest(range(len(d))) AS INTEGER) AS i, round(unnest(list_transform(d, lambda x: x * evr)), 6) AS value FROM od"""))
def q_explained_variance_scaling(spark, sf):
    d, _ = _directions(spark, sf)
    return long_array(CT.explained_variance_scaling(d), ["layer"], "direction")


# The second axis is the largest one of the matrix less its first ------------
@register("two_component_projection", _sql(_PCA + """,
cm2 AS (SELECT layer, list_transform(m, lambda r, a: list_transform(r, lambda x, b: x - l * v[a] * v[b])) AS m
        FROM cm JOIN ax USING (layer)),""" + _axis("cm2", "ay") + """,
mm AS (SELECT layer, list(m ORDER BY i) AS mu FROM mu GROUP BY layer),
mem AS (SELECT layer, pos_id AS example_id, pos AS x FROM pv UNION ALL SELECT layer, neg_id, neg FROM pv),
zz AS (SELECT layer, example_id, list_transform(x, lambda q, c: q - mu[c]) AS z FROM mem JOIN mm USING (layer))
SELECT zz.layer, zz.example_id, round(list_dot_product(z, d), 6) AS pc1, round(list_dot_product(z, v), 6) AS pc2,
       round(evr, 6) AS pc1_evr
FROM zz JOIN dirs ON zz.layer = dirs.layer JOIN ay ON zz.layer = ay.layer"""))
def q_two_component_projection(spark, sf):
    p = _pairs(spark, sf)
    train = CT.contrast_matrix_pairwise(p)
    mem = p.select("layer", F.col("pos_id").alias("example_id"), F.col("pos").alias("vector")).unionByName(
        p.select("layer", F.col("neg_id").alias("example_id"), F.col("neg").alias("vector")))
    pr = CT.two_component_projection(mem, train, ["layer"])
    return pr.select("layer", "example_id", rnd("pc1").alias("pc1"), rnd("pc2").alias("pc2"), rnd("pc1_evr").alias("pc1_evr"))


# C8-C11, C17 --------------------------------------------------------------------
_SIMS = """
vv AS (SELECT example_id, layer, label, vector FROM vectors WHERE layer <> 0),
ve AS (SELECT example_id, layer, label, CAST(unnest(range(len(vector))) AS INTEGER) AS i, unnest(vector) AS x FROM vv),
dm AS (SELECT layer, i, avg(x) FILTER (WHERE label = 1) - avg(x) FILTER (WHERE label = 0) AS v FROM ve GROUP BY layer, i),
dd AS (SELECT layer, sum(v * v) AS vv2 FROM dm GROUP BY layer),
hv AS (SELECT ve.example_id, ve.layer, sum(ve.x * dm.v) AS hdotv FROM ve JOIN dm USING (layer, i) GROUP BY ALL),
t AS (SELECT ve.example_id, ve.layer, ve.label, ve.x, tanh(dm.v * hv.hdotv / dd.vv2) AS y
      FROM ve JOIN dm USING (layer, i) JOIN hv USING (example_id, layer) JOIN dd USING (layer)),
sims AS (SELECT example_id, layer, any_value(label) AS label, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS sim
         FROM t GROUP BY example_id, layer)"""


def _sims_sql(body: str) -> str:
    return with_views("WITH " + _SIMS + ",\n" + body, "vectors")


@register("condition_similarity", _sims_sql("""
x AS (SELECT 1)
SELECT example_id, layer, round(sim, 6) AS similarity FROM sims"""))
def q_condition_similarity(spark, sf):
    return _sims(spark, sf).select("example_id", "layer", rnd("similarity").alias("similarity"))


@register("condition_met", _sims_sql(f"""
x AS (SELECT 1)
SELECT example_id, bool_or(sim > {THRESHOLD}) AS condition_met FROM sims WHERE layer IN (1, 3) GROUP BY example_id"""))
def q_condition_met(spark, sf):
    return CT.condition_met(_sims(spark, sf), [1, 3], THRESHOLD, "smaller")


_GRID = """,
combos AS (SELECT * FROM (VALUES (0, 1, '1', [1]), (1, 1, '2', [2]), (2, 1, '3', [3]), (3, 2, '1_2', [1, 2]),
                                  (4, 2, '1_3', [1, 3]), (5, 2, '2_3', [2, 3])) c(combo_idx, r, combo, layers)),
th AS (SELECT CAST(j AS INTEGER) AS j, 0.0 + CAST(j AS DOUBLE) * 0.01 AS t FROM range(100) r(j)),
per AS (SELECT s.example_id, c.combo_idx, any_value(s.label) AS y, max(s.sim) AS smax, min(s.sim) AS smin
        FROM sims s JOIN combos c ON list_contains(c.layers, s.layer) GROUP BY s.example_id, c.combo_idx),
cells AS (SELECT c.combo_idx, th.j, th.t, d.direction,
                 sum(CASE WHEN ((d.direction = 'smaller' AND p.smax > th.t) OR (d.direction = 'larger' AND p.smin <= th.t))
                           AND p.y = 1 THEN 1 ELSE 0 END) AS tp,
                 sum(CASE WHEN ((d.direction = 'smaller' AND p.smax > th.t) OR (d.direction = 'larger' AND p.smin <= th.t))
                           AND p.y = 0 THEN 1 ELSE 0 END) AS fp,
                 sum(CASE WHEN NOT ((d.direction = 'smaller' AND p.smax > th.t) OR (d.direction = 'larger' AND p.smin <= th.t))
                           AND p.y = 1 THEN 1 ELSE 0 END) AS fn
          FROM per p JOIN combos c USING (combo_idx), th, (VALUES ('larger', 0), ('smaller', 1)) d(direction, di)
          GROUP BY c.combo_idx, th.j, th.t, d.direction),
f AS (SELECT cells.*, c.r, c.combo, c.layers, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
             CASE WHEN direction = 'larger' THEN 0 ELSE 1 END AS di
      FROM cells JOIN combos c USING (combo_idx)),
best AS (SELECT * FROM f WHERE f1 > 0 ORDER BY f1 DESC, r, combo_idx, j, di LIMIT 1)"""


def _grid(spark, sf):
    sims, v = _sims(spark, sf), layer_vectors(spark, sf)
    layers = [r["layer"] for r in v.select("layer").distinct().orderBy("layer").collect()]  # one row a layer
    return sims, CT.grid_f1(sims, v.select("example_id", "label").distinct(), layers, max_layers=2, threshold_range=(0.0, 1.0), threshold_step=0.01)


@register("best_condition_point", _sims_sql("x AS (SELECT 1)" + _GRID + """
SELECT combo, round(t, 3) AS threshold, direction, round(f1, 6) AS f1 FROM best"""))
def q_best_condition_point(spark, sf):
    _, grid = _grid(spark, sf)
    b = CT.best_condition_point(grid)
    return b.select("combo", "threshold", "direction", rnd("f1").alias("f1"))


@register("condition_predictions", _sims_sql("x AS (SELECT 1)" + _GRID + """
SELECT s.example_id, CAST(bool_or(CASE WHEN b.direction = 'smaller' THEN s.sim > b.t ELSE s.sim <= b.t END) AS INTEGER) AS pred
FROM sims s JOIN best b ON list_contains(b.layers, s.layer) GROUP BY s.example_id"""))
def q_condition_predictions(spark, sf):
    sims, grid = _grid(spark, sf)
    return CT.condition_predictions(sims, CT.best_condition_point(grid))


@register("similarity_analysis", _sims_sql("x AS (SELECT 1)" + _GRID + """
SELECT combo, concat(printf('%.3f', t), '_', direction) AS setting, round(f1, 6) AS f1 FROM f WHERE f1 > 0"""))
def q_similarity_analysis(spark, sf):
    _, grid = _grid(spark, sf)
    g = grid.where(F.col("f1") > 0)
    return g.select("combo", F.concat(F.format_string("%.3f", "t"), F.lit("_"), F.col("direction")).alias("setting"),
                    rnd("f1").alias("f1"))


@register("layer_similarities_by_class", _sims_sql("""
x AS (SELECT 1)
SELECT layer, CASE WHEN label = 1 THEN 'positive' ELSE 'negative' END AS class, example_id, round(sim, 6) AS similarity,
       CAST((SELECT count(*) FROM range(100) r(j) WHERE 0.0::DOUBLE + CAST(j AS DOUBLE) * 0.01::DOUBLE < sim) AS INTEGER) AS bin FROM sims"""))
def q_layer_similarities_by_class(spark, sf):
    v = layer_vectors(spark, sf)
    layers = [r["layer"] for r in v.select("layer").distinct().collect()]  # one row a layer
    s = CT.similarities_by_class(_sims(spark, sf), v.select("example_id", "label").distinct(), layers)
    return s.select("layer", "class", "example_id", rnd("similarity").alias("similarity"), "bin")


# the whole search from principal directions: the same grid on other similarities
CONDITION_SEARCH_SQL = _sql(_PCA + """,
ve AS (SELECT vv.example_id, vv.layer, vv.label, unnest(vv.vector) AS x, unnest(od.d) AS v FROM vv JOIN od USING (layer)),
hv AS (SELECT example_id, layer, sum(x * v) / sum(v * v) AS c FROM ve GROUP BY ALL),
tv AS (SELECT ve.example_id, ve.layer, ve.label, ve.x, tanh(ve.v * hv.c) AS y FROM ve JOIN hv USING (example_id, layer)),
sims AS (SELECT example_id, layer, any_value(label) AS label, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS sim
         FROM tv GROUP BY example_id, layer)""" + _GRID + """
SELECT s.example_id, CAST(bool_or(CASE WHEN b.direction = 'smaller' THEN s.sim > b.t ELSE s.sim <= b.t END) AS INTEGER) AS pred
FROM sims s JOIN best b ON list_contains(b.layers, s.layer) GROUP BY s.example_id""")


# C12 ----------------------------------------------------------------------------
RULES = ["if C1 or C2 then B1", "if C1 and C3 then B2", "if C2 then B1", "if C3 and C4 then B2"]


def _flags(spark, sf):
    s = _sims(spark, sf)
    f = s.groupBy("example_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("layer", (F.col("similarity") > THRESHOLD).alias("met")))),
                    lambda t: t["met"]).alias("flags"))
    return f


@register("evaluate_rules", _sims_sql(f"""
c AS (SELECT example_id, bool_or(layer = 1 AND sim > {THRESHOLD}) AS c1, bool_or(layer = 2 AND sim > {THRESHOLD}) AS c2,
             bool_or(layer = 3 AND sim > {THRESHOLD}) AS c3 FROM sims GROUP BY example_id)
SELECT example_id, 0 AS rule_idx, 0 AS behavior_idx, c1 OR c2 AS satisfied FROM c
UNION ALL SELECT example_id, 1, 1, c1 AND c3 FROM c
UNION ALL SELECT example_id, 2, 0, c2 FROM c
UNION ALL SELECT example_id, 3, 1, false FROM c"""))
def q_evaluate_rules(spark, sf):
    return CT.evaluate_rules(_flags(spark, sf), CT.parse_rules(spark, RULES))


# C13 ----------------------------------------------------------------------------
@register("add_behavior", _sims_sql(f"""
met AS (SELECT example_id, bool_or(sim > {THRESHOLD}) AS m FROM sims WHERE layer IN (1, 3) GROUP BY example_id)
SELECT ve.example_id, ve.layer, ve.i,
       round(CASE WHEN ve.layer = 2 AND coalesce(met.m, false) THEN ve.x + 0.5 * dm.v ELSE ve.x END, 6) AS value
FROM ve JOIN dm USING (layer, i) LEFT JOIN met USING (example_id)"""))
def q_add_behavior(spark, sf):
    v = _vecs(spark, sf)
    cond = CT.condition_met(_sims(spark, sf), [1, 3], THRESHOLD, "smaller")
    beh = mean_diff_direction(v).where("layer = 2")
    out = CT.add_behavior(v.select("example_id", "layer", "vector"), beh, cond, ["layer"], strength=0.5)
    return long_array(out, ["example_id", "layer"], "vector")


# C14 ----------------------------------------------------------------------------
@register("norm_preserving_rescale", with_views("""
WITH te AS (SELECT example_id, pos, CAST(unnest(range(len(vector))) AS INTEGER) AS i, unnest(vector) AS x FROM token_vectors),
bv AS (SELECT i, avg(x) AS b FROM te JOIN token_vectors USING (example_id, pos) WHERE mask = 1 GROUP BY i),
nw AS (SELECT te.example_id, te.pos, te.i, te.x, te.x + bv.b AS y FROM te JOIN bv USING (i)),
nr AS (SELECT example_id, pos, sqrt(sum(x * x)) AS n0, sqrt(sum(y * y)) AS n1 FROM nw GROUP BY ALL),
trig AS (SELECT example_id, max(n1 / n0) > 1 OR bool_or(isnan(n1) OR isinf(n1)) AS tr FROM nr GROUP BY example_id)
SELECT nw.example_id, nw.pos, nw.i, round(CASE WHEN trig.tr THEN nw.y * nr.n0 / nr.n1 ELSE nw.y END, 6) AS value
FROM nw JOIN nr USING (example_id, pos) JOIN trig USING (example_id)""", "token_vectors"))
def q_norm_preserving_rescale(spark, sf):
    tv = fx.token_vectors(spark, sf)
    b = tv.where("mask = 1").agg(vector_to_array(Summarizer.mean(array_to_vector(F.col("vector")))).alias("b"))
    bvec = b.first()["b"]  # one behaviour vector: a d-sized parameter
    after = tv.withColumn("vector", V.add("vector", F.array(*[F.lit(float(x)) for x in bvec])))
    out = CT.norm_preserving_rescale(tv, after, ["example_id"], "pos")
    return long_array(out, ["example_id", "pos"], "vector")


# C15 ----------------------------------------------------------------------------
MULTI_RULES = ["if C1 or C2 then B1", "if C1 and C2 then B2"]


@register("multi_condition_behaviors", _sims_sql(f"""
c AS (SELECT example_id, bool_or(layer = 1 AND sim > {THRESHOLD}) AS c1, bool_or(layer = 3 AND sim <= 0.15) AS c2
      FROM sims GROUP BY example_id),
a AS (SELECT ve.example_id, ve.layer, ve.i, ve.x
             + CASE WHEN (c.c1 OR c.c2) AND ve.layer = 1 THEN 1.0 * dm.v ELSE 0 END
             + CASE WHEN (c.c1 AND c.c2) AND ve.layer IN (2, 3) THEN -0.5 * dm.v ELSE 0 END AS value
      FROM ve JOIN dm USING (layer, i) JOIN c USING (example_id))
SELECT example_id, layer, i, round(value, 6) AS value FROM a"""))
def q_multi_condition_behaviors(spark, sf):
    """Two conditions, two behaviours, rules applied in order (additive, so order-independent here)."""
    v = _vecs(spark, sf)
    dirs = mean_diff_direction(v)
    sims = _sims(spark, sf)
    c1 = sims.where("layer = 1").select("example_id", CT.condition_flag(F.col("similarity"), THRESHOLD, "smaller")
                                        .alias("c1"))
    c2 = sims.where("layer = 3").select("example_id", CT.condition_flag(F.col("similarity"), 0.15, "larger").alias("c2"))
    flags = c1.join(c2, "example_id").select("example_id", F.array("c1", "c2").alias("flags"))
    behaviors = [(0, [1], 1.0), (1, [2, 3], -0.5)]  # (behaviour, layers, strength) in rule order
    rows = CT.rule_behaviors(v.select("example_id", "layer", "vector"), flags, CT.parse_rules(spark, MULTI_RULES), dirs, behaviors)
    return long_array(rows, ["example_id", "layer"], "vector")
