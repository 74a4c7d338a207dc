"""Registered queries: sampling (SP1-SP7) and pooling (V1-V3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from protolens.operators import pooling as PO
from protolens.operators import sampling as SP
from protolens.plans.catalog import register
from protolens.plans.common import layer_vectors, long_array
from protolens.sources import fixtures as fx
from protolens.sources.fixtures import with_views

_MD5 = "md5(concat(CAST({id} AS VARCHAR), ':{seed}'))"


def _h(id_col="example_id", seed=42):
    return _MD5.format(id=id_col, seed=seed)


def _layer1(spark, sf):
    return layer_vectors(spark, sf).where("layer = 1")


# SP1 --------------------------------------------------------------------------
@register("sample_fraction", with_views(f"""
WITH v AS (SELECT example_id FROM vectors WHERE layer = 1),
r AS (SELECT example_id, row_number() OVER (ORDER BY {_h()}, example_id) AS rn FROM v)
SELECT example_id FROM r WHERE rn <= (SELECT round_even(0.9 * count(*), 0) FROM v)""", "vectors"))
def q_sample_fraction(spark, sf):
    return SP.sample_fraction(_layer1(spark, sf), 0.9, "example_id", 42).select("example_id")


# SP2 --------------------------------------------------------------------------
@register("sample_per_class", with_views(f"""
WITH r AS (SELECT example_id, label, row_number() OVER (PARTITION BY label ORDER BY {_h()}, example_id) AS rn
           FROM vectors WHERE layer = 1 AND split = 'train')
SELECT example_id, label, CAST(rn AS BIGINT) AS rank FROM r WHERE rn <= 30""", "vectors"))
def q_sample_per_class(spark, sf):
    tr = _layer1(spark, sf).where("split = 'train'")
    s = SP.sample_per_class(tr, 30, [], "label", "example_id", 42, rank_col="rank")
    return s.select("example_id", "label", "rank")


# SP3 --------------------------------------------------------------------------
@register("shuffle_take", f"""
SELECT doc_id FROM documents ORDER BY {_h('doc_id')}, doc_id LIMIT 100""")
def q_shuffle_take(spark, sf):
    return SP.shuffle_take(fx.table(spark, sf, "documents"), 100, "doc_id", 42).select("doc_id")


# SP4 --------------------------------------------------------------------------
@register("sample_per_task", f"""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_h('doc_id')}, doc_id) AS rn FROM documents)
SELECT doc_id, source FROM r WHERE rn <= 5""")
def q_sample_per_task(spark, sf):
    d = fx.table(spark, sf, "documents")
    return SP.sample_per_class(d, 5, [], "source", "doc_id", 42).select("doc_id", "source")


# SP5 --------------------------------------------------------------------------
@register("paired_sample", f"""
WITH a AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND length(text) % 2 = 0),
b AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND length(text) % 2 = 1),
ids AS (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM a) JOIN (SELECT DISTINCT conv_id FROM b) USING (conv_id)
        ORDER BY {_h('conv_id')}, conv_id LIMIT 20)
SELECT conv_id, turn, 'safe' AS side FROM a WHERE conv_id IN (SELECT conv_id FROM ids)
UNION ALL SELECT conv_id, turn, 'harmful' FROM b WHERE conv_id IN (SELECT conv_id FROM ids)""")
def q_paired_sample(spark, sf):
    c = fx.table(spark, sf, "conversations").where("role = 'assistant'")
    a = c.where(F.length("text") % 2 == 0).select("conv_id", "turn")
    b = c.where(F.length("text") % 2 == 1).select("conv_id", "turn")
    sa, sb = SP.paired_sample(a, b, "conv_id", 20, 42)
    return sa.withColumn("side", F.lit("safe")).unionByName(sb.withColumn("side", F.lit("harmful")))


# SP6 --------------------------------------------------------------------------
@register("balanced_take", with_views(f"""
WITH r AS (SELECT example_id, label, row_number() OVER (PARTITION BY label ORDER BY {_h()}, example_id) AS rn FROM doc_vectors)
SELECT example_id, label FROM r WHERE rn <= 20 AND label IN (0, 1)""", "doc_vectors"))
def q_balanced_take(spark, sf):
    return SP.sample_per_class(fx.doc_vectors(spark, sf), 20, [], "label", "example_id", 42) \
        .where(F.col("label").isin(0, 1)).select("example_id", "label")


# SP7 --------------------------------------------------------------------------
@register("seed_size_grid", with_views("""
WITH seeds AS (SELECT unnest([0, 1, 2, 3, 4]) AS seed), sizes AS (SELECT unnest([10, 50, 100, 500, 1000, 5000, 10000, 20000, 40000]) AS size),
e AS (SELECT DISTINCT example_id, label FROM vectors WHERE split = 'train'),
r AS (SELECT example_id, label, seed,
             row_number() OVER (PARTITION BY seed, label ORDER BY md5(concat(CAST(example_id AS VARCHAR), ':', CAST(seed AS VARCHAR))), example_id) AS rn
      FROM e, seeds)
SELECT CAST(seed AS INTEGER) AS seed, CAST(size AS INTEGER) AS size, label, example_id FROM r, sizes WHERE rn <= size""",
                                      "vectors"))
def q_seed_size_grid(spark, sf):
    """All seeds and sizes of the sweep, over every training example; a size beyond a class takes all of it."""
    ids = fx.vectors(spark, sf).where("split = 'train'").select("example_id", "label").distinct()
    g = SP.seed_size_grid(ids, [0, 1, 2, 3, 4], [10, 50, 100, 500, 1000, 5000, 10000, 20000, 40000], [], "label", "example_id")
    return g.select("seed", "size", "label", "example_id")


# V1-V3 ------------------------------------------------------------------------
_TOK = """
te AS (SELECT example_id, pos, mask, CAST(unnest(range(len(vector))) AS INTEGER) AS i, unnest(vector) AS x FROM token_vectors)"""


@register("pool_last_token", with_views(f"""
WITH {_TOK},
lp AS (SELECT example_id, max(pos) AS mp FROM token_vectors WHERE mask = 1 GROUP BY example_id)
SELECT te.example_id, te.i, round(te.x, 6) AS value FROM te JOIN lp ON te.example_id = lp.example_id AND te.pos = lp.mp""",
                                        "token_vectors"))
def q_pool_last_token(spark, sf):
    return long_array(PO.pool_last_token(fx.token_vectors(spark, sf)), ["example_id"], "vector")


@register("pool_masked_mean", with_views(f"""
WITH {_TOK}
SELECT example_id, i, round(sum(x * mask) / sum(mask), 6) AS value FROM te GROUP BY example_id, i HAVING sum(mask) > 0""",
                                         "token_vectors"))
def q_pool_masked_mean(spark, sf):
    return long_array(PO.pool_masked_mean(fx.token_vectors(spark, sf)), ["example_id"], "vector")


@register("pool_last_k_mean", with_views(f"""
WITH {_TOK},
lp AS (SELECT example_id, max(pos) AS mp FROM token_vectors WHERE mask = 1 GROUP BY example_id)
SELECT te.example_id, te.i, round(avg(te.x), 6) AS value FROM te JOIN lp USING (example_id)
WHERE te.mask = 1 AND te.pos > lp.mp - 2 GROUP BY te.example_id, te.i""", "token_vectors"))
def q_pool_last_k_mean(spark, sf):
    return long_array(PO.pool_last_k_mean(fx.token_vectors(spark, sf), 2), ["example_id"], "vector")
