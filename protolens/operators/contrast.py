"""Contrastive directions, condition similarity and threshold search (survey C1-C17).

Pairs are (layer, pair, pos, neg) rows.  Principal directions of narrow rows
come from the same additive Gram partials as the covariance statistics, those
of wide rows from block iteration on the rows (``subspace``).  The condition
grid search reduces rows to counts per (combination, score bin, label).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protolens.functions import vec as V
from protolens.operators import stats as S
from protolens.operators.params import attach_params, materialize
from protolens.operators.subspace import krylov_directions

DIRECTIONS = ("larger", "smaller")  # iteration order of the grid search


# ---------------------------------------------------------------- C1-C3
def pair_vectors(vectors: DataFrame, pairs: DataFrame, keys=("layer",), id_col: str = "example_id",
                 vec: str = "vector") -> DataFrame:
    """(keys..., rank, pos_id, neg_id, pos, neg) from a vector table and zipped id pairs (one row a rank).

    The ranks meet the vectors by id and both members of a pair by (keys, rank): wide vectors are shuffled once."""
    keys = list(keys)
    side = F.inline(F.array(F.struct(F.lit(0).alias("_side"), F.col("pos_id").alias(id_col)),
                            F.struct(F.lit(1).alias("_side"), F.col("neg_id").alias(id_col))))
    rows = attach_params(vectors.select(*keys, id_col, vec), pairs.select("rank", side), [id_col], uniform_keys=True)

    def member(i: int) -> Column:
        return F.first(F.when(F.col("_side") == i, F.struct(F.col(id_col), F.col(vec))), ignorenulls=True)

    both = rows.groupBy(*keys, "rank").agg(member(0).alias("_p"), member(1).alias("_n")).where("_p is not null and _n is not null")
    return both.select(*keys, "rank", F.col(f"_p.{id_col}").alias("pos_id"), F.col(f"_n.{id_col}").alias("neg_id"),
                       F.col(f"_p.{vec}").alias("pos"), F.col(f"_n.{vec}").alias("neg"))


def contrast_matrix_diff(pairs: DataFrame, keys=("layer",)) -> DataFrame:
    """Pos - neg per pair."""
    return pairs.select(*keys, "rank", V.sub("pos", "neg").alias("vector"))


def contrast_matrix_center(rows: DataFrame, keys=("layer",), vec: str = "vector") -> DataFrame:
    """Every row minus the global mean of its layer (means broadcast by measured size)."""
    keys = list(keys)
    m = rows.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vec)))).alias("_mu"))
    return attach_params(rows, m, keys).withColumn(vec, V.sub(vec, "_mu")).drop("_mu")


def contrast_matrix_pairwise(pairs: DataFrame, keys=("layer",)) -> DataFrame:
    """Both pair members minus their midpoint (the default method), as two rows per pair."""
    keys = list(keys)
    mid = V.midpoint("pos", "neg")
    two = F.inline(F.array(F.struct(F.lit(0).alias("side"), V.sub("pos", mid).alias("vector")),
                           F.struct(F.lit(1).alias("side"), V.sub("neg", mid).alias("vector"))))
    return pairs.select(*keys, "rank", two)


# ---------------------------------------------------------------- C4, C7
def _cov_rows(rows: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    merged = S.merge_gram(S.gram_partials(rows.select(*keys, vec), keys, vec), keys)
    scat = S._rows_to_scatter(merged, keys)
    return scat.select(*keys, "i", "n", V.scale("row", S._inv_dof("n")).alias("row"))


#: widths up to which the whole d x d matrix is cheaper than several passes over the rows
GRAM_MAX_DIM = 512


def principal_directions(rows: DataFrame, keys=("layer",), vec: str = "vector", k: int = 1, engine: str = "auto") -> DataFrame:
    """Top-k principal axes of the column-centred rows per key and their explained variance ratios.

    ``engine``: 'gram' (d x d matrix and its eigenvectors), 'krylov' (block iteration on the rows, block x d numbers a
    task) or 'auto' (by width).  Sign convention before orientation: the largest-magnitude entry is positive.
    Output: (keys..., component INT, direction ARRAY<DOUBLE>, evr DOUBLE, variance DOUBLE).
    """
    keys = list(keys)
    if engine == "auto":
        width = rows.select(F.size(vec).alias("d")).limit(1).collect()
        engine = "krylov" if width and width[0].d > GRAM_MAX_DIM else "gram"
    if engine == "krylov":
        return krylov_directions(rows, keys, vec, k)
    cov = _cov_rows(rows, keys, vec)
    schema = T.StructType([rows.schema[c] for c in keys] + [
        T.StructField("component", T.IntegerType()), T.StructField("direction", T.ArrayType(T.DoubleType())),
        T.StructField("evr", T.DoubleType()), T.StructField("variance", T.DoubleType())])

    def eig(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        c = np.stack(pdf["row"].to_numpy()).astype(np.float64)
        w, v = np.linalg.eigh(c)
        order = np.argsort(w)[::-1]
        total = float(np.sum(w))
        out = []
        for comp, idx in enumerate(order[:k]):
            d = v[:, idx]
            if d[np.argmax(np.abs(d))] < 0:
                d = -d
            out.append({**{kk: pdf[kk].iloc[0] for kk in keys}, "component": comp, "direction": d.tolist(),
                        "evr": float(w[idx] / total) if total > 0 else float("nan"), "variance": float(w[idx])})
        return pd.DataFrame(out, columns=[f.name for f in schema.fields])

    return cov.groupBy(*keys).applyInPandas(eig, schema)


def project_direction(rows: DataFrame, directions: DataFrame, keys=("layer",), vec: str = "vector",
                      out: str = "projection") -> DataFrame:
    """(x . v) / |v|."""
    keys = list(keys)
    d = directions.select(*keys, F.col("direction").alias("_v"))
    return attach_params(rows, d, keys).withColumn(out, V.fdiv(V.dot(vec, "_v"), V.norm("_v"))).drop("_v")


def orient_direction(directions: DataFrame, pairs: DataFrame, keys=("layer",)) -> DataFrame:
    """Flip v where positives project below negatives more often than above."""
    keys = list(keys)
    d = directions.select(*keys, "direction")
    j = attach_params(pairs, d, keys)
    pp = V.fdiv(V.dot("pos", "direction"), V.norm("direction"))
    pn = V.fdiv(V.dot("neg", "direction"), V.norm("direction"))
    votes = j.groupBy(*keys).agg(F.avg((pp < pn).cast("double")).alias("_smaller"),
                                 F.avg((pp > pn).cast("double")).alias("_larger"))
    o = directions.join(votes, keys, "left")
    flip = F.coalesce(F.col("_smaller") > F.col("_larger"), F.lit(False))
    return o.withColumn("direction", F.when(flip, V.scale("direction", -1.0)).otherwise(F.col("direction"))) \
        .drop("_smaller", "_larger")


def read_directions(pairs: DataFrame, keys=("layer",), method: str = "pca_pairwise") -> DataFrame:
    """C1-C6 end to end: contrast matrix -> first component -> orientation: (keys..., direction, evr)."""
    keys = list(keys)
    if method == "pca_diff":
        train = contrast_matrix_diff(pairs, keys)
    elif method == "pca_center":
        members = pairs.select(*keys, F.col("pos").alias("vector")).unionByName(
            pairs.select(*keys, F.col("neg").alias("vector")))
        train = contrast_matrix_center(members, keys)
    elif method == "pca_pairwise":
        train = contrast_matrix_pairwise(pairs, keys)
    else:
        raise ValueError("unknown method " + method)
    d = principal_directions(train, keys, "vector", 1).where(F.col("component") == 0)
    return orient_direction(d, pairs, keys).select(*keys, "direction", "evr")


def two_component_projection(rows: DataFrame, train: DataFrame, keys=("layer",), vec: str = "vector") -> DataFrame:
    """Centred projection of all rows on the first two components, plus PC1's variance ratio."""
    keys = list(keys)
    comps = principal_directions(train, keys, vec, 2)
    mean = train.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vec)))).alias("_mu"))
    packed = comps.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("component", "direction"))), lambda t: t["direction"])
        .alias("_pcs"), F.max(F.when(F.col("component") == 0, F.col("evr"))).alias("pc1_evr"))
    j = attach_params(attach_params(rows, mean, keys), packed, keys)
    centred = V.sub(vec, "_mu")
    return j.select("*", V.dot(centred, F.element_at("_pcs", 1)).alias("pc1"),
                    V.dot(centred, F.element_at("_pcs", 2)).alias("pc2")).drop("_mu", "_pcs")


# ---------------------------------------------------------------- C8, C9
def condition_similarity(rows: DataFrame, directions: DataFrame, keys=("layer",), vec: str = "vector",
                         out: str = "similarity") -> DataFrame:
    """cos(h, tanh(P h)) with P = v v^T / (v . v); P h = v (v . h) / (v . v), no d x d matrix."""
    keys = list(keys)
    d = directions.select(*keys, F.col("direction").alias("_v"))
    j = attach_params(rows, d, keys)
    coef = V.fdiv(V.dot("_v", vec), V.dot("_v", "_v"))
    proj = F.transform("_v", lambda x: F.tanh(x * coef))
    return j.withColumn(out, V.cosine(vec, proj)).drop("_v")


def condition_flag(sim: Column, threshold: float | Column, direction: str, strict: bool = False) -> Column:
    """C9: 'smaller' -> sim > t; 'larger' -> sim <= t (grid form) or sim < t (``strict``, layer hook form)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    if direction == "smaller":
        return sim > t
    return (sim < t) if strict else (sim <= t)


def condition_met(sims: DataFrame, layers: Sequence[int], threshold: float, direction: str,
                  id_col: str = "example_id", sim: str = "similarity", strict: bool = False) -> DataFrame:
    """OR over the condition layers per example."""
    s = sims.where(F.col("layer").isin([int(x) for x in layers]))
    return s.groupBy(id_col).agg(F.bool_or(condition_flag(F.col(sim), threshold, direction, strict))
                                 .alias("condition_met"))


# ---------------------------------------------------------------- C10, C17
def threshold_grid(spark, lo: float, hi: float, step: float) -> DataFrame:
    """Thresholds lo + j*step (j = 0..) below hi, computed in double like numpy.arange."""
    n = int(np.ceil((hi - lo) / step))
    return spark.range(n).select(F.col("id").cast("int").alias("j"),
                                 (F.lit(float(lo)) + F.col("id").cast("double") * F.lit(float(step))).alias("t"))


#: examples whose bins a task holds while it counts them for every combination
HELD_EXAMPLES = 1 << 19


def _combination_counts(bins: DataFrame, layers: Sequence[int], max_layers: int, nt: int) -> DataFrame:
    """(combo_idx, combo, counts): for every combination of up to ``max_layers`` layers, in search order, how many examples
    have label 0 or 1 and their largest (smallest) bin at 0..nt, as one array in the order (kind, label, bin).

    ``bins``: (y, b ARRAY<INT>) with one bin a layer, null where there is none.  A task holds the bins of its examples
    as a small integer matrix and takes maxima of two of its columns at a time: no example is copied for a combination.
    """
    layers, held = [int(x) for x in layers], HELD_EXAMPLES
    wide = nt + 2  # a bin of its own for examples without any layer of the combination
    schema = "combo_idx int, combo array<int>, counts array<double>"

    def count(y: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        base = y.astype(np.int64) * wide
        low, high = np.where(b < 0, 0, b + 1).astype(np.int32), np.where(b < 0, nt + 1, b).astype(np.int32)
        found: list[tuple] = []

        def walk(first: int, picked: tuple, top: np.ndarray | None, bottom: np.ndarray | None) -> None:
            for x in range(first, len(layers)):
                t = low[:, x] if top is None else np.maximum(top, low[:, x])
                m = high[:, x] if bottom is None else np.minimum(bottom, high[:, x])
                # bins moved by one for the maximum: its place 0 and the minimum's place nt + 1 are of no use
                largest = np.bincount(base + t, minlength=2 * wide).reshape(2, wide)[:, 1:]
                smallest = np.bincount(base + m, minlength=2 * wide).reshape(2, wide)[:, :-1]
                found.append((len(picked) + 1, (*picked, x), np.stack([largest, smallest]).ravel()))
                if len(picked) + 1 < max_layers:
                    walk(x + 1, (*picked, x), t, m)

        walk(0, (), None, None)
        for a in range(0, len(found), 1000):
            part = found[a:a + 1000]
            yield pa.RecordBatch.from_arrays([
                pa.array([place[p] for _, p, _ in part], pa.int32()), pa.array([[layers[x] for x in p] for _, p, _ in part], pa.list_(pa.int32())),
                pa.array([c.astype(np.float64) for _, _, c in part], pa.list_(pa.float64()))], ["combo_idx", "combo", "counts"])

    place = {p: i for i, p in enumerate(p for r in range(1, min(max_layers, len(layers)) + 1) for p in itertools.combinations(range(len(layers)), r))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ys, bs, n = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ys.append(np.asarray(batch.column("y")))
            flat = batch.column("b").flatten()
            bs.append(np.asarray(pc.fill_null(flat, -1)).reshape(batch.num_rows, -1))
            n += batch.num_rows
            if n >= held:
                yield from count(np.concatenate(ys), np.concatenate(bs))
                ys, bs, n = [], [], 0
        if n:
            yield from count(np.concatenate(ys), np.concatenate(bs))

    counted = bins.mapInArrow(run, schema)
    return counted.groupBy("combo_idx", "combo").agg(vector_to_array(Summarizer.sum(array_to_vector("counts"))).alias("counts"))


def grid_f1(sims: DataFrame, labels: DataFrame, layers: Sequence[int], max_layers: int = 1,
            threshold_range=(0.0, 1.0), threshold_step: float = 0.01, id_col: str = "example_id",
            sim: str = "similarity") -> DataFrame:
    """C17 grid: F1 for every (layer combination, threshold, direction).

    Per example and combination only max(sim) ('smaller' fires iff max > t)
    and min(sim) ('larger' fires iff min <= t) matter.  Each layer's similarity
    becomes the number of thresholds strictly below it; the bins of an example
    are one row, counted for all combinations where it stands, and TP/FP/FN of
    a threshold are sums of counts on one side of it.
    """
    layers = [int(x) for x in layers]
    grid = threshold_grid(sims.sparkSession, threshold_range[0], threshold_range[1], threshold_step)
    ts = [r.t for r in grid.orderBy("j").collect()]  # the threshold list: a parameter (bounded)
    nt, tarr = len(ts), F.array(*[F.lit(float(t)) for t in ts])
    slim = sims.where(F.col("layer").isin(layers)).select(
        F.col(id_col), "layer", F.when(F.col(sim).isNotNull(), F.size(F.filter(tarr, lambda t: t < F.col(sim)))).alias("_bin"))
    per = slim.groupBy(id_col).agg(F.array(*[F.max(F.when(F.col("layer") == x, F.col("_bin"))) for x in layers]).alias("b"))
    per = per.join(labels.select(id_col, F.col("label").cast("int").alias("y")), id_col).where(F.col("y").isin(0, 1))
    combos = materialize(_combination_counts(per.select("y", "b"), layers, max_layers, nt))

    def side(kind: int, y: int, lo: Column, n: Column) -> Column:
        """Examples of label ``y`` in ``n`` bins from ``lo`` on (kind 0: largest, 1: smallest bin)."""
        return V.vsum(F.slice("counts", (2 * kind + y) * (nt + 1) + 1 + lo, n)).cast("long")

    j = F.col("j")
    above, upto = (F.lit(nt) - j), (j + 1)  # bins above j, and bins up to j
    cells = combos.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nt - 1))))
    both = F.inline(F.array(  # 'smaller' fires at threshold j iff the largest bin is above j; 'larger' iff the smallest is not
        F.struct(F.lit("smaller").alias("direction"), side(0, 1, upto, above).alias("tp"), side(0, 0, upto, above).alias("fp"),
                 side(0, 1, F.lit(0), upto).alias("fn")),
        F.struct(F.lit("larger").alias("direction"), side(1, 1, F.lit(0), upto).alias("tp"), side(1, 0, F.lit(0), upto).alias("fp"),
                 side(1, 1, upto, above).alias("fn"))))
    cells = cells.select("combo_idx", F.size("combo").alias("r"), F.concat_ws("_", F.col("combo").cast("array<string>")).alias("combo"),
                         F.col("combo").alias("layers"), "j", F.element_at(tarr, j + 1).alias("t"), both)
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0,
                2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(F.lit(0.0))
    return cells.select("*", f1.alias("f1"))


def similarities_by_class(sims: DataFrame, labels: DataFrame, layers: Sequence[int], threshold_range=(0.0, 1.0),
                          threshold_step: float = 0.01, id_col: str = "example_id", sim: str = "similarity") -> DataFrame:
    """C17: the similarities of each layer by class, one row an example, and its number of thresholds below (its place in
    the search): (layer, class 'positive' / 'negative', id, similarity, bin)."""
    n = int(np.ceil((threshold_range[1] - threshold_range[0]) / threshold_step))
    ts = F.array(*[F.lit(float(threshold_range[0]) + j * float(threshold_step)) for j in range(n)])
    rows = sims.where(F.col("layer").isin([int(x) for x in layers])).select(id_col, "layer", sim)
    rows = rows.join(labels.select(id_col, F.col("label").cast("int").alias("_y")), id_col)
    return rows.select("layer", F.when(F.col("_y") == 1, "positive").otherwise("negative").alias("class"), id_col, sim,
                       F.size(F.filter(ts, lambda t: t < F.col(sim))).alias("bin"))


def best_condition_point(grid: DataFrame) -> DataFrame:
    """Best F1 cell, first in search order on ties, zero F1 ignored (top-1 is the feature)."""
    order = [F.col("f1").desc(), F.col("r"), F.col("combo_idx"), F.col("j"),
             F.when(F.col("direction") == DIRECTIONS[0], 0).otherwise(1)]
    best = grid.where(F.col("f1") > 0).orderBy(*order).limit(1)
    return best.select("layers", "combo", F.round("t", 3).alias("threshold"), "direction", "f1", "t")


def condition_predictions(sims: DataFrame, best: DataFrame, id_col: str = "example_id",
                          sim: str = "similarity") -> DataFrame:
    """C11: the best rule applied to every row (C9 meaning of the direction, Q8)."""
    b = best.select(F.explode("layers").alias("layer"), F.col("t").alias("_t"), F.col("direction").alias("_d"))
    j = sims.join(F.broadcast(b), "layer")  # the single best cell (top-1): at most L rows
    flag = F.when(F.col("_d") == "smaller", F.col(sim) > F.col("_t")).otherwise(F.col(sim) <= F.col("_t"))
    return j.groupBy(id_col).agg(F.bool_or(flag).cast("int").alias("pred"))


# ---------------------------------------------------------------- C12-C16
_INTEGER = r"^\s*([+-]?[0-9]+)\s*$"


def _whole(text: Column) -> Column:
    """A column of text as a zero-based number: the integer less one, -1 where it is none."""
    return F.coalesce(F.regexp_extract(text, _INTEGER, 1).try_cast("int") - 1, F.lit(-1))


def rule_columns(rule: Column) -> dict[str, Column]:
    """C12 grammar over a column of rules ``if <conditions> then B<n>``.

    conditions := words between "if" and the only "then", lower-cased; cN names condition N - 1.
    mode       := any, when the word "or" is there or no connective is (then the first word counts);
                  all, when only "and" is; never, when the rule has no or several "then".
    behaviour  := the number that follows the first B.
    """
    halves = F.split(rule, "then", -1)
    words = F.filter(F.split(F.replace(F.lower(halves[0]), F.lit("if"), F.lit("")), r"\s+"), lambda w: w != "")
    any_, all_ = F.array_contains(words, "or"), F.array_contains(words, "and")
    named = F.when(any_ | all_, F.filter(words, lambda w: ~w.isin("or", "and"))).otherwise(F.slice(words, 1, 1))
    number = F.transform(named, lambda w: F.when(w.startswith("c"), _whole(F.substr(w, F.lit(2)))).otherwise(F.lit(-1)))
    well = F.size(halves) == 2
    return {
        "behavior_idx": F.coalesce(_whole(F.try_element_at(F.split(rule, "B", -1), F.lit(2))), F.lit(-1)),
        "mode": F.when(~well, "never").when(all_ & ~any_, "all").otherwise("any"),
        "conditions": F.when(well, number).otherwise(F.array().cast("array<int>")),
    }


def parse_rules(spark, rules: Sequence[str]) -> DataFrame:
    """C12 rule table: (rule_idx, behavior_idx, mode, conditions ARRAY<INT>)."""
    table = spark.createDataFrame(list(enumerate(rules)), "rule_idx int, rule string")
    return table.select("rule_idx", *[c.alias(n) for n, c in rule_columns(F.col("rule")).items()])


def evaluate_rules(flags: DataFrame, rules: DataFrame, id_col: str = "example_id", flags_col: str = "flags") -> DataFrame:
    """Per example and rule, whether the rule holds; ``flags`` is ARRAY<BOOLEAN> (condition i at i).

    The rule table is parameter-sized: it is inlined as a literal array and
    exploded per example (a generator, no join).
    """
    lit_rules = F.array(*[F.struct(F.lit(r.rule_idx).alias("rule_idx"), F.lit(r.behavior_idx).alias("behavior_idx"),
                                   F.lit(r.mode).alias("mode"),
                                   F.array(*[F.lit(int(c)) for c in r.conditions]).cast("array<int>").alias("conditions"))
                          for r in rules.collect()])
    j = flags.select("*", F.inline(lit_rules))
    f = F.col(flags_col)

    def met(i):
        return F.when((i >= 0) & (i < F.size(f)), F.coalesce(F.element_at(f, i + 1), F.lit(False))).otherwise(F.lit(False))

    ok = F.when(F.col("mode") == "all", F.forall("conditions", met)) \
        .when(F.col("mode") == "any", F.exists("conditions", met)).otherwise(F.lit(False))
    return j.select(id_col, "rule_idx", "behavior_idx", ok.alias("satisfied"))


def rule_behaviors(rows: DataFrame, flags: DataFrame, rules: DataFrame, directions: DataFrame, behaviors: Sequence[tuple],
                   keys=("layer",), id_col: str = "example_id", vec: str = "vector") -> DataFrame:
    """Rules over condition flags switch behaviours on; each is added on its own layers, in the given order.

    ``behaviors``: (behavior_idx, layers, strength) in rule order."""
    fired = evaluate_rules(flags, rules, id_col).where("satisfied").groupBy(id_col).agg(F.collect_set("behavior_idx").alias("_fired"))
    switched = flags.select(id_col).distinct().join(fired, id_col, "left")
    for idx, layers, strength in behaviors:
        on = F.coalesce(F.array_contains("_fired", F.lit(idx)), F.lit(False))
        of_layers = directions.where(F.col(keys[0]).isin(list(layers)))
        rows = add_behavior(rows, of_layers, switched.select(id_col, on.alias("condition_met")), keys, id_col, vec, strength)
    return rows


def add_behavior(rows: DataFrame, behavior: DataFrame, condition: DataFrame | None, keys=("layer",),
                 id_col: str = "example_id", vec: str = "vector", strength: float = 1.0,
                 combine: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """H + strength * v on behaviour layers where the condition is met (always without a condition)."""
    keys = list(keys)
    comb = combine or (lambda h, v: V.add(h, v))
    b = behavior.select(*keys, F.col("direction").alias("_b"))
    j = attach_params(rows, b, keys, "left")
    if condition is not None:
        j = j.join(condition.select(id_col, "condition_met"), id_col, "left")
        on = F.coalesce(F.col("condition_met"), F.lit(False))
    else:
        on = F.lit(True)
    apply = on & F.col("_b").isNotNull()
    out = j.withColumn(vec, F.when(apply, comb(F.col(vec), V.scale("_b", float(strength)))).otherwise(F.col(vec)))
    return out.drop("_b", "condition_met") if condition is not None else out.drop("_b")


def norm_preserving_rescale(before: DataFrame, after: DataFrame, seq_keys=("example_id",), pos: str = "pos",
                            vec: str = "vector") -> DataFrame:
    """C14: if any position's norm grew (ratio > 1) or became NaN/Inf, rescale every position
    of that sequence back to its original norm."""
    seq_keys = list(seq_keys)
    b = before.select(*seq_keys, pos, V.norm(vec).alias("_n0"))
    j = after.join(b, seq_keys + [pos])
    j = j.withColumn("_n1", V.norm(vec))
    bad = F.isnan(F.col("_n1")) | (F.col("_n1") == float("inf"))
    w = Window.partitionBy(*seq_keys)  # one sequence: bounded by its length
    trig = (F.max(V.fdiv("_n1", "_n0")).over(w) > 1) | F.max(bad.cast("int")).over(w).cast("boolean")
    out = j.withColumn(vec, F.when(trig, V.scale(vec, V.fdiv("_n0", "_n1"))).otherwise(F.col(vec)))
    return out.drop("_n0", "_n1")


def explained_variance_scaling(directions: DataFrame, evr: str = "evr") -> DataFrame:
    """Direction x its layer's explained variance ratio (1 when unknown)."""
    return directions.withColumn("direction", V.scale("direction", F.coalesce(F.col(evr), F.lit(1.0))))
