"""Scores of example rows against model parameters that travel as raw float64 blocks.

A block is a row (keys..., kind, cls, sign, data): ``data`` holds the bytes of one vector (kind 0: a class mean, or its
weights) or of some rows of a matrix factor (kind 1, about ``BLOCK_BYTES``).  Python sees them as Arrow buffers, never as
lists of numbers.  All blocks of a model are read by ``fold`` functions that add up a batch's scores block by block, so
no worker needs a whole d x d matrix.

Two ways, by the measured size of all blocks.  Within ``protolens.maxBroadcastBytes`` they are broadcast once and the rows
are scanned once, without a shuffle.  Beyond it, example rows are dealt over salts of about ``HELD_BYTES`` of vectors,
every salt gets the blocks of its key, and both meet sorted, rows first: a task holds the vectors of one salt and
lets the blocks pass by.  With K matrices of width d a row costs K d^2 multiplications, which outweighs the copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protolens.operators.params import DEFAULT_MAX_BROADCAST_BYTES, attach_params, materialize, row_salt
from protolens.session import scratch_path

BLOCK_BYTES = 2 << 20
HELD_BYTES = 128 << 20
MEAN, FACTOR = 0, 1
ALL = -1  # class of a factor that every class of the key shares

#: (rows of vectors, [(kind, cls, sign, numbers)], state of these rows) -> None; the state gathers scores by class
Fold = Callable[[np.ndarray, list, dict], None]


def _schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + [
        T.StructField("kind", T.IntegerType()), T.StructField("cls", T.IntegerType()),
        T.StructField("sign", T.IntegerType()), T.StructField("data", T.BinaryType())])


def _vectors(col: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as a matrix over the column's own buffer."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), -1)


def vector_blocks(params: DataFrame, keys: Sequence[str], cls: str, vec) -> DataFrame:
    """One block of kind ``MEAN`` for each (keys, cls) row: the numbers of the array column ``vec``."""
    keys = list(keys)
    rows = params.select(*keys, F.lit(MEAN).alias("kind"), F.col(cls).cast("int").alias("cls"), F.lit(1).alias("sign"),
                         vec.cast("array<double>").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column("data")
            numbers, ends = np.asarray(data.flatten(), dtype=np.float64), np.cumsum(np.asarray(pc.list_value_length(data)))
            raw = [numbers[z - n:z].tobytes() for n, z in zip(np.diff(ends, prepend=0), ends)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(raw, pa.binary())], b.schema.names)

    return rows.mapInArrow(run, _schema(params, keys))


def factor_blocks(matrices: DataFrame, keys: Sequence[str], cls: str | None = None) -> DataFrame:
    """Blocks of kind ``FACTOR`` of the matrices (keys, [cls,] i, row): rows f and a sign with P = sum sign f f^T.

    The rows are those of L^T of the Cholesky factor P = L L^T, so that |L^T z|^2 = z^T P z.  A matrix that is not
    positive definite is taken apart by its eigenvectors instead, with negative signs where eigenvalues are negative; one
    with NaN gives NaN.  A group is one matrix, read from Arrow buffers and given back block by block.
    """
    keys = list(keys)
    by, limit = keys + ([cls] if cls else []), BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, p = None, None
        for b in batches:
            rows = _vectors(b.column("row"))
            if first is None:
                first, p = b.slice(0, 1).select(by), np.empty((rows.shape[1],) * 2)
            p[np.asarray(b.column("i"))] = rows
        d = p.shape[1]
        try:
            f, signs = np.linalg.cholesky(p).T, np.ones(d, int)
        except np.linalg.LinAlgError:
            if np.isfinite(p).all():
                w, v = np.linalg.eigh((p + p.T) / 2)
                f, signs = (v * np.sqrt(np.abs(w))).T, np.where(w < 0, -1, 1)
            else:
                f, signs = np.full((1, d), np.nan), np.ones(1, int)
        del p
        step = max(1, limit // (8 * d))
        of = pa.array([int(first.column(cls)[0].as_py()) if cls else ALL], pa.int32())
        for s in (1, -1):
            at = np.flatnonzero(signs == s)
            for a in range(0, len(at), step):
                yield pa.RecordBatch.from_arrays(
                    [*first.columns[:len(keys)], pa.array([FACTOR], pa.int32()), of, pa.array([s], pa.int32()),
                     pa.array([f[at[a:a + step]].tobytes()], pa.binary())], [*keys, "kind", "cls", "sign", "data"])

    return matrices.select(*by, "i", "row").groupBy(*by).applyInArrow(run, _schema(matrices, keys))


# ---------------------------------------------------------------- folds
def logits(x: np.ndarray, blocks: list, state: dict) -> None:
    """x w + b; a block is w followed by b."""
    wb = np.stack([v for _, _, _, v in blocks])
    scores = x @ wb[:, :-1].T + wb[:, -1]
    for (_, c, _, _), column in zip(blocks, scores.T):
        state[c] = column


def negative_distance(x: np.ndarray, blocks: list, state: dict) -> None:
    """Minus the distance to each mean, centred before squaring."""
    for _, c, _, m in blocks:
        z = x - m
        state[c] = -np.sqrt(np.einsum("ij,ij->i", z, z))


def mahalanobis_of(k: int | None) -> Fold:
    """Squared distances: sum of sign |f (x - mean)|^2 over the rows of a factor.

    Factor c belongs to the classes c k .. c k + k - 1 (to class c with k = 1), factor ``ALL`` to every class."""

    def fold(x: np.ndarray, blocks: list, state: dict) -> None:
        means = state.setdefault("means", {})
        for kind, c, sign, v in blocks:
            if kind == MEAN:
                means[c] = v
                state[c] = np.zeros(len(x))
                continue
            f = v.reshape(-1, x.shape[1])
            of = list(means) if c == ALL else [c * k + j for j in range(k) if c * k + j in means]
            origin = means[of[0]]  # near the rows: no cancellation for vectors with a large common offset
            z = (x - origin) @ f.T
            for j in of:
                u = z - f @ (means[j] - origin)
                state[j] += sign * np.einsum("ij,ij->i", u, u)

    return fold


mahalanobis = mahalanobis_of(1)


def _scores(state: dict) -> pa.Array:
    table = np.stack([state[c] for c in sorted(c for c in state if isinstance(c, int))], axis=1)
    n, k = table.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(table.ravel(), pa.float64()))


# ---------------------------------------------------------------- ways
def score(df: DataFrame, blocks: DataFrame, keys: Sequence[str], vec: str, out: str, fold: Fold,
          max_broadcast_bytes: int | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``, all by default) and ``out``, the scores by class id, for rows whose key has blocks.

    A row without a vector gets null."""
    keys, limit = list(keys), max_broadcast_bytes
    if limit is None:
        limit = int(df.sparkSession.conf.get("protolens.maxBroadcastBytes", str(DEFAULT_MAX_BROADCAST_BYTES)))
    keep = list(df.columns if keep is None else keep)
    blocks = _written(blocks)
    size = blocks.agg(F.sum(F.length("data"))).first()[0] or 0
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(T.DoubleType()))])
    df = df.select(*keep, *[c for c in (*keys, vec) if c not in keep])
    if size > limit:
        return _streamed(df, blocks, keys, vec, keep, schema, fold)
    return _broadcast(df, blocks, keys, vec, keep, schema, fold)


def _written(blocks: DataFrame) -> DataFrame:
    """As ``materialize``, in small row groups without dictionaries: a writer holds a few blocks, not a matrix."""
    path = scratch_path(blocks.sparkSession, "blocks")
    options = {"parquet.block.size": str(8 * BLOCK_BYTES), "parquet.block.row.count.limit": "8",
               "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false", "compression": "none"}
    blocks.write.mode("overwrite").options(**options).parquet(path)
    return blocks.sparkSession.read.schema(blocks.schema).parquet(path)


def _parsed(rows) -> list:
    return [(kind, cls, sign, np.frombuffer(data, dtype=np.float64)) for kind, cls, sign, data in rows]


def _part(part: pa.RecordBatch, blocks: list, vec: str, keep: list[str], names: list[str], fold: Fold) -> pa.RecordBatch:
    col = part.column(vec)
    valid = np.asarray(col.is_valid())
    state: dict = {}
    if valid.any():
        fold(_vectors(col if valid.all() else col.drop_null()), blocks, state)
        values = _scores(state)
    else:
        values = pa.array([], pa.list_(pa.float64()))
    return _with_scores(part, values, valid, keep, names)


def _with_scores(part: pa.RecordBatch, values: pa.Array, valid: np.ndarray, keep: list[str], names: list[str]) -> pa.RecordBatch:
    if not valid.all():
        at = np.cumsum(valid) - 1
        values = values.take(pa.array(at, pa.int64(), mask=~valid))
    return pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], values], names)


def _broadcast(df, blocks, keys, vec, keep, schema, fold) -> DataFrame:
    table = blocks.orderBy("kind", "cls").toArrow()  # within the measured limit
    models: dict = {}
    for *key, kind, cls, sign, data in zip(*(table.column(c).to_pylist() for c in (*keys, "kind", "cls", "sign", "data"))):
        models.setdefault(tuple(key), []).append((kind, cls, sign, data))
    shared, names = df.sparkSession.sparkContext.broadcast(models), [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict = {}
        for batch in batches:
            of: dict = {}
            for at, key in enumerate(zip(*(batch.column(k).to_pylist() for k in keys))):
                of.setdefault(key, []).append(at)
            for key, rows in of.items():
                if key not in parsed:
                    parsed[key] = _parsed(shared.value.get(key, ()))
                if parsed[key]:
                    yield _part(batch if len(of) == 1 else batch.take(pa.array(rows)), parsed[key], vec, keep, names, fold)

    return df.mapInArrow(run, schema)


def _streamed(df, blocks, keys, vec, keep, schema, fold) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = blocks.groupBy(*keys).agg(F.max(F.when(F.col("kind") == MEAN, F.length("data"))).alias("_bytes"))
    counts = attach_params(df.select(*keys, F.lit(1).alias("_one")).groupBy(*keys).agg(F.count("_one").alias("_rows")), known, keys)
    counts = materialize(counts.select(*keys, F.greatest(F.ceil(F.col("_rows") * F.col("_bytes") / HELD_BYTES), F.lit(1))
                                       .cast("int").alias("_salts")))
    salt = row_salt(df, keys, F.col("_salts"))
    rows = attach_params(df, counts, keys, materialized=True).withColumn("_salt", salt).drop("_salts")
    copies = attach_params(blocks, counts, keys, materialized=True).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    rows = rows.withColumns({"kind_": F.lit(-1), "cls_": F.lit(None).cast("int"), "sign_": F.lit(None).cast("int"), "data_": F.lit(None).cast("binary")})
    copies = copies.select(*keys, "_salt", *[F.col(c).alias(f"{c}_") for c in ("kind", "cls", "sign", "data")])
    both = rows.unionByName(copies, allowMissingColumns=True)
    both = both.repartition(parts, *keys, "_salt").sortWithinPartitions(*keys, "_salt", "kind_", "cls_")
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts_, x, valid, state = None, [], None, None, {}

        def close() -> Iterator[pa.RecordBatch]:
            if not parts_:
                return
            whole = _scores(state) if len(x) else pa.array([], pa.list_(pa.float64()))
            a = 0
            for p, v in zip(parts_, valid):
                n = int(v.sum())
                yield _with_scores(p, whole.slice(a, n), v, keep, names)
                a += n

        for batch in batches:
            key = list(zip(*(batch.column(c).to_pylist() for c in (*keys, "_salt"))))
            kind = np.asarray(batch.column("kind_"))
            is_row = kind < 0
            cuts = [0, *[k for k in range(1, len(key)) if key[k] != key[k - 1] or is_row[k] != is_row[k - 1]], len(key)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi == lo:
                    continue
                if key[lo] != held:
                    yield from close()
                    held, parts_, x, valid, state = key[lo], [], None, [], {}
                part = batch.slice(lo, hi - lo)
                if is_row[lo]:
                    parts_.append(part.select([*keep, *([vec] if vec not in keep else [])]))
                    valid.append(np.asarray(part.column(vec).is_valid()))
                elif parts_:
                    if x is None:
                        rows_ = [_vectors(p.column(vec).drop_null()) for p, v in zip(parts_, valid) if v.any()]
                        x = np.concatenate(rows_) if rows_ else np.zeros((0, 0))
                    if len(x):
                        fold(x, _parsed(zip(*(part.column(c).to_pylist() for c in ("kind_", "cls_", "sign_", "data_")))), state)
        if x is None:
            x = np.zeros((0, 0))
        yield from close()

    return both.mapInArrow(run, schema)
