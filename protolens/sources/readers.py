"""Readers (survey S1-S8).  Every reader is one distributed scan; path parts
become columns with ``_metadata.file_path`` instead of driver-side directory walks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File naming of per-layer vector files.
LAYER_FILE_PATTERN = r"layer_(\d+)_(?:(mean)_)?hidden_states"


def _below(root: str):
    """Path of each file relative to ``root`` (the full root path, with or without a URI scheme)."""
    import re

    bare = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/")
    return F.element_at(F.split(F.col("_metadata.file_path"), re.escape(bare) + "/", 2), 2)


def read_layer_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(layer, pooling, labels, hidden_state, ...) from ``layer_{i}[_mean]_hidden_states.parquet``.

    Works on the reference layout (one file or folder per layer) and on any
    nesting of it; hive partitions are not needed.  ``pooling`` is 'mean' for
    ``_mean_`` files and 'last' otherwise (the reference mixes both, Q11).
    Files without an ``example_id`` column get the row position within their
    file, which is how the reference aligns the layers of one example.
    """
    raw = spark.read.option("recursiveFileLookup", "true").parquet(path)
    src = F.col("_metadata.file_path")
    extra = [] if "example_id" in raw.columns else [F.col("_metadata.row_index").alias("example_id")]
    return raw.select(
        F.regexp_extract(src, LAYER_FILE_PATTERN, 1).try_cast("int").alias("layer"),  # non-layer files: NULL
        F.when(F.regexp_extract(src, LAYER_FILE_PATTERN, 2) == "mean", "mean").otherwise("last").alias("pooling"),
        *extra,
        *raw.columns,
    )


def read_benchmark_vectors(spark: SparkSession, root: str) -> DataFrame:
    """S1 + S3: layer files below ``{root}/{dataset_type}/{dataset}/`` in one scan, path parts as columns."""
    v = read_layer_vectors(spark, root)
    parts = F.split(_below(root), "/")

    def part(i):
        return F.regexp_replace(F.element_at(parts, i), r"^[^=/]*=", "")

    return v.select(part(1).alias("dataset_type"), part(2).alias("dataset"), *v.columns)


def select_layers(df: DataFrame, exclude=(0,), only: int | None = None, pooling: str | None = "last") -> DataFrame:
    """Every layer but the embedding layer 0, or one named layer."""
    out = df
    if pooling is not None and "pooling" in df.columns:
        out = out.where(F.col("pooling") == pooling)
    if only is not None:
        return out.where(F.col("layer") == int(only))
    return out.where(~F.col("layer").isin(*[int(x) for x in exclude])) if exclude else out


def scan_benchmarks(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    """S3: every ``{dataset_type}/{dataset}/...`` folder under ``root`` in one read."""
    raw = spark.read.option("recursiveFileLookup", "true").format(fmt).load(root)
    parts = F.split(_below(root), "/")

    def part(i):  # plain folder names, or hive-style name=value folders
        return F.regexp_replace(F.element_at(parts, i), r"^[^=/]*=", "")

    return raw.select(part(1).alias("dataset_type"), part(2).alias("dataset"), *raw.columns)


def scan_result_scores(spark: SparkSession, root: str, levels=("model", "dataset_type", "dataset"),
                       nested: bool = False, file_glob: str = "scores.json") -> DataFrame:
    """Every score file below ``root`` (``.../{levels}/scores.json``) in one scan; missing files are absent.

    A file is one JSON object (pretty-printed or not): flat ``{metric: value}``
    or, with ``nested``, ``{method: {metric: value}}``.  Path parts above the
    file name become the ``levels`` columns (``name=value`` folders are
    accepted).  Output is long: (levels..., [method,] metric, value).
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", file_glob) \
        .text(root, wholetext=True)  # one row per file (the keyword, not .option(): text() sets its own default)
    parts = F.split(F.col("_metadata.file_path"), "/")
    n = len(levels)
    cols = [F.regexp_replace(F.element_at(parts, -(n + 1) + j), r"^[^=/]*=", "").alias(name)
            for j, name in enumerate(levels)]
    if nested:
        m = F.from_json("value", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType())))
        by_method = raw.select(*cols, F.explode(m).alias("method", "metrics"))
        return by_method.select(*levels, "method", F.explode("metrics").alias("metric", "value"))
    m = F.from_json("value", T.MapType(T.StringType(), T.DoubleType()))
    return raw.select(*cols, F.explode(m).alias("metric", "value"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines (gzip handled by the codec); blank lines produce no rows."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def flatten_keyed_json(df: DataFrame, map_col: str, key_name: str = "key") -> DataFrame:
    """A JSON object {key: [records]} -> one row per record with the key kept."""
    ex = df.select(F.explode(map_col).alias(key_name, "_records"))
    return ex.select(key_name, F.inline("_records"))


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True,
                   schema: T.StructType | str | None = None, keep_empty: bool = True,
                   multi_line: bool = False) -> DataFrame:
    """CSV / TSV; with ``keep_empty`` an empty field stays '' instead of NULL.

    ``multi_line`` allows quoted fields with line breaks (such files are read
    one task per file, so it is off by default).
    """
    reader = spark.read.option("sep", sep).option("header", str(header).lower())
    reader = reader.option("multiLine", str(multi_line).lower())
    if keep_empty:
        reader = reader.option("emptyValue", "").option("nullValue", "\u0000")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def read_two_row_header_csv(spark: SparkSession, path: str, id_cols: int = 1) -> DataFrame:
    """Two header rows -> long rows (id columns..., dataset_type, dataset, value).

    The two header lines (bounded) are read on the driver; the body is one
    distributed scan unpivoted with the header names as literals.
    """
    lines = spark.read.text(path)
    head = [r.value for r in lines.limit(2).collect()]  # the two header rows: the feature itself
    import csv

    h0, h1 = (next(csv.reader([x])) for x in head)
    body = spark.read.option("header", "false").csv(path)
    cols = body.columns
    # the two header lines: rows whose every cell equals theirs (one equal cell is no header)

    def is_line(header):
        same = F.lit(True)
        for i, c in enumerate(cols):
            same = same & (F.coalesce(F.col(c), F.lit("")) == F.lit(header[i] if i < len(header) else ""))
        return same

    body = body.where(~is_line(h0) & ~is_line(h1))
    cells = F.array(*[F.struct(F.lit(h0[i]).alias("dataset_type"), F.lit(h1[i]).alias("dataset"),
                               F.col(cols[i]).alias("value")) for i in range(id_cols, len(cols))])
    return body.select(*[F.col(cols[i]).alias(f"id{i}") for i in range(id_cols)], F.inline(cells))
