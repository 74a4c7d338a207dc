"""Session helpers for tests, the bench and the query catalog.

The library itself never creates a session: every public operator takes and
returns DataFrames.  These helpers exist for entry points only.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "protolens") -> SparkSession:
    """Local session tuned for small inputs; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.default.parallelism", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is; a machine-local folder is made only for local runs and tests.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster "
                               "(written tables and checkpoints go below it)")
        conf_dir = tempfile.mkdtemp(prefix="protolens-ckpt-", dir="/tmp")  # local runs and tests only
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh folder below the shared checkpoint folder for written tables."""
    root = ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    if path.startswith("file:"):
        os.makedirs(path[len("file:"):], exist_ok=True)
    elif path.startswith("/"):
        os.makedirs(path, exist_ok=True)
    return path


def scale_conf(input_bytes: int, vector_dim: int = 4096, cores: int = 8000,
               batch_bytes: int = 64 * 1024 * 1024, classes_per_split: int = 2) -> dict[str, str]:
    """Recommended settings for a cluster run over ``input_bytes`` of vector tables.

    * input splits of at least 256 MB and at least 16x the partial-Gram state of
      a split (``classes_per_split`` x d^2 doubles): each split emits that state
      once, so the Gram-merge shuffle stays below ~1/8 of the input at any d
      (d = 4096 -> 4 GiB splits; task memory stays bounded because batches stream);
    * shuffle partitions sized so a reduce task reads ~256 MB;
    * AQE with partition coalescing and skew-join splitting (a hot layer or class);
    * Arrow batches bounded to ``batch_bytes`` of float64 vectors, so the numpy
      partial Grams and batch scoring keep a fixed memory footprint at any width;
    * broadcast limits for parameter tables (``protolens.maxBroadcastBytes``).
    ``spark.checkpoint.dir`` must name a shared folder; it is never set here.
    """
    split = max(256 * 1024 * 1024, 16 * classes_per_split * vector_dim * vector_dim * 8)
    shuffle = max(2 * cores, min(200_000, input_bytes // (256 * 1024 * 1024)))
    rows_per_batch = max(128, batch_bytes // max(1, vector_dim * 8))
    return {
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 * 1024 * 1024),
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows_per_batch),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "protolens.maxBroadcastBytes": str(256 * 1024 * 1024),
    }


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``protolens`` importable in the Python workers (once per SparkContext).

    Arrow UDF closures (``mapInPandas`` / ``applyInPandas``) refer to functions
    of this package; the package is zipped and added with ``addPyFile``, the
    same mechanism as ``--py-files``.  A package installed on the executors
    makes this a no-op in effect.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    # below the shared checkpoint folder when it is a local path; otherwise a driver-side
    # file that Spark serves to the executors (what --py-files does)
    shared = scratch_path(spark, "pyfiles")
    if shared.startswith("file:"):
        out_dir = shared[len("file:"):]
    elif shared.startswith("/"):
        out_dir = shared
    else:
        out_dir = tempfile.mkdtemp(prefix="protolens-pyfiles-")
    zpath = os.path.join(out_dir, "protolens.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
