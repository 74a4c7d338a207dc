"""Time the JVM higher-order-function and Arrow/numpy scoring engines at several vector widths.

Synthetic rows (this measures engines, not the reference's workloads).
Usage: python tools/engine_bench.py [rows]
"""

from __future__ import annotations

import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

import numpy as np  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from protolens.operators import scoring as SC  # noqa: E402
from protolens.operators import stats as S  # noqa: E402
from protolens.session import local_session  # noqa: E402


def main(n: int) -> None:
    spark = local_session(8, "engine-bench")
    for d in (16, 64, 128, 256, 512):
        df = spark.range(n).select(
            F.col("id").alias("example_id"), F.lit(1).alias("layer"), (F.col("id") % 2).cast("int").alias("label"),
            F.transform(F.sequence(F.lit(1), F.lit(d)), lambda i: F.randn(7) + i / d).alias("vector"))
        df = S.materialize(df)
        t = time.perf_counter()
        fit = S.fit_gda(df, ["layer"], "label")
        t_fit = time.perf_counter() - t
        res = {}
        for eng in ("hof", "arrow"):
            t = time.perf_counter()
            SC.gda_logits(df, fit["params"], ["layer"], engine=eng).write.format("noop").mode("overwrite").save()
            t1 = time.perf_counter() - t
            t = time.perf_counter()
            SC.mahalanobis_sq(df, fit["means"], fit["precision"], ["layer"], engine=eng) \
                .write.format("noop").mode("overwrite").save()
            res[eng] = (round(t1, 2), round(time.perf_counter() - t, 2))
        print(f"d={d:4d} rows={n} fit={t_fit:.2f}s logits(hof,arrow)=({res['hof'][0]},{res['arrow'][0]})s "
              f"mahalanobis(hof,arrow)=({res['hof'][1]},{res['arrow'][1]})s", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 20000)
