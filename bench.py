"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is forced to completion with the no-op sink (every row is
computed, nothing is collected).  JVM start-up is excluded; one untimed
warm-up query loads the Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_multilayer",
    "condition_vector_flow",
    "pooled_covariance",
    "class_precisions",
    "mahalanobis_class_pred",
    "layer_sweep",
    "score_record",
    "ovr_auc",
    "sample_per_class",
    "best_condition_point",
    "first_direction",
    "render_classifier_prompt",
    "mean_std_by_group",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from protolens.plans import catalog, flagship  # noqa: F401
    from protolens.session import local_session

    spark = local_session(cpus, "protolens-bench")
    qs = catalog.queries()
    runners = dict(qs)
    runners["flagship_multilayer"] = flagship.multilayer_report

    def condition_flow(spark, sf):
        # the flow behind BASELINE's condition-vector timing, from pooled vectors on (no model inference):
        # pairs -> direction per layer -> similarities -> threshold grid -> best point -> predictions
        from protolens.plans.common import layer_vectors
        from protolens.plans.condition import condition_search

        v = layer_vectors(spark, sf).select("example_id", "layer", "label", "vector")
        return condition_search(v, [1, 2, 3], max_layers=2)["predictions"]

    runners["condition_vector_flow"] = condition_flow

    def run(name):
        df = runners[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()

    run("pooled_covariance")  # warm-up (JVM code paths and Python workers), untimed
    times = {}
    for name in HEADLINE:
        if name not in runners:
            continue
        t0 = time.perf_counter()
        try:
            run(name)
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # keep the one-line contract; a failed query is reported as null
            print(f"bench: {name} failed: {type(e).__name__}: {str(e)[:200]}", file=sys.stderr)
            times[name] = None
    sf = sf_dir.rsplit("sf", 1)[-1]
    total = round(sum(t for t in times.values() if t is not None), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
