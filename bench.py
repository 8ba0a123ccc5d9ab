"""Headline benchmark: prints ONE JSON line.

completion with the `noop` sink (the whole plan runs, nothing is
collected):

1. scene_nearest   — pixel QA filter + scene medians (A1) + ±30 d range join
                     + nearest scene (J7, J8) + NDVI by latitude bin
2. merge_features  — source coalescing (J16) + climate join + features F1-F12
3. profiling       — missing report (A5), quantile clip (A10), histograms (A13)
4. blend_scan      — single-pass blend-weight scan (M18)
5. grouped_gbt     — grouped 5-fold out-of-fold GBT (10 iterations)

Each workload runs once untimed on the sf0.001 tables first (JVM / codegen
warm-up; no results are cached). Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.session import build_session, table  # noqa: E402

WARMUP_DIR = "/root/testdata/sf0.001"


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2))

    from tessera.models import features as ft
    from tessera.models import trees as tr
    from tessera.plans import registry

    registry.load_all()
    q = registry.QUERIES

    n_lineitem = table(spark, sf_dir, "lineitem").count()
    n_orders = table(spark, sf_dir, "orders").count()

    def profiling(d):
        run(q["missing_report"](spark, d))
        run(q["quantile_clip"](spark, d))
        run(q["histogram"](spark, d))

    def grouped_gbt(d):
        from tessera.plans.q_models import spatial_folds
        t = ft.training_table(spark, d).join(spatial_folds(spark, d), "spatial_group", "left")
        run(tr.oof_boosted(t, ft.FEATURES, "ta", "fold", iterations=10, learners=["gbt_wide"]))

    workloads = {
        "scene_nearest": (lambda d: run(q["flagship_ndvi_by_lat"](spark, d)), n_lineitem),
        "merge_features": (lambda d: run(ft.training_table(spark, d)), n_orders),
        "profiling": (profiling, n_orders),
        "blend_scan": (lambda d: run(q["blend_scan"](spark, d)), 3 * n_orders),
        "grouped_gbt": (grouped_gbt, n_orders),
    }

    # JVM / codegen warm-up: every workload once on the smallest tables,
    # untimed; nothing is cached, so the timed runs below read and compute
    # everything at the benchmark scale.
    for fn, _ in workloads.values():
        fn(WARMUP_DIR)

    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name, (fn, n_in) in workloads.items():
        t0 = time.perf_counter()
        fn(sf_dir)
        times[name] = round(time.perf_counter() - t0, 3)
        rows[name] = n_in

    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf,
        "rows_per_sec": {k: round(rows[k] / v, 1) if v else None for k, v in times.items()},
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
