"""Benchmark: the 15-operation suite, its batch forms and load, as one JSON line.

    BENCH_SF_DIR=... BENCH_CPUS=8 python bench.py
    python bench.py --scales 10K 100K --output-dir results --format json csv md

Without ``--scales`` it runs on the driver's tables; with them on synthetic graphs, and writes reports.
"""

from __future__ import annotations

import argparse
import json
import os
import statistics
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.queries import VIEWPORTS
from geoweft.sources import mapping, sinks, synthetic

STARTS = [1_000_000_000, 2_000_000_003, 3_000_000_007, 6_000_000_010, 5_000_000_003]
SYSTEM = "geoweft"


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def suite(g, starts: list[int]) -> dict[str, Callable[[], DataFrame]]:
    """5 entity gets, 5 viewports, 4 traversals of depth 2 and a scan, with single requests."""
    ops: dict[str, Callable[[], DataFrame]] = {f"entity_get_{i}": (lambda i=i: g.get_entities([i], True, True)) for i in starts}
    for name, b in VIEWPORTS.items():
        ops[f"spatial_{name}"] = lambda b=b: g.search_spatial(*b)
    for i in starts[:4]:
        ops[f"bfs_depth2_from_{i}"] = lambda i=i: g.traverse(i, 2)
    ops["full_scan"] = lambda: g.search_spatial(-1, -1, 1, 1)
    return ops


def batches(g, n: int) -> dict[str, Callable[[], DataFrame]]:
    """The same requests, ``n`` at a time: one job answers them all. The requests are there before."""
    ids = g.entities.orderBy(F.xxhash64("id")).limit(n).persist()
    req = ids.select(F.col("id").alias("request_id"), F.col("id").alias("start_id"))
    rect = g.positions.orderBy(F.xxhash64("entity_id")).limit(n).select(
        F.col("entity_id").alias("request_id"), (F.col("x") - 0.02).alias("min_x"), (F.col("y") - 0.02).alias("min_y"), (F.col("x") + 0.02).alias("max_x"), (F.col("y") + 0.02).alias("max_y")
    ).persist()
    drain(ids)
    drain(rect)
    return {
        f"batch_entity_get_{n}": lambda: g.get_entities(ids, True, True),
        f"batch_bfs_depth2_{n}": lambda: g.traverse_batch(req, 2),
        f"batch_viewport_{n}": lambda: g.search_spatial_batch(rect),
    }


def measure(make: Callable, starts: list[int], sizes: list[int], warmup: int, iterations: int) -> dict[str, list[float]]:
    """Seconds of each run of each operation; import is measured once."""
    t = time.perf_counter()
    g = make().persist("properties")
    for name in ("entities", "edges", "positions", "properties"):
        drain(getattr(g, name))
    out = {"import": [time.perf_counter() - t]}
    ops = suite(g, starts)
    for n in sizes:
        ops |= batches(g, n)
    for name, op in ops.items():
        out[name] = []
        for i in range(warmup + iterations):
            t = time.perf_counter()
            drain(op())
            if i >= warmup:
                out[name].append(time.perf_counter() - t)
    for name in ("entities", "edges", "positions", "properties"):
        getattr(g, name).unpersist()
    return out


def report(spark: SparkSession, scale: str, times: dict[str, list[float]]) -> list[dict]:
    n, degree, _, _ = synthetic.PRESETS[scale]
    rows = []
    for name, t in times.items():
        ns = sorted(1e9 * x for x in t)
        at = lambda p, ns=ns: ns[int(p * (len(ns) - 1) + 0.5)]
        rows.append({
            "scale": scale, "system": SYSTEM, "nodes": n, "edges": n * degree, "connection_ms": 0.0, "import_ms": 1000 * times["import"][0], "operation": name, "mean_ns": statistics.mean(ns),
            "p50_ns": at(0.5), "p95_ns": at(0.95), "p99_ns": at(0.99), "min_ns": ns[0], "max_ns": ns[-1], "stddev_ns": statistics.stdev(ns) if len(ns) > 1 else 0.0, "sample_count": len(ns),
        })
    return rows


def write_reports(spark: SparkSession, rows: list[dict], folder: str, formats: list[str]) -> None:
    df = spark.createDataFrame(rows).cache()
    Path(folder).mkdir(parents=True, exist_ok=True)
    if "csv" in formats:
        sinks.write_report_csv(df, f"{folder}/report.csv")
    if "json" in formats:
        Path(folder, "report.json").write_text(sinks.report_json({"system": SYSTEM}, df))
    if "md" in formats:
        Path(folder, "report.md").write_text(sinks.markdown(df, SYSTEM, "other"))


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default=os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"))
    ap.add_argument("--warmup", type=int, default=1)
    ap.add_argument("--iterations", type=int, default=2)
    ap.add_argument("--scales", nargs="*", default=[], choices=list(synthetic.PRESETS))
    ap.add_argument("--batch-sizes", type=int, nargs="*", default=[1000, 10_000])
    ap.add_argument("--output-dir", default="results")
    ap.add_argument("--format", nargs="*", default=["md"], choices=["json", "csv", "md"])
    a = ap.parse_args()
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    out: dict[str, float] = {}
    rows: list[dict] = []
    for scale in a.scales:
        n = synthetic.PRESETS[scale][0]
        times = measure(lambda scale=scale: synthetic.graph(spark, scale), [0, n // 4, n // 2, 3 * n // 4, n - 1], a.batch_sizes, a.warmup, a.iterations)
        rows += report(spark, scale, times)
        out |= {f"{scale}_{k}": statistics.mean(v) for k, v in times.items()}
    if a.scales:
        write_reports(spark, rows, a.output_dir, a.format)
    else:
        times = measure(lambda: mapping.graph(spark, a.sf_dir), STARTS, a.batch_sizes, a.warmup, a.iterations)
        out = {k: statistics.mean(v) for k, v in times.items()}
    rounded = {k: round(v, 4) for k, v in out.items()}
    print(json.dumps({"metric": "graph_suite_total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": rounded, "sf": a.scales or a.sf_dir}))


if __name__ == "__main__":
    main()
