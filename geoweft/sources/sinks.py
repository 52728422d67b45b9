"""Sinks: typed-header graph CSV, and benchmark reports as CSV, JSON and Markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.functions.scalar import csv_field, duration_text, op_key, op_name
from geoweft.operators import stats

# Headers of the CSV formats.
NODE_HEADER = ["id:ID", "x:FLOAT", "y:FLOAT", "cluster:INT"]
EDGE_HEADER = [":START_ID", ":END_ID", ":TYPE"]
REPORT_COLUMNS = ["scale", "system", "nodes", "edges", "connection_ms", "import_ms", "operation", "mean_ns", "p50_ns", "p95_ns", "p99_ns", "min_ns", "max_ns", "stddev_ns", "sample_count"]


def write_graph_csv(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    six = lambda c: F.format_string("%.6f", F.col(c).cast("double"))
    n = nodes.select("id", six("x"), six("y"), "cluster").toDF(*NODE_HEADER)
    n.write.mode("overwrite").option("header", True).csv(f"{path}/nodes")
    e = edges.select("source", "target", F.lit("CONNECTS")).toDF(*EDGE_HEADER)
    e.write.mode("overwrite").option("header", True).csv(f"{path}/edges")


def read_graph_csv(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, x, y, cluster) and edges (source, target, type) of what write_graph_csv wrote."""
    n = spark.read.option("header", True).schema("id long, x double, y double, cluster int").csv(f"{path}/nodes")
    return n, spark.read.option("header", True).schema("source long, target long, type string").csv(f"{path}/edges")


def write_report_csv(report: DataFrame, path: str) -> None:
    report.select(*REPORT_COLUMNS).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def report_csv_lines(report: DataFrame) -> DataFrame:
    """The same rows as text lines, quoted only where a field needs it."""
    cols = [csv_field(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in REPORT_COLUMNS]
    return report.select(F.concat_ws(",", *cols).alias("line"))


def write_report_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def report_json(meta: dict, report: DataFrame) -> str:
    return json.dumps({**meta, "results": [r.asDict() for r in report.collect()]}, indent=2)  # one row per operation


def markdown(report: DataFrame, own: str, other: str) -> str:
    """Comparison tables by scale (lexicographic order), averaged by operation class."""
    out = ["# Benchmark Report"]
    for (scale,) in sorted((r[0],) for r in report.select("scale").distinct().collect()):
        rows = report.where(F.col("scale") == scale).withColumnRenamed("operation", "label")
        both = stats.compare(rows.where(F.col("system") == own), rows.where(F.col("system") == other))
        shown = both.orderBy(F.col("other_ns").isNull(), "op_key").select(op_name("op_key").alias("o"), duration_text("own_ns").alias("a"), F.coalesce(duration_text("other_ns"), F.lit("—")).alias("b"), F.coalesce(F.format_string("%.1fx", "speedup"), F.lit("—")).alias("s"))
        out += ["", f"## Scale: {scale}", "", f"| Operation | {own} | {other} | Speedup |", "|---|---|---|---|"]
        out += [f"| {r.o} | {r.a} | {r.b} | {r.s if r.b != '—' else '—'} |" for r in shown.collect()]
    return "\n".join(out)


__all__ = ["markdown", "op_key", "report_csv_lines", "report_json", "write_graph_csv", "write_report_csv", "write_report_json"]
