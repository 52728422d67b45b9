"""Synthetic clustered graph: seeded, generated in parallel, no driver-side rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.plans.graph import Graph

# Scale presets (nodes, average degree, clusters, Pareto shape) and geometry.
PRESETS = {"1K": (1_000, 5, 2, 2.0), "10K": (10_000, 5, 4, 2.0), "100K": (100_000, 5, 8, 2.0), "1M": (1_000_000, 5, 16, 2.0)}
SEED, RADIUS, SPREAD, SAME_CLUSTER = 42, 0.5, 0.15, 0.7


def _uniform(seed: int, *cols):
    """Uniform in [0, 1) from a hash, so that a retried task makes the same rows."""
    h = F.xxhash64(F.lit(seed), *cols)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def nodes(spark: SparkSession, n: int, clusters: int, seed: int = SEED) -> DataFrame:
    df = spark.range(n).withColumn("cluster", (F.col("id") % clusters).cast("int"))
    angle = F.col("cluster") * F.lit(2 * math.pi / clusters)
    clip = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)).cast("float")
    off = lambda k: (_uniform(seed + k, "id") * 2 - 1) * SPREAD
    return df.select("id", clip(F.cos(angle) * RADIUS + off(1)).alias("x"), clip(F.sin(angle) * RADIUS + off(2)).alias("y"), "cluster")


def edges(spark: SparkSession, n: int, avg_degree: int, clusters: int, shape: float, seed: int = SEED) -> DataFrame:
    """Pareto out-degrees scaled to n * avg_degree; most targets in the own cluster; no self loops."""
    raw = spark.range(n).withColumn("w", F.pow(1 - _uniform(seed + 3, "id"), F.lit(-1.0 / shape)))
    total = raw.agg(F.sum("w")).first()[0] or 1.0
    degree = F.floor(F.col("w") * F.lit(n * avg_degree / total)).cast("int")
    e = raw.where(degree > 0).select(F.col("id").alias("source"), F.explode(F.sequence(F.lit(1), degree)).alias("k"))
    pick, per = _uniform(seed + 4, "source", "k"), max(1, n // clusters)
    near = (F.floor(pick * per) * clusters + F.col("source") % clusters).cast("long")
    far = F.floor(_uniform(seed + 5, "source", "k") * n).cast("long")
    target = F.when(_uniform(seed + 6, "source", "k") < SAME_CLUSTER, near).otherwise(far)
    e = e.withColumn("target", target).where((F.col("target") != F.col("source")) & (F.col("target") < n))
    ident = F.col("source") * F.lit(1 << 24).cast("long") + F.col("k")
    return e.select(ident.alias("id"), "source", "target", F.lit(1).alias("label"))


def graph(spark: SparkSession, scale: str = "1K", seed: int = SEED) -> Graph:
    n, degree, clusters, shape = PRESETS[scale]
    v = nodes(spark, n, clusters, seed)
    none = lambda t: F.lit(None).cast(t)
    props = v.select(F.col("id").alias("entity_id"), F.lit("cluster").alias("key"), F.lit(1).alias("value_type"), F.col("cluster").cast("long").alias("value_int"), none("double").alias("value_float"), none("string").alias("value_text"))
    blobs = v.where(F.lit(False)).select(F.col("id").alias("entity_id"), F.lit("").alias("key"), F.col("id").alias("hash"), F.lit("").alias("mime"), F.col("id").alias("size_bytes"), none("binary").alias("data"))
    return Graph(v.select("id"), edges(spark, n, degree, clusters, shape, seed), v.select(F.col("id").alias("entity_id"), "x", "y"), props, blobs, resolved=True)
