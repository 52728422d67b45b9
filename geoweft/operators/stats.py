"""Graph statistics, latency statistics and the comparison of systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweft.functions.scalar import op_key, speedup
from geoweft.plans.lineage import broadcast_if_small, cut

# The percentiles that are reported.
PERCENTILES = {"p50_ns": 0.5, "p95_ns": 0.95, "p99_ns": 0.99}
#: Accuracy of the sketch (its rank error is at most 1 / SKETCH of a group), width of a bracket in ranks, which leaves
#: four such errors on each side, and the size up to which a group is its own bracket.
SKETCH, BRACKET, SMALL_GROUP = 10_000, 0.001, 10_000


def graph_stats(entities, edges, blobs) -> DataFrame:
    """Counts of raw rows (dangling edges included) and total blob bytes: one row.

    Each table is aggregated by itself; the one-row results meet in a union, not in a join.
    """
    zero = F.lit(0).cast("long")
    part = lambda df, **c: df.agg(*[c.get(k, zero).cast("long").alias(k) for k in ("entities", "edges", "blobs", "blob_bytes")])
    n = F.count("*")
    parts = part(entities, entities=n).unionByName(part(edges, edges=n))
    parts = parts.unionByName(part(blobs, blobs=n, blob_bytes=F.coalesce(F.sum("size_bytes"), zero)))
    return parts.agg(*[F.sum(c).alias(c) for c in parts.columns])


def latency_stats(samples: DataFrame, by: list[str], value: str = "ns") -> DataFrame:
    """Mean, nearest-rank percentiles, extremes and sample deviation of each group.

    The rank is round(p * (n - 1)), half away from zero; null samples don't count. A first pass
    brackets each percentile by a quantile sketch, whose rank error has a bound; a second one
    counts what lies below each bracket and the distinct values inside. So a task ranks
    BRACKET of a group's values at most (whole groups of up to SMALL_GROUP), and everything
    before is combined ahead of the shuffle. The samples are read twice.
    """
    v = samples.select(*by, F.col(value).cast("double").alias("v")).where("v is not null")
    edges = [F.percentile_approx("v", F.lit([max(0.0, p - BRACKET / 2), min(1.0, p + BRACKET / 2)]), F.lit(SKETCH)).alias(f"e{i}") for i, p in enumerate(PERCENTILES.values())]
    base = cut(v.groupBy(*by).agg(
        F.avg("v").alias("mean_ns"), F.min("v").alias("min_ns"), F.max("v").alias("max_ns"),
        F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("stddev_ns"), F.count("v").alias("sample_count"), *edges,
    ))
    small = F.col("sample_count") <= SMALL_GROUP
    brackets = F.array(*[
        F.struct(
            F.lit(k).alias("k"), F.round(F.lit(p) * (F.col("sample_count") - 1)).alias("rank"),
            F.when(small, F.col("min_ns")).otherwise(F.col(f"e{i}")[0]).alias("low"), F.when(small, F.col("max_ns")).otherwise(F.col(f"e{i}")[1]).alias("high"),
        )
        for i, (k, p) in enumerate(PERCENTILES.items())
    ])
    wanted = broadcast_if_small(base.select(*by, brackets.alias("brackets")), 256)
    on = [v[c].eqNullSafe(wanted[c]) for c in by]
    each = v.join(wanted, on).select(*[v[c] for c in by], "v", F.explode("brackets").alias("b")).select(*by, "v", "b.*").where("v <= high")
    # values below a bracket meet in one row, with a null value that comes first
    counted = each.groupBy(*by, "k", "rank", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    last = F.sum("c").over(Window.partitionBy(*by, "k").orderBy(F.col("v").asc_nulls_first())) - 1
    pct = counted.withColumn("last", last).where("last >= rank").groupBy(*by).agg(*[F.min(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in PERCENTILES])
    on = [base[c].eqNullSafe(pct[c]) for c in by]
    own = [c for c in base.columns if c not in ("e0", "e1", "e2")]
    return base.join(pct, on).select(*[base[c] for c in own], *[pct[k] for k in PERCENTILES], pct["p50_ns"].alias("median_ns"))


def by_operation(samples: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Average the samples of each operation class; sample_count is the number of samples."""
    return samples.groupBy(*by, op_key("label").alias("op_key")).agg(
        F.avg("mean_ns").alias("mean_ns"), F.avg("p95_ns").alias("p95_ns"), F.avg("p99_ns").alias("p99_ns"), F.count("*").alias("sample_count")
    )


def compare(own: DataFrame, other: DataFrame) -> DataFrame:
    """Operations of ``own`` with the other system's mean and the speed-up (null where it has none)."""
    a = by_operation(own).select("op_key", F.col("mean_ns").alias("own_ns"))
    b = by_operation(other).select("op_key", F.col("mean_ns").alias("other_ns"))
    return a.join(b, "op_key", "left").withColumn("speedup", speedup("other_ns", "own_ns"))
