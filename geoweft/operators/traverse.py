"""Breadth-first traversal, set at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweft.plans.lineage import cut

#: Up to this depth a traversal is one lazy plan, linear in the depth.
LAZY_DEPTH = 3


def traverse_batch(entities, edges, requests: DataFrame, depth: int, labels=(), limit: int | None = None, min_depth: int = 0, ordered: bool = False) -> DataFrame:
    """Requests (request_id, start_id); result request_id, id, depth and, if ordered or limited, ord.

    Follows outgoing edges whose label is in ``labels`` (empty: all). The start has depth 0;
    each node counts once, at its smallest depth; an unknown start gives no row. The order is
    that of a queue whose neighbours are visited by target id: by depth, then by the
    lexicographically smallest shortest path. ``limit`` truncates after the traversal.
    Paths are carried only where the order matters.
    """
    start = requests.select("request_id", F.col("start_id").alias("id")).join(entities, "id", "left_semi")
    return traverse_from(start, edges, depth, labels, limit, min_depth, ordered)


def traverse_from(start: DataFrame, edges, depth: int, labels=(), limit: int | None = None, min_depth: int = 0, ordered: bool = False) -> DataFrame:
    """The same from rows (request_id, id) of known entities."""
    e = edges.where(F.col("label").isin(*labels)) if labels else edges
    e = e.select(F.col("source").alias("_s"), F.col("target").alias("_t"))
    path = ordered or limit is not None
    level = start.select("request_id", "id", *([F.array("id").alias("path")] if path else [])).distinct()

    def hop(f: DataFrame) -> DataFrame:
        joined = f.join(e, F.col("id") == F.col("_s"))
        if not path:
            return joined.select("request_id", F.col("_t").alias("id")).distinct()
        longer = F.concat("path", F.array("_t"))
        return joined.groupBy("request_id", F.col("_t").alias("id")).agg(F.min(longer).alias("path"))

    tag = lambda f, d: f.withColumn("depth", F.lit(d))
    if depth <= LAZY_DEPTH:
        levels = [tag(level, 0)] if min_depth == 0 else []
        for d in range(1, depth + 1):
            level = hop(level)
            levels.append(tag(level, d))
        if not levels:
            levels = [tag(level, 0).where(F.lit(False))]
        every = levels[0]
        for x in levels[1:]:
            every = every.unionByName(x)
        best = F.min(F.struct("depth", *(["path"] if path else []))).alias("b")
        found = every.groupBy("request_id", "id").agg(best).select("request_id", "id", "b.*")
    else:
        level = cut(level)
        found = tag(level, 0)
        seen = level.select("request_id", "id")
        if min_depth:
            found, seen = found.where(F.lit(False)), seen.where(F.lit(False))
        for d in range(1, depth + 1):
            level = cut(hop(level).join(seen, ["request_id", "id"], "left_anti"))
            if level.isEmpty():
                break
            found = found.unionByName(tag(level, d))
            seen = seen.unionByName(level.select("request_id", "id"))
    if not path:
        return found
    if limit is None:
        return _numbered(found)
    # a literal limit: Spark keeps each task's first rows only before the shuffle
    ranked = found.withColumn("ord", F.row_number().over(Window.partitionBy("request_id").orderBy("depth", "path")))
    return ranked.where(F.col("ord") <= limit).drop("path")


def _numbered(found: DataFrame) -> DataFrame:
    """``ord`` of all rows without gathering a request: rows are sorted over range partitions and
    written once; a partition's first place comes from the counts of the ones before."""
    laid = found.repartitionByRange("request_id", "depth", "path").sortWithinPartitions("request_id", "depth", "path")
    laid = cut(laid.select("request_id", "id", "depth", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place")))
    before = Window.partitionBy("request_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = laid.groupBy("request_id", "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    parts = parts.select("request_id", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    place = F.col("_place") - F.col("_first") + F.col("_from") + 1
    return laid.join(parts, ["request_id", "_part"]).select("request_id", "id", "depth", place.cast("int").alias("ord"))
