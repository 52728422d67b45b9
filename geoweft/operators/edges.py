"""Edge lookups by direction and label, for batches of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUT, IN, BOTH = "outgoing", "incoming", "both"
DIRECTIONS = (OUT, IN, BOTH)


#: Parts in which a request's edges are ranked first, so that no task sorts all edges of a hub.
SALTS = 64


def _smallest(joined: DataFrame, other: str, bound: Column, most: int | None) -> DataFrame:
    """Adds ``rn`` (by other end and id) to the rows of each request that are among its first ``bound``.

    Ranked in SALTS parts of each request, then among what the parts leave: at most SALTS times
    the limit. ``most``, a literal upper bound of all limits, lets Spark cut before the shuffles too.
    """
    def ranked(df: DataFrame, *keys: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("request_id", *keys).orderBy(other, "id"))
        df = df.withColumn("rn", rank)
        if most is not None:
            df = df.where(F.col("rn") <= most)
        return df.where(F.col("rn") <= bound)

    parts = ranked(joined.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))), "_salt")
    return ranked(parts.drop("rn", "_salt"))


def get_edges_batch(edges: DataFrame, requests: DataFrame, limit_mode: str = "scanned", most: int | None = None) -> DataFrame:
    """Requests (request_id, entity_id, direction, labels array<int>, limit int or null).

    Result: request_id, side (0 outgoing, 1 incoming), rn, id, source, target, label.
    ``scanned`` (parity): the limit bounds the edges looked at, before the label test, and the
    incoming side may look at as many as outgoing matches left over. ``matched``: the limit
    bounds the edges that pass. An empty label list passes all. Edges of one side are ordered
    by their other end, then by id, and numbered by rn. Requests without a limit are a plain
    join: they are neither ranked nor shuffled again, and their rn is null. ``most`` is an
    upper bound of all limits, if the caller knows one.
    """
    if limit_mode not in ("scanned", "matched"):
        raise ValueError(f"limit_mode: {limit_mode}")
    r = requests.select("request_id", F.col("entity_id"), "direction", "labels", F.col("limit").cast("long").alias("lim"))
    passes = (F.size("labels") == 0) | F.expr("array_contains(labels, label)")

    cols = ["request_id", "side", "rn", "id", "source", "target", "label"]

    def side(asked: DataFrame, key: str, wanted: tuple, before: bool) -> DataFrame:
        asked = asked.where(F.col("direction").isin(*wanted))
        joined = edges.select("id", "source", "target", "label").join(asked, F.col(key) == F.col("entity_id"))
        return joined.where(passes) if before else joined

    def rows(df: DataFrame, number: int) -> DataFrame:
        return df.withColumn("side", F.lit(number)).withColumn("rn", F.col("rn").cast("long")).select(cols)

    free, bound = r.where("lim is null"), r.where("lim is not null")
    whole = [side(free, k, w, True).withColumn("rn", F.lit(None)) for k, w in (("source", (OUT, BOTH)), ("target", (IN, BOTH)))]
    matched = limit_mode == "matched"
    out = _smallest(side(bound, "source", (OUT, BOTH), matched), "target", F.col("lim"), most).where(passes)
    used = out.groupBy("request_id").agg(F.count("*").alias("used"))
    # what is left over belongs to the request, so it is known before its incoming edges are ranked
    left = bound.join(used, "request_id", "left").withColumn("lim", F.col("lim") - F.coalesce("used", F.lit(0))).drop("used")
    inc = _smallest(side(left, "target", (IN, BOTH), matched), "source", F.col("lim"), most).where(passes)
    return rows(out, 0).unionByName(rows(inc, 1)).unionByName(rows(whole[0], 0)).unionByName(rows(whole[1], 1))


def get_edges_all(edges: DataFrame, entity_id: int, direction: str, labels=()) -> DataFrame:
    """One entity, no limit: plain filters, pushed to the scan; a self loop appears once per side."""
    e = edges.where(F.col("label").isin(*labels)) if labels else edges
    cols = ["id", "source", "target", "label"]
    out = e.where(F.col("source") == entity_id).select(F.lit(0).alias("side"), *cols)
    inc = e.where(F.col("target") == entity_id).select(F.lit(1).alias("side"), *cols)
    return out if direction == OUT else inc if direction == IN else out.unionByName(inc)


def degrees(edges: DataFrame, end: str) -> DataFrame:
    """Out-degree (end='source') or in-degree (end='target'): combined before the shuffle."""
    return edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("degree"))


def edge_page(edges: DataFrame, offset: int, limit: int) -> DataFrame:
    """The edges offset .. offset+limit by id."""
    return edges.orderBy("id").offset(offset).limit(limit)


def adjacency(edges: DataFrame, end: str = "source", partitions: int | None = None) -> DataFrame:
    """Edges laid out by one end, sorted inside partitions: the distributed adjacency layout."""
    other = "target" if end == "source" else "source"
    laid = edges.repartition(partitions, end) if partitions else edges.repartition(end)
    return laid.sortWithinPartitions(end, other, "id")
