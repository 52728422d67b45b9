"""Content-addressed blobs: lookup by hash, byte ranges and chunk streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_CHUNK = 64 * 1024


def first_by_hash(blobs: DataFrame, blob_hash: int) -> DataFrame:
    """The row of a hash; of several the smallest (entity_id, key). At most one row."""
    return blobs.where(F.col("hash") == blob_hash).orderBy("entity_id", "key").limit(1)


def distinct_blobs(blobs: DataFrame, *cols: str) -> DataFrame:
    """One row per hash, chosen before the bytes are moved."""
    first = blobs.groupBy("hash").agg(F.min(F.struct("entity_id", "key")).alias("f")).select("hash", "f.entity_id", "f.key")
    return blobs.select("hash", "entity_id", "key", *cols).join(first, ["hash", "entity_id", "key"], "left_semi")


def byte_range(blobs: DataFrame, blob_hash: int, offset: int, size: int) -> DataFrame:
    one = first_by_hash(blobs, blob_hash)
    return one.select("hash", F.substring("data", offset + 1, size).alias("data"))


def chunks(blobs: DataFrame, offset: int = 0, chunk_size: int = DEFAULT_CHUNK, last: bool = False) -> DataFrame:
    """All chunks of every blob row from ``offset`` on, or the last of them: hash, offset, total_size, data.

    A chunk size of 0, an offset past the end and missing bytes give no chunks. ``total_size``
    is the stored column; chunks end at the first empty one.
    """
    if chunk_size <= 0 or offset < 0:
        return blobs.select("hash", F.lit(0).cast("long").alias("offset"), F.col("size_bytes").alias("total_size"), "data").where(F.lit(False))
    end = F.least(F.col("size_bytes"), F.octet_length("data").cast("long"))
    rows = blobs.where(F.col("data").isNotNull() & (end > offset))
    starts = F.sequence(F.lit(offset).cast("long"), end - 1, F.lit(chunk_size).cast("long"))
    starts = F.slice(starts, -1, 1) if last else starts
    rows = rows.select("hash", "size_bytes", "data", F.explode(starts).alias("offset"))
    piece = F.substring(F.col("data"), (F.col("offset") + 1).cast("int"), F.lit(chunk_size))
    return rows.select("hash", "offset", F.col("size_bytes").alias("total_size"), piece.alias("data"))
