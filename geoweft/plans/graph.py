"""Graph: five normalised tables and the request API on top of them."""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.operators import blobs as B
from geoweft.operators import edges as E
from geoweft.operators import lookup, search, spatial, stats
from geoweft.operators.traverse import traverse_batch, traverse_from
from geoweft.schema import CODEC_ALL, LABEL_MASK, TABLES, BadRequest, BlobNotFound, EntityNotFound


def _not_negative(**arguments: int | None) -> None:
    for name, value in arguments.items():
        if value is not None and value < 0:
            raise BadRequest(f"{name}: {value}")


class Graph:
    """Lazy view of a graph. ``edges`` are resolved (both ends known) with 16-bit labels;
    ``positions`` belong to known entities. The raw edge table still counts in ``stats``."""

    def __init__(self, entities, edges, positions, properties, blobs, resolved: bool = False):
        self.spark: SparkSession = entities.sparkSession
        self.entities = entities.select("id")
        self.raw_edges, self.properties, self.blobs = edges, properties, blobs
        e = edges.withColumn("label", F.col("label").bitwiseAND(F.lit(LABEL_MASK)))
        p = positions.select("entity_id", F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"))
        if not resolved:
            known = lambda c: self.entities.select(F.col("id").alias(c))
            e = e.join(known("source"), "source", "left_semi").join(known("target"), "target", "left_semi")
            p = p.join(known("entity_id"), "entity_id", "left_semi")
        self.edges, self.positions = e.select("id", "source", "target", "label"), p

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str) -> Graph:
        return cls(*[spark.read.schema(s).parquet(f"{path}/{t}") for t, s in TABLES.items()])

    @classmethod
    def from_sqlite(cls, spark: SparkSession, path: str) -> Graph:
        from geoweft.sources.sqlite import read_table

        return cls(*[read_table(spark, path, t) for t in TABLES])

    def save(self, path: str) -> None:
        """Five Parquet datasets; positions sorted by grid cell so that viewports skip row groups."""
        self.entities.write.mode("overwrite").parquet(f"{path}/entity")
        self.raw_edges.write.mode("overwrite").parquet(f"{path}/edge")
        laid = self.cells.repartitionByRange("gy", "gx").sortWithinPartitions("gy", "gx")
        laid.select("entity_id", "x", "y").write.mode("overwrite").parquet(f"{path}/position")
        self.properties.write.mode("overwrite").parquet(f"{path}/property")
        self.blobs.write.mode("overwrite").parquet(f"{path}/blob")

    def persist(self, *more: str) -> Graph:
        """Keep the resolved tables (and others by name); they spill to disk beyond memory. Positions
        are laid out by cell, so that the statistics of cached batches skip what lies outside a viewport."""
        self.__dict__["positions"] = self.cells.repartitionByRange("gy", "gx").sortWithinPartitions("gy", "gx").select("entity_id", "x", "y")
        for name in ("entities", "edges", "positions", *more):
            self.__dict__[name] = getattr(self, name).persist(StorageLevel.MEMORY_AND_DISK)
        return self

    @cached_property
    def bits(self) -> int:
        return spatial.grid_bits(self.entities.count())

    @property
    def cells(self) -> DataFrame:
        return spatial.with_cells(self.positions, self.bits)

    def stats(self) -> DataFrame:
        return stats.graph_stats(self.entities, self.raw_edges, self.blobs)

    def hello(self) -> DataFrame:
        """One row: what a client is told first, the counts and the supported codecs."""
        return self.stats().select("entities", "edges", "blob_bytes", F.lit(CODEC_ALL).alias("supported_codecs"))

    def health(self) -> DataFrame:
        """One row: ok and the counts."""
        return self.stats().select(F.lit(True).alias("ok"), "*")

    def is_loaded(self) -> bool:
        """Whether the resolved tables are kept in memory or on disk."""
        return all(getattr(self, name).storageLevel != StorageLevel.NONE for name in ("entities", "edges", "positions"))

    def _ids(self, *ids: int) -> DataFrame:
        return self.spark.createDataFrame([(int(i),) for i in ids], "id long")

    def has_entity(self, entity_id: int) -> bool:
        return not self.entities.where(F.col("id") == int(entity_id)).isEmpty()

    def get_entities(self, ids: DataFrame | list[int], properties: bool = False, blobs: bool = False) -> DataFrame:
        return lookup.get_entities(self.entities, self.properties, self.blobs, ids, properties, blobs)

    def get_entity(self, entity_id: int, properties: bool = False, blobs: bool = False) -> DataFrame:
        if not self.has_entity(entity_id):
            raise EntityNotFound(entity_id)
        return self.get_entities([int(entity_id)], properties, blobs)

    def position(self, entity_id: int) -> DataFrame:
        return self.positions.where(F.col("entity_id") == int(entity_id))

    def positions_of(self, ids: DataFrame | list[int]) -> DataFrame:
        return lookup.positions_of(self.positions, ids)

    def get_edges_batch(self, requests: DataFrame, limit_mode: str = "scanned", most: int | None = None) -> DataFrame:
        return E.get_edges_batch(self.edges, requests, limit_mode, most)

    def get_edges(self, entity_id: int, direction: str = E.OUT, labels=(), limit: int | None = None, limit_mode: str = "scanned") -> DataFrame:
        if direction not in E.DIRECTIONS:
            raise BadRequest(f"direction: {direction}")
        _not_negative(limit=limit)
        if limit is None:
            found = E.get_edges_all(self.edges, entity_id, direction, labels)
        else:
            rows = [(0, int(entity_id), direction, [int(x) for x in labels], int(limit))]
            req = self.spark.createDataFrame(rows, "request_id long, entity_id long, direction string, labels array<int>, limit int")
            found = E.get_edges_batch(self.edges, req, limit_mode, most=int(limit))
        if not self.has_entity(entity_id):
            raise EntityNotFound(entity_id)
        end = F.when(F.col("side") == 0, F.col("target")).otherwise(F.col("source"))
        return found.orderBy("side", end, "id").select("id", "source", "target", "label")

    def edge_page(self, offset: int, limit: int) -> DataFrame:
        _not_negative(offset=offset, limit=limit)
        return E.edge_page(self.raw_edges, offset, limit)

    def traverse_batch(self, requests: DataFrame, depth: int, labels=(), limit: int | None = None, **kw) -> DataFrame:
        _not_negative(depth=depth, limit=limit)
        return traverse_batch(self.entities, self.edges, requests, depth, labels, limit, **kw)

    def traverse(self, start: int, depth: int, labels=(), limit: int | None = None, **kw) -> DataFrame:
        _not_negative(depth=depth, limit=limit)
        one = self.entities.where(F.col("id") == int(start)).select(F.lit(0).cast("long").alias("request_id"), "id")
        return traverse_from(one, self.edges, depth, labels, limit, **kw).drop("request_id")

    def search_spatial(self, min_x, min_y, max_x, max_y, limit: int | None = None, ordered: bool = False) -> DataFrame:
        _not_negative(limit=limit)
        hits = spatial.viewport(self.cells, (min_x, min_y, max_x, max_y), self.bits, limit, ordered)
        return hits.select(F.col("entity_id").alias("id"))

    def search_spatial_batch(self, requests: DataFrame) -> DataFrame:
        return spatial.viewport_batch(self.positions, requests)

    def search_property_key(self, key: str, limit: int | None = None) -> DataFrame:
        return search.by_key(self.properties, key, limit)

    def search_property_eq(self, key: str, value, limit: int | None = None) -> DataFrame:
        return search.by_value(self.properties, key, value, limit)

    def search_property_range(self, key: str, low: float, high: float, limit: int | None = None) -> DataFrame:
        return search.by_range(self.properties, key, low, high, limit)

    def get_blob(self, blob_hash: int) -> DataFrame:
        one = B.first_by_hash(self.blobs, blob_hash)
        if one.isEmpty():
            raise BlobNotFound(blob_hash)
        return one

    def blob_chunks(self, blob_hash: int, offset: int = 0, chunk_size: int = B.DEFAULT_CHUNK) -> DataFrame:
        _not_negative(offset=offset, chunk_size=chunk_size)
        return B.chunks(self.get_blob(blob_hash), offset, chunk_size)

    def last_chunk(self, blob_hash: int, offset: int = 0, chunk_size: int = B.DEFAULT_CHUNK) -> DataFrame:
        """The last chunk of a stream from ``offset`` on; no row if there is none."""
        _not_negative(offset=offset, chunk_size=chunk_size)
        return B.chunks(self.get_blob(blob_hash), offset, chunk_size, last=True)
