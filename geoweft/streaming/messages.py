"""Requests and responses as JSON text: one request in, a frame of response messages out.

A response row is (query_id, seq, message). Data messages come first by ``seq`` (null where a result has
no order), then one ``done``. A request that names something unknown gets an ``error`` and ``done``;
one that can't be decoded gets only an ``error`` with query id 0.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.operators.blobs import DEFAULT_CHUNK
from geoweft.plans.graph import Graph
from geoweft.schema import ENTITY_BATCH, BadRequest, GraphError

ROWS = "query_id long, seq long, message string"
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class GetEntity:
    id: int
    properties: bool = False
    blobs: bool = False


@dataclass(frozen=True)
class GetEdges:
    entity_id: int
    direction: str = "outgoing"
    labels: list[int] = field(default_factory=list)
    limit: int | None = None


@dataclass(frozen=True)
class Traverse:
    start_id: int
    depth: int
    labels: list[int] = field(default_factory=list)
    limit: int | None = None


@dataclass(frozen=True)
class SearchSpatial:
    min_x: float
    min_y: float
    max_x: float
    max_y: float
    limit: int | None = None


@dataclass(frozen=True)
class SearchProperty:
    """A key alone, a key with a value, or a key with a range."""

    key: str
    value: int | float | str | bool | None = None
    low: float | None = None
    high: float | None = None
    limit: int | None = None


@dataclass(frozen=True)
class GetBlob:
    hash: int
    offset: int = 0
    chunk_size: int = DEFAULT_CHUNK


KINDS = {"entity": GetEntity, "edges": GetEdges, "traverse": Traverse, "spatial": SearchSpatial, "property": SearchProperty, "blob": GetBlob}
Request = GetEntity | GetEdges | Traverse | SearchSpatial | SearchProperty | GetBlob


def encode(request: Request) -> str:
    kind = next(k for k, c in KINDS.items() if isinstance(request, c))
    return json.dumps({"kind": kind, **asdict(request)})


def decode(text: str) -> Request:
    """The request; BadRequest for text that is none."""
    try:
        body = json.loads(text)
        kind = KINDS[body.pop("kind")]
        request = kind(**body)
    except (ValueError, TypeError, KeyError, AttributeError) as e:
        raise BadRequest(f"decode: {e}") from e
    types = {"int": int, "str": str, "bool": bool, "float": (int, float), "list[int]": list}
    for f in fields(kind):
        value, names = getattr(request, f.name), str(f.type).split(" | ")
        fits = value is None if "None" in names else False
        fits = fits or any(isinstance(value, types[n]) and (n == "bool" or not isinstance(value, bool)) for n in names if n in types)
        if not fits or (isinstance(value, list) and not all(isinstance(x, int) for x in value)):
            raise BadRequest(f"decode: {f.name}: {value!r}")
    return request


def _message(kind: str, *cols: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("kind"), *cols))


def _results(g: Graph, r: Request) -> DataFrame:
    """(seq, message) of the data of a request."""
    none = F.lit(None).cast("long").alias("seq")
    if isinstance(r, GetEntity):
        return g.get_entity(r.id, r.properties, r.blobs).select(none, _message("entity", "id", "properties", "blob_refs").alias("message"))
    if isinstance(r, GetEdges):
        return g.get_edges(r.entity_id, r.direction, r.labels, r.limit).select(none, _message("edge", "id", "source", "target", "label").alias("message"))
    if isinstance(r, Traverse):
        found = g.traverse(r.start_id, r.depth, r.labels, r.limit, ordered=True).withColumn("seq", F.floor((F.col("ord") - 1) / ENTITY_BATCH).cast("long"))
        batch = found.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("ord", "id"))).alias("b"))  # ENTITY_BATCH rows each
        return batch.select("seq", _message("batch", F.col("b.id").alias("ids")).alias("message"))
    if isinstance(r, GetBlob):
        chunk = g.blob_chunks(r.hash, r.offset, r.chunk_size)
        return chunk.select(F.col("offset").alias("seq"), _message("chunk", "hash", "offset", "total_size", F.base64("data").alias("data")).alias("message"))
    if isinstance(r, SearchSpatial):
        found = g.search_spatial(r.min_x, r.min_y, r.max_x, r.max_y, r.limit)
    elif r.value is not None:
        found = g.search_property_eq(r.key, r.value, r.limit)
    elif r.low is not None or r.high is not None:
        found = g.search_property_range(r.key, float("-inf") if r.low is None else r.low, float("inf") if r.high is None else r.high, r.limit)
    else:
        found = g.search_property_key(r.key, r.limit)
    return found.select(none, _message("entity", "id").alias("message"))


def answer(g: Graph, query_id: int, text: str) -> DataFrame:
    """Rows (query_id, seq, message) for one request."""
    frame = lambda rows: g.spark.createDataFrame(rows, ROWS)
    try:
        request = decode(text)
    except BadRequest as e:
        return frame([(0, LAST, json.dumps({"kind": "error", "query_id": 0, "message": str(e)}))])
    done = (query_id, LAST, json.dumps({"kind": "done", "query_id": query_id}))
    try:
        found = _results(g, request)
    except GraphError as e:
        return frame([(query_id, None, json.dumps({"kind": "error", "query_id": query_id, "message": str(e)})), done])
    return found.select(F.lit(query_id).cast("long").alias("query_id"), "seq", "message").unionByName(frame([done]))


def hello(g: Graph) -> DataFrame:
    """(message): what a client is told first."""
    return g.hello().select(_message("hello", "entities", "edges", "blob_bytes", "supported_codecs").alias("message"))
