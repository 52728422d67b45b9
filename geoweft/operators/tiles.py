"""Binary tile frames: a fixed 18-byte header, 16-byte entries, then payloads (little-endian)."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Magic, version and sizes of the frame format.
MAGIC, VERSION, HEADER_BYTES, ENTRY_BYTES = 0x47444147, 1, 18, 16
_HEADER, _ENTRY = struct.Struct("<IHIHHBBBB"), struct.Struct("<bbBBHHII")
#: A frame holds at most so many tiles, within so many tiles of its base.
MAX_TILES, MAX_DELTA = 255, 127

TILE = T.StructType([
    T.StructField("tx", T.IntegerType()), T.StructField("ty", T.IntegerType()), T.StructField("layer", T.IntegerType()),
    T.StructField("codec", T.IntegerType()), T.StructField("node_count", T.IntegerType()),
    T.StructField("edge_count", T.IntegerType()), T.StructField("payload", T.BinaryType()),
])
DECODED = T.StructType([T.StructField("request_id", T.LongType()), T.StructField("lod", T.IntegerType()), *TILE.fields])


def encode_frame(request_id: int, lod: int, tiles: list[tuple]) -> bytes:
    """One frame of (tx, ty, layer, codec, node_count, edge_count, payload) tuples that fit in it."""
    bx, by = min((t[0] for t in tiles), default=0), min((t[1] for t in tiles), default=0)
    head = [_HEADER.pack(MAGIC, VERSION, request_id, bx & 0xFFFF, by & 0xFFFF, lod, len(tiles), 0, 0)]
    bodies, at = [], 0
    for tx, ty, layer, codec, nodes, edges, payload in tiles:
        head.append(_ENTRY.pack(tx - bx, ty - by, layer, codec, min(nodes, 65535), min(edges, 65535), at, len(payload)))
        bodies.append(bytes(payload))
        at += len(payload)
    return b"".join(head + bodies)


def encode_frames(request_id: int, lod: int, tiles: Iterable[tuple]) -> Iterator[bytes]:
    """As many frames as the tile count and the one-byte deltas ask for."""
    part: list[tuple] = []
    box = (0, 0, 0, 0)
    for t in tiles:
        x, y = t[:2]
        wider = (min(box[0], x), max(box[1], x), min(box[2], y), max(box[3], y)) if part else (x, x, y, y)
        if part and (len(part) == MAX_TILES or wider[1] - wider[0] > MAX_DELTA or wider[3] - wider[2] > MAX_DELTA):
            yield encode_frame(request_id, lod, part)
            part, wider = [], (x, x, y, y)
        part.append(t)
        box = wider
    yield encode_frame(request_id, lod, part)


def decode_frame(buf: bytes | None) -> tuple[int, int, list[tuple]] | None:
    """(request_id, lod, tiles), or None for anything malformed."""
    if buf is None or len(buf) < HEADER_BYTES:
        return None
    magic, version, request_id, bx, by, lod, count, _, _ = _HEADER.unpack_from(buf)
    start = HEADER_BYTES + count * ENTRY_BYTES
    if magic != MAGIC or version != VERSION or len(buf) < start:
        return None
    tiles = []
    for i in range(count):
        dx, dy, layer, codec, nodes, edges, at, size = _ENTRY.unpack_from(buf, HEADER_BYTES + i * ENTRY_BYTES)
        if start + at + size > len(buf):
            return None
        tiles.append((bx + dx, by + dy, layer, codec, nodes, edges, bytes(buf[start + at : start + at + size])))
    return request_id, lod, tiles


def encode(tiles: DataFrame) -> DataFrame:
    """Rows (request_id, lod, tile columns) to rows (request_id, lod, frame_no, frame).

    Tiles are cut into blocks of 16 x 16 tiles first, so no task gathers a request whole.
    """

    def frames(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ty", "tx", "layer"], kind="stable")
        head = pdf.iloc[0]
        rows = pdf[["tx", "ty", "layer", "codec", "node_count", "edge_count", "payload"]].itertuples(index=False, name=None)
        out = list(encode_frames(int(head.request_id), int(head.lod), rows))
        return pd.DataFrame({"request_id": head.request_id, "lod": head.lod, "block": head.block, "frame_no": range(len(out)), "frame": out})

    block = (F.shiftright("ty", 4) * 65536 + F.shiftright("tx", 4)).cast("long")
    schema = "request_id long, lod int, block long, frame_no int, frame binary"
    return tiles.withColumn("block", block).groupBy("request_id", "lod", "block").applyInPandas(frames, schema)


def decode(frames: DataFrame, column: str = "frame") -> DataFrame:
    """One row per tile; a malformed frame gives none."""

    def rows(batches):
        for pdf in batches:
            found = [(d[0], d[1], *t) for d in map(decode_frame, pdf[column]) if d for t in d[2]]
            yield pd.DataFrame(found, columns=[f.name for f in DECODED.fields])

    return frames.select(column).mapInPandas(rows, DECODED)
