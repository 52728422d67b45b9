"""Data model: the five graph tables, value tags and codec bits."""

from pyspark.sql import types as T

LONG, INT, STR = T.LongType(), T.IntegerType(), T.StringType()


def _s(*fields):
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


ENTITY = _s(("id", LONG, False))
EDGE = _s(("id", LONG, False), ("source", LONG, False), ("target", LONG, False), ("label", INT, False))
POSITION = _s(("entity_id", LONG, False), ("x", T.FloatType(), True), ("y", T.FloatType(), True))
PROPERTY = _s(
    ("entity_id", LONG, False), ("key", STR, True), ("value_type", INT, False),
    ("value_int", LONG, True), ("value_float", T.DoubleType(), True), ("value_text", STR, True),
)
BLOB = _s(
    ("entity_id", LONG, False), ("key", STR, False), ("hash", LONG, False),
    ("mime", STR, True), ("size_bytes", LONG, False), ("data", T.BinaryType(), True),
)
TABLES = {"entity": ENTITY, "edge": EDGE, "position": POSITION, "property": PROPERTY, "blob": BLOB}

# Value type tags.
TAG_INT, TAG_FLOAT, TAG_TEXT, TAG_BOOL, TAG_BLOB = 1, 2, 3, 4, 5
# Codec bits.
CODEC_RAW, CODEC_QUANTIZED_U16, CODEC_ZSTD, CODEC_ALL = 1, 2, 4, 7
# Fixed value: labels are 16 bits wide.
LABEL_MASK = 65535
# Fixed value: ids per response batch.
ENTITY_BATCH = 64


class GraphError(Exception):
    """Base of the engine's errors."""


class EntityNotFound(GraphError):
    def __init__(self, entity_id: int):
        super().__init__(f"entity not found: {entity_id}")


class BlobNotFound(GraphError):
    def __init__(self, blob_hash: int):
        super().__init__(f"blob not found: {blob_hash & (2**64 - 1):x}")


class BadRequest(GraphError):
    """An argument that no request accepts."""
