"""Scalar building blocks as Column expressions: all stay in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_value(value_type, value_int, value_float, value_text) -> Column:
    """Tagged union of a property row; a NULL typed value becomes the type's default.

    Unknown tags decode to the empty text; a blob reference has size 0.
    """
    tag = _c(value_type).bitwiseAND(F.lit(255))
    i, f, t = _c(value_int), _c(value_float), _c(value_text)
    known = tag.isin(1, 2, 4, 5)
    return F.struct(
        F.when(tag.isin(1, 2, 3, 4, 5), tag).otherwise(F.lit(3)).cast("tinyint").alias("type"),
        F.when(tag == 1, F.coalesce(i, F.lit(0).cast("long"))).alias("int"),
        F.when(tag == 2, F.coalesce(f, F.lit(0.0))).alias("float"),
        F.when(tag == 3, F.coalesce(t, F.lit(""))).when(~known, F.lit("")).alias("text"),
        F.when(tag == 4, F.coalesce(i != 0, F.lit(False))).alias("bool"),
        F.when(
            tag == 5,
            F.struct(F.coalesce(i, F.lit(0).cast("long")).alias("hash"), F.lit(0).cast("long").alias("size")),
        ).alias("blob"),
    )


def world_to_tile(v, count) -> Column:
    """Tile index of a world coordinate in [-1, 1]; clamped at the borders, NaN goes to 0.

    The sum is single precision; ``count`` is a power of two, so the rest is exact in double.
    """
    v = _c(v).cast("float")
    n = count if isinstance(count, Column) else F.lit(int(count))
    raw = F.floor((v + F.lit(1.0).cast("float")).cast("double") / F.lit(2.0) * n.cast("double"))
    low, high = F.lit(0.0), (n - F.lit(1)).cast("double")
    scaled = (v + F.lit(1.0).cast("float")).cast("double") / F.lit(2.0) * n.cast("double")
    # infinities and huge values are clamped before floor, which would overflow a long
    return (
        F.when(F.isnan(v), F.lit(0))
        .when(scaled >= high, high.cast("int"))
        .when(scaled <= low, F.lit(0))
        .otherwise(raw.cast("int"))
    )


def tile_distance(tx, ty, cx, cy) -> Column:
    """Squared distance in tile units."""
    dx, dy = _c(tx).cast("long") - _c(cx).cast("long"), _c(ty).cast("long") - _c(cy).cast("long")
    return dx * dx + dy * dy


def codec_contains(codecs, wanted) -> Column:
    """True if any of the wanted bits is set."""
    return _c(codecs).bitwiseAND(wanted if isinstance(wanted, Column) else F.lit(wanted)) != 0


# Bit widths of the packed pointers (index, epoch, storage).
POINTER_64, POINTER_32 = (40, 16, 8), (20, 8, 4)


def pack_pointer(index, epoch, storage, widths=POINTER_64) -> Column:
    wi, we, ws = widths
    part = lambda c, w: _c(c).cast("long").bitwiseAND(F.lit((1 << w) - 1))
    return part(index, wi).bitwiseOR(F.shiftleft(part(epoch, we), wi)).bitwiseOR(F.shiftleft(part(storage, ws), wi + we))


def unpack_pointer(packed, widths=POINTER_64) -> dict[str, Column]:
    wi, we, ws = widths
    p = _c(packed)
    take = lambda shift, w: F.shiftrightunsigned(p, shift).bitwiseAND(F.lit((1 << w) - 1))
    return {"index": take(0, wi), "epoch": take(wi, we), "storage": take(wi + we, ws)}


def pointer_with_epoch(packed, epoch, widths=POINTER_64) -> Column:
    u = unpack_pointer(packed, widths)
    return pack_pointer(u["index"], epoch, u["storage"], widths)


def hash_hex(h) -> Column:
    return F.lower(F.hex(_c(h)))


# Operation classes by label prefix, the first that fits wins.
OP_PREFIXES = [
    ("entity_get", "entity_get"),
    ("spatial_[-1.00_-1.00_1.00_1.00]", "spatial_full_view"),
    ("spatial_[-0.50_-0.50_0.50_0.50]", "spatial_mid"),
    ("spatial_[-0.25_-0.25_0.25_0.25]", "spatial_small"),
    ("spatial_[-1.00_-1.00_0.00_0.00]", "spatial_ll"),
    ("spatial_[0.00_0.00_1.00_1.00]", "spatial_ur"),
    ("spatial_", "spatial"),
    ("bfs", "bfs_depth2"),
    ("full_scan", "full_scan"),
]
# Display names of operation classes.
OP_NAMES = {
    "entity_get": "Entity get (hot)", "spatial_full_view": "Spatial [full]", "spatial_mid": "Spatial [mid]",
    "spatial_small": "Spatial [small]", "spatial_ll": "Spatial [LL]", "spatial_ur": "Spatial [UR]",
    "spatial": "Spatial query", "bfs_depth2": "BFS depth=2", "full_scan": "Full scan",
}


def op_key(label) -> Column:
    label, out = _c(label), None
    for prefix, key in OP_PREFIXES:
        hit = label.startswith(prefix)
        out = F.when(hit, F.lit(key)) if out is None else out.when(hit, F.lit(key))
    return out.otherwise(label)


def op_name(key, width: int = 21) -> Column:
    key, out = _c(key), None
    for k, name in OP_NAMES.items():
        out = F.when(key == k, F.lit(name)) if out is None else out.when(key == k, F.lit(name))
    return F.substring(out.otherwise(key), 1, width)


def short_label(label) -> Column:
    return F.replace(F.replace(_c(label), F.lit("entity_get_"), F.lit("get#")), F.lit("bfs_depth2_from_"), F.lit("bfs#"))


def duration_text(ns) -> Column:
    ns = _c(ns)
    out = F.when(ns >= 1e9, F.format_string("%.2f s", ns / 1e9))
    out = out.when(ns >= 1e6, F.format_string("%.2f ms", ns / 1e6)).when(ns >= 1e3, F.format_string("%.2f μs", ns / 1e3))
    return out.otherwise(F.format_string("%.0f ns", ns))


def csv_field(s) -> Column:
    s = _c(s)
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(s.rlike('[,"\n]'), quoted).otherwise(s)


def speedup(other, own) -> Column:
    return _c(other) / F.greatest(_c(own), F.lit(1.0))
