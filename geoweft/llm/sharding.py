"""Hilbert-curve ordering into shards, with DataFrame functions only.

Several metadata dimensions are quantised to equal depth, a row's cell gets its index on the
Hilbert curve, and runs of the curve order become shards of equal row counts. A file of a
shard then covers a compact box of all dimensions, and filters on any of them skip files.

No row is gathered: cells (at most 2**(bits * dims)) are counted, each cell is split by a hash
of the row into sub-cells, and a row's rank is the start of its sub-cell plus its place there.
A dimension is cut at quantiles of all rows in its own order: numbers, dates and times by a quantile
sketch; texts, as whole values in byte order, exactly: distinct values are counted, range-partitioned
and summed up. The cuts only shape the boxes: shards and slots are exact whatever they are.

Null dimensions lie with the smallest values; null and empty texts have size 1, very long texts
are never read (only their size and checksum are); null ids and repeated rows keep a rank each; ties
in the curve are broken by the hash and the id. An empty table gives no rows. Input columns are
renamed first, so names can't clash.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoweft.plans.lineage import cut

#: Rows of a sub-cell, about, if all rows lay in one cell; and the least number of sub-cells.
SUB_ROWS, LEAST_SUBS = 1 << 19, 64


def ordered(df: DataFrame, name: str) -> tuple[Column, bool]:
    """A dimension as a double that keeps its order, or as it is; and whether it is a text.

    Types without an order (arrays, maps, structures) go by their hash.
    """
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return c.cast("string"), True
    if isinstance(kind, T.BinaryType):
        return F.hex(c), True
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double"), False
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp").cast("double"), False
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double"), False
    return c.cast("double") if isinstance(kind, T.NumericType) else F.xxhash64(c).cast("double"), False


def text_cuts(rows: DataFrame, c: str, total: int, levels: int) -> list[tuple]:
    """The values of a text column that hold the quantiles i / levels of all rows (nulls first), each with their number."""
    counts = rows.groupBy(c).agg(F.count("*").alias("_n"))
    # written, so that a value's part stays the same; each value is one row, so no part is hot
    counts = cut(counts.repartitionByRange(F.col(c).asc_nulls_first()).withColumn("_part", F.spark_partition_id()))
    parts, starts = counts.groupBy("_part").agg(F.sum("_n").alias("_n")).orderBy("_part").collect(), []  # a row for each part
    for i, r in enumerate(parts):
        starts.append((r["_part"], sum(x["_n"] for x in parts[:i])))
    if not starts:
        return []
    start = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part int, _start long"))
    run = F.sum("_n").over(Window.partitionBy("_part").orderBy(F.col(c).asc_nulls_first())) + F.col("_start")
    ends = counts.join(start, "_part").withColumn("_end", run)
    steps = F.expr(f"least({levels - 1}, (_end * {levels}) div {total}) - ((_end - _n) * {levels}) div {total}")
    found = ends.withColumn("_steps", steps.cast("int")).where(F.col(c).isNotNull() & (F.col("_steps") > 0)).select(c, "_steps").collect()  # levels - 1 at most
    return sorted(((r[c], r["_steps"]) for r in found), key=lambda x: x[0].encode())


def cut_points(rows: DataFrame, texts: list[str], numbers: list[str], levels: int) -> tuple[int, dict[str, list[tuple]]]:
    """Number of rows, and for each dimension the values at its quantiles, each with the number of quantiles there.

    So a coordinate is the share of rows below a value: few distinct values still use all the curve's levels.
    """
    shares = [i / levels for i in range(1, levels)]
    stat = rows.agg(F.count("*").alias("n"), *[F.percentile_approx(c, shares, 2000).alias(c) for c in numbers]).first()
    cuts = {c: sorted(Counter(stat[c] or []).items()) for c in numbers}
    for c in texts:
        cuts[c] = text_cuts(rows, c, stat["n"], levels)
    return stat["n"], cuts


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of coordinates below 2**bits.

    The steps of the transform are the elements of a literal array that a fold runs over.
    """
    n = len(axes)
    x0 = F.array(*[a.cast("long") for a in axes])
    steps = F.array(*[F.struct(F.lit(1 << q).cast("long").alias("q"), F.lit(i).alias("i")) for q in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x, s):
        q, i = s["q"], s["i"]
        first, own = F.element_at(x, 1), F.element_at(x, i + 1)
        low = q - 1
        flip = own.bitwiseAND(q) != 0
        t = first.bitwiseXOR(own).bitwiseAND(low)
        head = F.when(flip, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(t))
        return F.transform(x, lambda v, k: F.when(k == 0, head).when((k == i) & ~flip, v.bitwiseXOR(t)).otherwise(v))

    x = F.aggregate(steps, x0, turn) if bits > 1 else x0
    # Gray code: each axis takes in the ones before it
    zero = F.array().cast("array<bigint>")
    last = lambda acc: F.when(F.size(acc) == 0, F.lit(0).cast("long")).otherwise(F.element_at(acc, F.greatest(F.size(acc), F.lit(1))))
    gray = F.aggregate(x, zero, lambda acc, v: F.concat(acc, F.array(v.bitwiseXOR(last(acc)))))
    high = F.array(*[F.lit(1 << q).cast("long") for q in range(bits - 1, 0, -1)]) if bits > 1 else zero
    fix = lambda g: F.aggregate(high, F.lit(0).cast("long"), lambda t, q: F.when(F.element_at(g, n).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    done = F.transform(gray, lambda v: v.bitwiseXOR(fix(gray)))
    order = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(k + 1).alias("k")) for b in range(bits - 1, -1, -1) for k in range(n)])
    one = F.lit(1).cast("long")
    pick = lambda acc, s: acc * 2 + F.call_function("shiftright", F.element_at(done, s["k"]), s["b"]).bitwiseAND(one)
    return F.aggregate(order, F.lit(0).cast("long"), pick)


def hilbert_shards(df: DataFrame, dims: list[str], keep: dict[str, Column], key: str = "doc_id", shards: int = 16, bits: int = 4) -> DataFrame:
    """``keep`` columns of every row plus shard (0 ..), slot (gapless in the shard) and curve.

    Shards are runs of the curve whose row counts differ by at most one.
    """
    levels = 1 << bits
    own = [ordered(df, d) for d in dims]
    rows = df.select(*[c.alias(f"_d{i}") for i, (c, _) in enumerate(own)], F.col(key).cast("long").alias("_key"), *[c.alias(n) for n, c in keep.items()])
    dcols = [f"_d{i}" for i in range(len(dims))]
    total, cuts = cut_points(rows.select("_key", *dcols), [d for d, o in zip(dcols, own, strict=True) if o[1]], [d for d, o in zip(dcols, own, strict=True) if not o[1]], levels)
    bucket = lambda c: F.coalesce(reduce(lambda a, b: a + b, [F.when(F.col(c) > F.lit(v), steps).otherwise(0) for v, steps in cuts[c]], F.lit(0)), F.lit(0))
    axes = [bucket(c) for c in dcols]
    cell = reduce(lambda a, b: a * levels + b, axes)
    subs = max(LEAST_SUBS, -(-total // SUB_ROWS))
    rows = rows.select(cell.alias("_cell"), F.pmod(F.xxhash64("_key"), F.lit(subs)).cast("int").alias("_sub"), "_key", *keep)

    counts = rows.groupBy("_cell", "_sub").agg(F.count("*").alias("_n"))
    parts = [F.shiftright("_cell", bits * (len(dims) - 1 - i)).bitwiseAND(F.lit(levels - 1)) for i in range(len(dims))]
    cells = rows.groupBy("_cell").agg(F.count("*").alias("_n")).withColumn("_curve", hilbert_index(parts, bits))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("_cell", "_curve", before(Window.orderBy("_curve")).alias("_from"))
    starts = counts.join(F.broadcast(cells), "_cell")  # at most levels ** dims rows
    starts = starts.select("_cell", "_sub", "_curve", (F.col("_from") + before(Window.partitionBy("_cell").orderBy("_sub"))).alias("_start"))

    place = F.row_number().over(Window.partitionBy("_cell", "_sub").orderBy("_key", *keep)) - 1
    ranked = rows.withColumn("_place", place).join(starts, ["_cell", "_sub"]).withColumn("_rank", F.col("_start") + F.col("_place"))
    shard = F.expr(f"(_rank * {shards}) div {max(total, 1)}")
    first = F.expr(f"(((_rank * {shards}) div {max(total, 1)}) * {max(total, 1)} + {shards - 1}) div {shards}")
    return ranked.select(*keep, shard.cast("int").alias("shard"), (F.col("_rank") - first).cast("long").alias("slot"), F.col("_curve").alias("curve"))


def write_shards(df: DataFrame, dims: list[str], path: str, shards: int = 16, bits: int = 4, key: str = "doc_id") -> None:
    """Whole rows as one directory per shard, sorted by slot inside, for file and row-group skipping."""
    cols = {c: F.col(c) for c in df.columns}
    out = hilbert_shards(df, dims, cols, key, shards, bits)
    out = out.repartitionByRange(shards * 4, "shard", "slot").sortWithinPartitions("shard", "slot")
    out.write.mode("overwrite").partitionBy("shard").parquet(path)
