"""Packing token sequences by best-fit decreasing.

Each document (its ids plus one end id) is first cut into full windows; what is left over is
packed by best-fit decreasing within groups of at most ``GROUP_PIECES`` pieces. A segment tree
indexed by remaining capacity finds the tightest open window.

Null and empty texts are one piece with the end id only; null ids stay null; an empty table has no
pieces. A very long text is encoded whole. Repeated rows are packed as often as they occur;
pieces of equal length go by id and start. Other columns, whatever their names, are not read. A sequence holds at most ``window`` tokens; each token lies in exactly one piece.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.llm.bpe import tokenizer
from geoweft.llm.textkit import pick, small_batches
from geoweft.plans.lineage import cut

#: Pieces packed together by one task.
GROUP_PIECES = 100_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


class CapacityTree:
    """Counts of open windows by remaining capacity; finds the smallest capacity >= need."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.tree[i] += n
            i >>= 1

    def tightest(self, need: int) -> int:
        """The capacity, or -1."""
        tree, i = self.tree, need + self.size
        if tree[i]:
            return need
        while i > 1 and (i & 1 or not tree[i + 1]):  # up, until a right sibling has some
            i >>= 1
        if i <= 1:
            return -1
        i += 1
        while i < self.size:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(lengths, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; pieces of equal length go in the given order."""
    lengths = np.asarray(lengths, np.int64)
    tree, open_ = CapacityTree(window), [[] for _ in range(window + 1)]
    number, offset, windows = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        c = tree.tightest(need) if need < window else -1
        if c < 0:
            w, c, windows = windows, window, windows + 1
        else:
            w = open_[c].pop()
            tree.add(c, -1)
        number[i], offset[i] = w, window - c
        if c > need:
            open_[c - need].append(w)
            tree.add(c - need, 1)
    return number, offset


def pieces(docs: DataFrame, path: str, window: int, end_id: int) -> DataFrame:
    """Rows PIECES: each document's ids and one end id, cut into full windows and a rest."""

    def run(batches):
        bpe, end = tokenizer(path), int(end_id).to_bytes(4, "little")
        step = 4 * window
        for batch in batches:
            ids_of, rows = pick(batch, "doc_id").cast(pa.int64()).to_pylist(), []
            for block in bpe.blocks(pick(batch, "text").to_pylist()):
                raw, ends = block.ids.astype("<u4").tobytes(), (4 * block.ends).tolist()
                for k, (x, y) in enumerate(zip(ends, ends[1:], strict=False)):
                    ids = raw[x:y] + end
                    n = len(ids) // 4
                    rows += [(ids_of[block.at + k], a // 4, min(step, len(ids) - a) // 4, zlib.crc32(ids[a : a + step]), n) for a in range(0, len(ids), step)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """Rows PACKED; sequence ids are unique, not gapless.

    The pieces (no text) are written once, counted, and dealt evenly, so no task packs more
    than about GROUP_PIECES. A group leaves a few windows partly empty, whatever its size.
    """
    cutted = cut(pieces(docs, path, window, end_id))
    groups = max(1, -(-cutted.count() // GROUP_PIECES))

    def run(batches):
        parts = [p for p in batches if len(p)]
        if not parts:
            return
        pdf = pd.concat(parts).sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        number, offset = best_fit_decreasing(pdf["length"].to_numpy(), window)
        yield pdf.assign(sequence_id=(int(pdf["group"].iloc[0]) << 40) + number, offset=offset).drop(columns="group")

    return cutted.repartition(groups).withColumn("group", F.spark_partition_id().cast("long")).mapInPandas(run, PACKED)
