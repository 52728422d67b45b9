"""Near-duplicate groups by min-max hashing.

Under each permutation both the smallest and the largest hash of a document's shingle set are
kept: two unbiased values per evaluation. The values are banded; documents that share a band
are candidates, and every link is confirmed on the full shingle sets.

Steps, none of which gathers a group of copies or emits its pairs:

1. Documents with equal shingle sets are one class (its smallest id stands for it).
2. In each band bucket every class is compared with two leaders, so a bucket of k near copies
   gives at most 2k candidates. A 128-bit sketch of the signature drops hopeless ones.
3. Confirmed links are contracted to components: up to TASK_LINKS by one task, more by alternating
   large-star and small-star.
   Buckets that still span several components meet further leaders of their main component.
4. Exact remainder: wherever a bucket still spans several components, the classes outside the
   bucket's main component are compared with all members of other components; a large bucket is
   dealt into blocks that meet two at a time and return only what joins components. So no link
   between classes that share a band is lost; pairs inside a component need no comparison.

A bucket of many members is joined in parts of PART_ROWS, so no band key makes a task large.

Nulls and texts without words have no shingles and link to nothing; a text with fewer words
than a shingle is one shingle. Rows without an id are never linked. Rows that share an id are
one document and all carry its result; where their texts differ, the one with the smallest
digest is the document's. An empty table gives no rows. Very long texts are held whole, a few at
a time. Columns other than id and text, whatever their names, play no part.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.llm.textkit import LOWER, U64, blocks, hash_spans, mix, ngram_hash, pick, small_batches, utf8, word_spans
from geoweft.plans.lineage import broadcast_if_small, cut

#: Permutations; each gives two signature values.
PERMUTATIONS = 64
#: Highest chance that a pair right at the threshold shares no band.
MISS = 1e-6
#: Sketch bits (of 128) that may differ: 6 standard deviations above the mean at the threshold.
SKETCH_SIGMAS = 6.0
#: Members of a bucket that are joined with its leaders by one task.
PART_ROWS = 1000
#: Rows about buckets are broadcast up to this size; beyond it they are joined by key and part.
KEYS_BYTES = 4 << 20
#: Up to so many links (4 MB) one task contracts; more go by star contraction.
TASK_LINKS = 1 << 18
#: Rounds of comparing open buckets with leaders before the exact remainder.
LEADER_ROUNDS = 3
#: A further round follows only if one in this many candidates of the last was a link.
LEADER_YIELD = 20
#: Open buckets up to this size are compared pair by pair, larger ones in blocks of BLOCK documents.
SMALL_BUCKET, BLOCK = 48, 128


@cache
def bands_for(threshold: float) -> tuple[int, int]:
    """(bands, rows per band): the widest bands that keep the miss chance below MISS."""
    for rows in range(8, 0, -1):
        bands = 2 * PERMUTATIONS // rows
        if (1 - threshold**rows) ** bands <= MISS:
            return bands, rows
    return 2 * PERMUTATIONS, 1


def sketch_distance(threshold: float) -> int:
    p = (1 - threshold) / 2
    return int(np.ceil(128 * p + SKETCH_SIGMAS * np.sqrt(128 * p * (1 - p))))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block, flat, and their counts."""
    n = len(offsets) - 1
    low = LOWER[data]
    ws, we, wr = word_spans(low, offsets)
    h = hash_spans(low, ws, we)
    first = np.searchsorted(wr, np.arange(n + 1))
    g = ngram_hash(h, k)
    counts, out = np.zeros(n, np.int64), []
    for i in range(n):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            s = g[a : b - k + 1]
            s.sort()
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            s = mix(ngram_hash(h[a:b], b - a) + U64(b - a))
        else:
            continue
        counts[i] = len(s)
        out.append(s)
    return (np.concatenate(out) if out else np.zeros(0, U64)), counts


@cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 1 << 64, PERMUTATIONS, U64) | U64(1), r.integers(0, 1 << 64, PERMUTATIONS, U64)


def signatures(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts with shingles, 2 * PERMUTATIONS): all minima, then all maxima."""
    counts = counts[counts > 0]
    starts = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
    out = np.empty((len(counts), 2 * PERMUTATIONS), U64)
    if not len(counts):
        return out
    for j, (a, b) in enumerate(zip(*_permutations(), strict=True)):
        v = flat * a
        v += b
        out[:, j] = np.minimum.reduceat(v, starts)
        out[:, PERMUTATIONS + j] = np.maximum.reduceat(v, starts)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per band. A band's values come from different permutations."""
    out = np.zeros((len(sig), bands), U64)
    for r in range(rows):
        out *= U64(0xD6E8FEB86659FD93)
        out += mix(sig[:, r * bands : (r + 1) * bands])
    return mix(out + np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def sketches(sig: np.ndarray) -> np.ndarray:
    """Two longs of one bit per signature value."""
    bits = (mix(sig) & U64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view("<i8").reshape(len(sig), 2)


SIGNED = "doc_id long, n long, f1 long, f2 long, s1 long, s2 long, bands array<long>, digest long"


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, digest of the text)."""
    text = F.col(text_col).cast("string")
    return small_batches(docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("digest")))


def sign(texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Per row: set size, a 128-bit digest of the set, sketch and band keys (null without shingles), digest of the text."""
    bands, rows = bands_for(threshold)

    def run(batches):
        for batch in batches:
            data, offs = utf8(pick(batch, "text"))
            ids, digest = pick(batch, "id"), pick(batch, "digest")
            for a, b in blocks(offs):
                flat, counts = shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], k)
                full = np.flatnonzero(counts)
                n = b - a
                cols = np.zeros((4, n), np.int64)
                per = [None] * n
                if len(full):
                    sig = signatures(flat, counts)
                    starts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
                    cols[0, full] = np.add.reduceat(mix(flat), starts).view(np.int64)
                    cols[1, full] = np.add.reduceat(mix(flat ^ U64(0xA5A5A5A5A5A5A5A5)), starts).view(np.int64)
                    cols[2:, full] = sketches(sig).T
                    keys = band_keys(sig, bands, rows).view(np.int64)
                    for i, key in zip(full.tolist(), keys, strict=True):
                        per[i] = key
                none = counts == 0
                arrays = [pa.array(c, pa.int64(), mask=none) for c in cols]
                yield pa.RecordBatch.from_arrays([ids.slice(a, n), pa.array(counts), *arrays, pa.array(per, pa.list_(pa.int64())), digest.slice(a, n)], ["doc_id", "n", "f1", "f2", "s1", "s2", "bands", "digest"])

    return texts.mapInArrow(run, SIGNED)


def chosen(signed: DataFrame) -> DataFrame:
    """(doc_id, own): of every id with several rows, the row that counts."""
    twice = signed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1")
    return signed.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct("n", "f1", "f2", "s1", "s2", "bands", "digest"), F.struct("digest", "f1", "f2")).alias("own"))


def one_text_each(texts: DataFrame, own: DataFrame) -> DataFrame:
    """(id, text): of the ids in ``own`` the text that counts, once; others as they are."""
    its = broadcast_if_small(own.select(F.col("doc_id").alias("id"), F.col("own.digest").alias("its")), 32)
    some = texts.join(its, "id").where("its <=> digest").groupBy("id").agg(F.first("text").alias("text"))
    return texts.join(its, "id", "left_anti").select("id", "text").unionByName(some)


def _of_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """No aggregate here: Spark splits a hot id of the join above only if both its sides come straight from shuffles."""
    return texts.select("id", "text").join(broadcast_if_small(ids, 16), "id", "left_semi")


def confirm(texts: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    ids = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    t = _of_ids(texts, ids)
    both = pairs.join(t.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(t.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches):
        for batch in batches:
            (da, oa), (db, ob) = utf8(pick(batch, "ta")), utf8(pick(batch, "tb"))
            keep = np.zeros(batch.num_rows, bool)
            for lo, hi in blocks(np.maximum(oa, ob)):
                fa, ca = shingle_sets(da[oa[lo] : oa[hi]], oa[lo : hi + 1] - oa[lo], k)
                fb, cb = shingle_sets(db[ob[lo] : ob[hi]], ob[lo : hi + 1] - ob[lo], k)
                ea, eb = np.concatenate(([0], np.cumsum(ca))), np.concatenate(([0], np.cumsum(cb)))
                for i in range(hi - lo):
                    x, y = fa[ea[i] : ea[i + 1]], fb[eb[i] : eb[i + 1]]
                    u = np.concatenate((x, y))
                    u.sort()
                    same = int((u[1:] == u[:-1]).sum())
                    keep[lo + i] = 100 * same >= percent * (len(u) - same)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([pick(batch, "a").filter(mask), pick(batch, "b").filter(mask)], ["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _links_of_block(pdf: pd.DataFrame, k: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between documents of different roots among some hundred texts.

    Intersections come from products of 0/1 matrices over slices of the shared shingles.
    """
    pdf = pdf.drop_duplicates("id")
    data, offs = utf8(pa.array(pdf["text"], pa.string()))
    flat, counts = shingle_sets(data, offs, k)
    owner = np.repeat(np.arange(len(pdf)), counts)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.concatenate(([0], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
    often = np.bincount(column) > 1 if len(column) else np.zeros(0, bool)
    keep = often[column] if len(column) else np.zeros(0, bool)
    owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1]
    n, step = len(pdf), 16_384
    same = np.zeros((n, n), np.float32)
    cuts = np.searchsorted(column, np.arange(0, int(column.max(initial=-1)) + step + 1, step))
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        m = np.zeros((n, step), np.float32)
        m[owner[lo:hi], column[lo:hi] - i * step] = 1
        same += m @ m.T
    union = counts[:, None] + counts[None, :] - same
    ids, roots = pdf["id"].to_numpy(), pdf["root"].to_numpy()
    hit = (100 * same >= percent * union) & (same > 0) & (roots[:, None] != roots[None, :])
    up = {r: r for r in set(roots.tolist())}

    def top(r):
        while up[r] != r:
            r = up[r]
        return r

    out = []
    for i, j in zip(*np.nonzero(np.triu(hit, 1)), strict=True):
        a, b = top(roots[i]), top(roots[j])
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _with_partner(pdf: pd.DataFrame, percent: int, most: int) -> np.ndarray:
    """Whether each row has another root's row whose set size and sketch allow a link."""
    n, root = pdf["n"].to_numpy(), pdf["root"].to_numpy()
    s = pdf[["s1", "s2"]].to_numpy().astype(np.int64).view(U64)
    apart = sum(np.bitwise_count(s[:, None, c] ^ s[None, :, c]).astype(np.int64) for c in (0, 1))
    near = (apart <= most) & (100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n))
    return (near & (root[:, None] != root[None, :])).any(axis=1)


def compare_blocks(texts: DataFrame, grouped: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between different roots inside each group (id, root, n, s1, s2, group).

    A group is dealt into blocks of about BLOCK documents. Two blocks at a time meet by sketch
    and size only; the texts of documents that have a possible partner there follow, all their
    pairs are tested, and only links that join components return.
    """
    sizes = broadcast_if_small(cut(grouped.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))), 16)
    own = grouped.join(sizes, "group").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    rows = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("id", "root", "n", "s1", "s2", "group", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    most = sketch_distance(percent / 100)

    def possible(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id")
        return pdf.loc[_with_partner(pdf, percent, most), ["id", "root", "group", "i", "j"]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_links_of_block(pdf, k, percent), columns=["a", "b"], dtype="int64")

    near = cut(rows.groupBy("group", "i", "j").applyInPandas(possible, "id long, root long, group long, i int, j int"))
    with_text = near.join(_of_ids(texts, cut(near.select("id").distinct())), "id")
    return with_text.groupBy("group", "i", "j").applyInPandas(run, "a long, b long")


def _contracted(batches):
    """(id, root) of some links (u, v) by union and find."""
    up: dict[int, int] = {}

    def top(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for u, v in zip(pick(batch, "u").to_pylist(), pick(batch, "v").to_pylist(), strict=True):
            u, v = top(u), top(v)
            up[max(u, v)] = min(u, v)
    found = [(x, r) for x in up if (r := top(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["id", "root"])


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every node of the links (a, b) but the roots: root is the smallest id that it reaches.

    Few links are a bounded job for one task; for others ``star_contraction`` has no such bound.
    """
    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    return cut(e.coalesce(1).mapInArrow(_contracted, "id long, root long")) if e.count() <= TASK_LINKS else star_contraction(e)


def star_contraction(e: DataFrame) -> DataFrame:
    """(id, root) of every node of the links (u, v), u > v, but the roots.

    Alternates large-star and small-star until every edge is child to root; each round is a
    few joins on combined minima, and its results are written to the shared folder.
    """
    e = cut(e.distinct())

    def stars(e: DataFrame) -> bool:
        """No node has two parents, or a parent and a child: one shuffle in place of a last round."""
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up")))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.count("*").alias("c"))
        return ends.where("up > 1 or (up = 1 and c > 1)").isEmpty()

    while not stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join's sides come straight from a scan or a shuffle and Spark can split a hub
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")))
        large = both.where("v > u").join(broadcast_if_small(low, 16, KEYS_BYTES), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("id"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links), kept."""
    threshold = percent / 100
    texts = texts_of(docs, id_col, text_col)
    signed = cut(sign(texts, k, threshold))
    own = cut(chosen(signed))
    if not own.isEmpty():
        texts = one_text_each(texts, own)
        own = broadcast_if_small(own, 400)
        signed = signed.join(own, "doc_id", "left").select("doc_id", *[F.when(F.col("own").isNull(), F.col(c)).otherwise(F.col(f"own.{c}")).alias(c) for c in signed.columns[1:]])
    usable = signed.where("n > 0 and doc_id is not null")
    firsts = [F.first(c).alias(c) for c in ("n", "s1", "s2", "bands")]
    classes = cut(usable.groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), *firsts))

    rows = classes.select("id", "n", "s1", "s2", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"), F.count("*").alias("c")).where("c > 1").drop("c")
    members = cut(rows.join(shared, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))

    def in_parts(df: DataFrame) -> DataFrame:
        """A row for each part of its bucket, to meet all its members there."""
        return df.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    most = sketch_distance(threshold)

    def candidates(x: DataFrame, y: DataFrame, extra=None) -> DataFrame:
        """Pairs of one bucket that sizes and sketches allow."""
        near = F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1"))) + F.bit_count(F.col("x.s2").bitwiseXOR(F.col("y.s2"))) <= most
        size = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
        on = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.id") != F.col("y.id")) & size & near
        if extra is not None:
            on &= extra
        return x.alias("x").join(y.alias("y"), on).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))

    item = F.struct("id", "n", "s1", "s2")
    leaders = members.groupBy("key").agg(F.first("parts").alias("parts"), F.min(item).alias("l1"), F.min_by(item, F.xxhash64("id")).alias("l2"))
    leaders = leaders.select("key", "parts", F.explode(F.array_distinct(F.array("l1", "l2"))).alias("l")).select("key", "parts", "l.*")
    tried = cut(candidates(members, broadcast_if_small(cut(in_parts(leaders)), 64, KEYS_BYTES)).distinct())
    links = cut(confirm(texts, tried, k, percent))
    roots = components(links)

    def open_buckets(roots: DataFrame) -> DataFrame:
        """Members of the buckets that span several components, with their bucket's main one."""
        labelled = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        sizes = labelled.groupBy("key", "root").agg(F.count("*").alias("c"), F.first("parts").alias("parts"))
        main = sizes.groupBy("key").agg(F.first("parts").alias("parts"), F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots"))
        main = broadcast_if_small(cut(in_parts(main.where("roots > 1")).select("key", "part", "main")), 32, KEYS_BYTES)
        return cut(labelled.join(main, ["key", "part"]))

    def join_up(roots: DataFrame, more: DataFrame) -> DataFrame:
        return components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more))

    # more leaders, all from the main component, contract a large group at linear cost; a round
    # that confirms few of its candidates ends this, and its links go on with the remainder's
    open_ = open_buckets(roots)
    more = None
    for r in range(LEADER_ROUNDS):
        best = [F.min_by(item, F.xxhash64(F.lit(2 * r + i + 1), "id")).alias(f"l{i}") for i in range(2)]
        leaders = open_.where("root = main").groupBy("key").agg(F.first("parts").alias("parts"), *best)
        leaders = leaders.select("key", "parts", F.explode(F.array_distinct(F.array("l0", "l1"))).alias("l")).select("key", "parts", "l.*")
        leaders = broadcast_if_small(cut(in_parts(leaders)), 64, KEYS_BYTES)
        fresh = cut(candidates(open_.where("root <> main"), leaders).distinct().join(tried, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            break
        tried = tried.unionByName(fresh)
        links = cut(confirm(texts, fresh, k, percent))
        if links.count() * LEADER_YIELD < fresh.count():
            more = links
            break
        roots = join_up(roots, links)
        open_ = open_buckets(roots)

    # exact remainder: small buckets by pairs, large ones by blocks
    counts = cut(open_.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("lead"), F.first("parts").alias("parts")))
    small = open_.join(counts.where(F.col("c") <= SMALL_BUCKET).select("key"), "key", "left_semi")
    other = F.col("x.root") != F.col("y.root")
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    rest = cut(candidates(small.where("root <> main"), small, other & once).distinct().join(tried, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        found = confirm(texts, rest, k, percent)
        more = found if more is None else more.unionByName(found)
    leads = in_parts(counts.where(F.col("c") > SMALL_BUCKET)).select("key", "part", "lead")
    large = cut(open_.join(broadcast_if_small(leads, 32, KEYS_BYTES), ["key", "part"]).select("id", "root", "n", "s1", "s2", "lead").distinct())
    if not large.isEmpty():
        chained = components(large.select(F.col("id").alias("a"), F.col("lead").alias("b")))
        grouped = large.drop("lead").distinct().join(chained.withColumnRenamed("root", "group"), "id", "left")
        found = compare_blocks(texts, grouped.withColumn("group", F.coalesce("group", "id")), k, percent)
        more = found if more is None else more.unionByName(found)
    if more is not None:
        roots = join_up(roots, more)

    by_class = classes.select("f1", "f2", "id").join(roots, "id", "left").select("f1", "f2", F.coalesce("root", "id").alias("root"))
    out = signed.select("doc_id", "n", "f1", "f2").join(by_class, ["f1", "f2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents kept: one id of each component, with all their columns."""
    kept = near_duplicates(docs, k, percent).where("not kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_anti").select(docs.columns)
