"""Language-model scores by a probabilistic suffix tree.

Symbols are the bytes of a text's lower-cased words, a space after each, and an end symbol. All
contexts of up to ``DEPTH`` symbols are counted over all training texts. A context enters the tree if it occurs at least ``MIN_COUNT`` times and if its next-symbol distribution
gains at least ``GAIN`` nats over that of its longest ancestor in the tree (a likelihood-ratio
test of their divergence), so the tree grows with the corpus. Distributions are smoothed towards
that ancestor. The levels of the tree are made one after the other, as tables joined by context.
Texts are scored by the automaton of the tree, whose state is the longest suffix in it, or, where
the automaton is too large to broadcast, by joining each block's distinct grams with the tree's
table; both give the same scores. A token's probability
is what the tree gives its symbols, mixed with a small part of the whole token's share of the
corpus (1 - ``SPELLED``), which helps words too long for the tree's contexts.

Both that share and the unigram base need every word's count. Words with a share of at least
``HEAD_SHARE`` (so at most 1 / HEAD_SHARE) are broadcast; occurrences of rarer words are joined with the counts by a
shuffle, which no rare word can skew. Null and empty texts are the end symbol alone. Rows are
scored one by one: repeated rows and null ids (which are training rows) give a result each; an
empty table gives no rows, and without training rows all words are unknown. A very long text is
spelled whole, in segments. Columns other than id and text, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweft.llm.textkit import LOWER, U64, blocks, hash_spans, per_row, pick, small_batches, utf8, word_spans
from geoweft.plans.lineage import cut

DEPTH = 5
MIN_COUNT, GAIN = 2, 6.0
HEAD_SHARE = 2e-7
#: Symbols that a task scores in one run; longer texts are split, with DEPTH symbols of run-up.
SEGMENT = 512
#: Largest automaton in bytes that is broadcast; beyond it the tree stays a table.
BROADCAST_BYTES = 128 << 20
END = 10
FOLDS, HELD_OUT = 7, 2
#: Weight of the tree against the whole token's share.
SPELLED = 0.85


def held_out(ids: list, folds: int = FOLDS, fold: int = HELD_OUT) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % folds == fold for i in ids], bool)


class Sequences:
    """Symbol sequences of a block of texts: each has DEPTH end symbols, its words, and an end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        low = LOWER[data]
        ws, we, wr = word_spans(low, offsets)
        lens = we - ws
        self.words, self.word_rows, self.n_words = hash_spans(low, ws, we), wr, per_row(wr, n)
        size = per_row(wr, n, lens) + self.n_words + DEPTH + 1
        self.first = np.concatenate(([0], np.cumsum(size)[:-1])) + DEPTH  # of each text's own symbols
        self.end = self.first + size - DEPTH
        self.symbols = np.full(int(size.sum()), END, np.uint8)
        if len(ws):
            begin = np.concatenate(([0], np.cumsum(lens + 1)[:-1]))
            base = begin[np.searchsorted(wr, np.arange(n))[wr]]
            dest = begin - base + self.first[wr]  # of each word
            shift = np.repeat(dest - ws, lens)
            src = np.arange(len(shift)) + np.repeat(ws - np.concatenate(([0], np.cumsum(lens)[:-1])), lens)
            self.symbols[src + shift] = low[src]
            self.symbols[dest + lens] = 32
        self.word_first = dest if len(ws) else np.zeros(0, np.int64)

    def own(self, rows: np.ndarray) -> np.ndarray:
        """Mask of the rows' own symbols."""
        edge = np.zeros(len(self.symbols) + 1, np.int8)
        edge[self.first[rows]] += 1
        edge[self.end[rows]] -= 1
        return np.cumsum(edge[:-1]) > 0

    def grams(self, rows: np.ndarray) -> np.ndarray:
        """Each own symbol of the rows with the DEPTH symbols before it, packed."""
        s = self.symbols.astype(U64)
        key = s.copy()
        for d in range(1, DEPTH + 1):
            key[d:] |= s[:-d] << U64(8 * d)
        return key[self.own(rows)]

    def sums(self, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of each word's symbols, and the value of each end; ``logs`` has a value per symbol and one more."""
        ends = self.end - 1
        if not len(self.words):
            return np.zeros(0), logs[ends].astype(np.float64)
        # words and ends alternate with each other and with the run-ups, which add nothing
        starts = np.sort(np.concatenate((self.word_first, ends)))
        sums = np.add.reduceat(logs.astype(np.float64), starts)
        return sums[np.searchsorted(starts, self.word_first)], logs[ends].astype(np.float64)


def _count(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class _Counter:
    """Counts of 64-bit keys; what a task holds is flushed beyond a bound."""

    BOUND = 1_500_000

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray):
        part = _count(keys)
        self.parts.append(part)
        self.size += len(part[0])
        if self.size > self.BOUND:
            merged = self.take()
            if len(merged[0]) > self.BOUND // 2:
                return merged
            self.parts, self.size = [merged], len(merged[0])
        return None

    def take(self):
        parts, self.parts, self.size = self.parts, [], 0
        if not parts:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        return _count(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


WORD, GRAM, TEXTS = 0, 1, 2


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(kind, key, count) over all training texts: words, symbol grams, and the number of texts."""

    def run(batches):
        counters, texts = {WORD: _Counter(), GRAM: _Counter()}, 0

        def emit(kind, found):
            keys, counts = found
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["kind", "key", "count"])

        for batch in batches:
            data, offs = utf8(pick(batch, "text"))
            train = ~held_out(pick(batch, "doc_id").to_pylist())
            texts += int(train.sum())
            for a, b in blocks(offs):
                seq = Sequences(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                use = train[a:b]
                for kind, keys in ((WORD, seq.words[use[seq.word_rows]]), (GRAM, seq.grams(np.flatnonzero(use)))):
                    if (full := counters[kind].add(keys)) is not None:
                        yield emit(kind, full)
        for kind, c in counters.items():
            yield emit(kind, c.take())
        yield emit(TEXTS, (np.zeros(1, U64), np.array([texts])))

    found = small_batches(docs.select("doc_id", "text")).mapInArrow(run, "kind int, key long, count long")
    return found.groupBy("kind", "key").agg(F.sum("count").alias("count"))


def levels(grams: DataFrame, gain: float = GAIN) -> list[DataFrame]:
    """Per depth (depth, gram, count, total, kinds, kept, p) of all continuations of contexts in ``grams`` (key, count):
    whether the context is in the tree, and the probability of the continuation by its longest suffix in the tree.
    Grams with a count of 0 get a probability and change no other."""
    low = lambda d: F.lit((1 << (8 * d)) - 1)
    cuts = F.array(*[F.struct(F.lit(d).alias("depth"), F.col("key").bitwiseAND(low(d + 1)).alias("gram")) for d in range(DEPTH + 1)])
    each = grams.select(F.explode(cuts).alias("g"), "count").select("g.*", "count").groupBy("depth", "gram").agg(F.sum("count").alias("count"))
    one = Window.partitionBy("depth", F.shiftright("gram", 8))  # at most 256 rows each
    each = cut(each.withColumn("total", F.sum("count").over(one)).withColumn("kinds", F.sum((F.col("count") > 0).cast("long")).over(one)))
    out: list[DataFrame] = []
    for d in range(DEPTH + 1):
        level = each.where(F.col("depth") == d)
        if d:
            shorter = out[-1].select(F.col("gram").alias("suffix"), F.col("p").alias("back"))
            level = level.withColumn("suffix", F.col("gram").bitwiseAND(low(d))).join(shorter, "suffix").drop("suffix")
        else:
            level = level.withColumn("back", F.lit(1 / 256))
        level = level.withColumn("own", (F.col("count") + F.col("kinds") * F.col("back")) / F.greatest(F.col("total") + F.col("kinds"), F.lit(1)))
        won = F.sum(F.when(F.col("count") > 0, F.col("count") * F.log(F.col("own") / F.col("back"))).otherwise(0.0)).over(one)
        level = level.withColumn("kept", (F.col("total") >= MIN_COUNT) & (won >= F.lit(float(gain))) if d else F.col("total") > 0)
        level = level.withColumn("p", F.when(F.col("kept"), F.col("own")).otherwise(F.col("back")))
        out.append(cut(level.select("depth", "gram", "count", "total", "kinds", "kept", "p")))
    return out


class SuffixTree:
    """Automaton: ``step[state, column]`` and ``logp[state, column]`` (log10)."""

    def __init__(self, depth: np.ndarray, gram: np.ndarray, count: np.ndarray, gain: float = GAIN):
        alphabet = np.unique((gram & 255).astype(np.int64))
        self.column = np.full(256, len(alphabet), np.int64)
        self.column[alphabet] = np.arange(len(alphabet))
        width = len(alphabet) + 1  # the last column stands for each symbol that was never seen
        rows = [np.full((1, width), 1 / 256, np.float32)]  # row 0: no knowledge
        kept_keys: list[np.ndarray] = [np.zeros(0, np.int64)] * (DEPTH + 1)
        kept_rows: list[np.ndarray] = [np.zeros(0, np.int64)] * (DEPTH + 1)
        total_rows = 1
        for d in range(DEPTH + 1):
            m = depth == d
            g, c = gram[m], count[m]
            order = np.argsort(g, kind="stable")
            g, c = g[order], c[order]
            ctx = g >> 8
            first = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))) if len(g) else np.zeros(0, np.int64)
            if not len(first):
                continue
            keys, total, kinds = ctx[first], np.add.reduceat(c, first), np.diff(np.append(first, len(g)))
            # the longest ancestor in the tree
            back = np.zeros(len(keys), np.int64)
            for k in range(d):
                if len(kept_keys[k]):
                    part = keys & ((1 << (8 * k)) - 1)
                    at = np.minimum(np.searchsorted(kept_keys[k], part), len(kept_keys[k]) - 1)
                    hit = kept_keys[k][at] == part
                    back[hit] = kept_rows[k][at[hit]]
            every = np.concatenate(rows)
            rows = [every]
            who = np.repeat(np.arange(len(keys)), kinds)
            col = self.column[g & 255]
            keep, made = [], []
            for lo in range(0, len(keys), 20_000):  # bounded scratch rows
                hi = min(len(keys), lo + 20_000)
                a, b = int(first[lo]), int(first[hi]) if hi < len(keys) else len(g)
                p = every[back[lo:hi]] * kinds[lo:hi, None].astype(np.float64)
                p[who[a:b] - lo, col[a:b]] += c[a:b]
                p /= (total[lo:hi] + kinds[lo:hi])[:, None]
                won = c[a:b] * np.log(p[who[a:b] - lo, col[a:b]] / every[back[who[a:b]], col[a:b]])
                ok = np.bincount(who[a:b] - lo, won, hi - lo) >= gain
                if d == 0:
                    ok[:] = True
                keep.append(ok)
                made.append(p[ok].astype(np.float32))
            keep = np.concatenate(keep)
            kept_keys[d] = keys[keep]
            kept_rows[d] = total_rows + np.arange(int(keep.sum()))
            total_rows += int(keep.sum())
            del every
            rows.extend(made)
            del made
        table = np.concatenate(rows)
        del rows
        self.contexts = sum(map(len, kept_keys))

        # states: contexts in the tree and all their prefixes; a leading 1 marks the length
        tag = lambda k, d: k | (1 << (8 * d))
        states = [np.zeros(1, np.int64)] + [kept_keys[d] for d in range(1, DEPTH + 1)]
        for d in range(DEPTH, 1, -1):
            states[d - 1] = np.union1d(states[d - 1], states[d] >> 8)
        names = np.concatenate([tag(s.astype(np.int64), d) for d, s in enumerate(states)])
        length = np.concatenate([np.full(len(s), d) for d, s in enumerate(states)])
        order = np.argsort(names)
        self.names, length = names[order], length[order]
        own = np.zeros(len(self.names), np.int64)
        if len(kept_rows[0]):
            own[:] = kept_rows[0][0]
        for d in range(1, DEPTH + 1):
            if len(kept_keys[d]):
                part = self.names & ((1 << (8 * d)) - 1)
                at = np.minimum(np.searchsorted(kept_keys[d], part), len(kept_keys[d]) - 1)
                hit = (length >= d) & (kept_keys[d][at] == part)
                own[hit] = kept_rows[d][at[hit]]
        self.logp = np.log10(table, out=table)[own]
        del table
        self.step = np.zeros((len(self.names), width), np.int32)
        root = int(np.searchsorted(self.names, 1))
        self.step[:] = root
        ctx = self.names ^ (1 << (8 * length))
        for c, sym in enumerate(alphabet.tolist()):
            longer = (ctx << 8) | sym
            for d in range(1, DEPTH + 1):
                want = (longer & ((1 << (8 * d)) - 1)) | (1 << (8 * d))
                at = np.minimum(np.searchsorted(self.names, want), len(self.names) - 1)
                hit = (self.names[at] == want) & (length + 1 >= d)
                self.step[hit, c] = at[hit]
        self.root, self.start = root, root
        newline = int(self.column[END])
        for _ in range(DEPTH):
            self.start = int(self.step[self.start, newline])
        self.step, self.logp = self.step.ravel(), self.logp.ravel()
        self.width = width

    def nbytes(self) -> int:
        return self.step.nbytes + self.logp.nbytes

    def spell(self, seq: Sequences) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each word and of each end of a block: all segments advance in step."""
        n = len(seq.first)
        col = self.column[seq.symbols].astype(np.int32)
        lens = seq.end - seq.first
        parts = -(-lens // SEGMENT)
        row = np.repeat(np.arange(n), parts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = seq.first[row] + nth * SEGMENT
        size = np.minimum(SEGMENT, seq.end[row] - begin)
        order = np.argsort(-size, kind="stable")
        row, begin, size, nth = row[order], begin[order], size[order], nth[order]
        state = np.where(nth == 0, self.start, self.root).astype(np.int32)
        later = np.flatnonzero(nth > 0)
        w, logs = self.width, np.zeros(len(seq.symbols) + 1, np.float32)
        for t in range(-DEPTH, 0):
            state[later] = self.step[state[later].astype(np.int64) * w + col[begin[later] + t]]
        active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")
        for t, k in enumerate(active.tolist()):
            at = state[:k].astype(np.int64) * w + col[begin[:k] + t]
            logs[begin[:k] + t] = self.logp[at]
            state[:k] = self.step[at]
        return seq.sums(logs)


def fit(counts: DataFrame, gain: float = GAIN) -> SuffixTree | None:
    """The automaton of the tree, or none if it is larger than BROADCAST_BYTES."""
    made = levels(counts.where(F.col("kind") == GRAM), gain)
    kept = reduce(DataFrame.unionByName, made).where("kept").select("depth", "gram", "count")
    prefixes = F.expr("explode(transform(sequence(0, greatest(depth - 1, 0)), j -> struct(depth - j as d, shiftright(gram, 8 * (j + 1)) as c)))")
    states = kept.select(prefixes).distinct().count() + 1
    if 8 * states * (made[0].count() + 1) > BROADCAST_BYTES:
        return None
    rows = kept.toArrow()  # fewer than the automaton's cells
    return SuffixTree(*[rows.column(c).to_numpy().astype(np.int64) for c in ("depth", "gram", "count")], -np.inf)


SCORED = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word long, spelled double"


def score(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    counts = cut(corpus_counts(docs))
    words = counts.where(F.col("kind") == WORD)
    w = words.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    texts = counts.where(F.col("kind") == TEXTS).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    total, distinct = w["n"] + texts, w["v"] + (1 if texts else 0)
    tree = fit(counts)
    least = max(2, int(np.ceil(HEAD_SHARE * total)))
    head = words.where(F.col("count") >= least).select("key", "count").toArrow()  # at most 1 / HEAD_SHARE rows
    keys, freq = head.column("key").to_numpy().view(U64), head.column("count").to_numpy()
    order = np.argsort(keys)
    model = spark.sparkContext.broadcast((tree, keys[order], freq[order]))
    floor = float(np.log10(total + distinct + 1))
    end_base = float(np.log10(texts + 1)) - floor
    weight = SPELLED if total else 1.0
    share = (1.0 - SPELLED) / total if total else 0.0

    def scores(seq, key, ids, spelled, ends):
        """Rows SCORED of a block: one a text, and one an occurrence of a word that is not broadcast."""
        _, keys, freq = model.value
        logs = np.log10(freq + 1.0) - floor
        n = len(key)
        base, known, tail_rows, tail = np.full(n, end_base), np.full(n, int(texts > 0)), np.zeros(0, np.int64), seq.words[:0]
        total_score = np.log10(texts * share + weight * 10.0**ends)
        if len(seq.words):
            hit = np.zeros(len(seq.words), bool)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, seq.words), len(keys) - 1)
                hit = keys[at] == seq.words
                base += np.bincount(seq.word_rows[hit], logs[at[hit]], n)
                known += per_row(seq.word_rows[hit], n)
                mixed = np.log10(freq[at[hit]] * share + weight * 10.0 ** spelled[hit])
                total_score += np.bincount(seq.word_rows[hit], mixed, n)
            tail_rows, tail, spelled = seq.word_rows[~hit], seq.words[~hit], spelled[~hit]
        m = len(tail)
        none = lambda t, m=m: pa.nulls(m, t)
        names = ["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "spelled"]
        full = [pa.array(key), ids, pa.array(held_out(ids.to_pylist())), pa.array(seq.n_words + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(total_score), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64())]
        yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in full], names)
        yield pa.RecordBatch.from_arrays([pa.array(key[tail_rows]), none(pa.int64()), none(pa.bool_()), none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.float64()), pa.array(tail.view(np.int64)), pa.array(spelled)], names)

    def parts(batches):
        """(first key, ids, texts) of blocks."""
        at_row = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts, ids = pick(batch, "text"), pick(batch, "doc_id").cast(pa.int64())
            data, offs = utf8(texts)
            for a, b in blocks(offs):
                yield at_row, ids.slice(a, b - a), texts.slice(a, b - a), Sequences(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                at_row += b - a

    def run(batches):
        tree = model.value[0]
        for at, ids, _, seq in parts(batches):
            yield from scores(seq, at + np.arange(len(ids)), ids, *tree.spell(seq))

    def split(batches):
        for at, ids, text, seq in parts(batches):
            grams, n = np.unique(seq.grams(np.arange(len(ids)))).view(np.int64), len(ids)
            m, flat = len(grams), lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
            names = ["chunk", "key", "doc_id", "text", "gram"]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, at)), pa.array(at + np.arange(n)), flat(ids), flat(text).cast(pa.string()), pa.nulls(n, pa.int64())], names)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, at)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), pa.array(grams)], names)

    def looked_up(texts, found):
        texts = texts.sort_by("key").combine_chunks()
        data, offs = utf8(texts.column("text").combine_chunks())
        seq = Sequences(data, offs)
        known = found.column("key").to_numpy().view(U64)
        order = np.argsort(known)
        logs = np.zeros(len(seq.symbols) + 1, np.float32)
        every = np.arange(len(offs) - 1)
        at = np.searchsorted(known[order], seq.grams(every))
        logs[:-1][seq.own(every)] = np.log10(found.column("p").to_numpy())[order][at].astype(np.float32)
        return pa.Table.from_batches(list(scores(seq, texts.column("key").to_numpy(), texts.column("doc_id").combine_chunks(), *seq.sums(logs))))

    docs = small_batches(docs.select("doc_id", "text"))
    if tree is not None:
        scored = cut(docs.mapInArrow(run, SCORED))
    else:  # each block meets the probabilities of its grams
        chunks = cut(docs.mapInArrow(split, "chunk long, key long, doc_id long, text string, gram long"))
        grams = chunks.where("gram is not null").select(F.col("chunk").alias("block"), F.col("gram").alias("key"))
        asked = counts.where(F.col("kind") == GRAM).select("key", "count").unionByName(grams.select("key").distinct().withColumn("count", F.lit(0).cast("long")))
        found = grams.join(levels(asked)[-1].select(F.col("gram").alias("key"), "p"), "key")
        scored = cut(chunks.where("gram is null").groupBy("chunk").cogroup(found.groupBy("block")).applyInArrow(looked_up, SCORED))
    rare = words.where(F.col("count") < least).select(F.col("key").alias("word"), F.col("count").alias("c"))
    tail = scored.where("word is not null").select("key", "word", "spelled").join(rare, "word", "left")
    # an unknown word's logarithm is added up as it is: its probability may be too small for a double
    alone = F.col("spelled") + F.lit(float(np.log10(weight)))
    mixed = F.when(F.col("c").isNull(), alone).otherwise(F.log10(F.col("c") * F.lit(share) + F.lit(weight) * F.pow(F.lit(10.0), "spelled")))
    tail = tail.withColumn("mixed", mixed).groupBy("key").agg(F.sum("mixed").alias("tail_score"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0) - F.lit(floor)).alias("tail_base"), F.count("c").alias("tail_known"))
    out = scored.where("word is null").join(tail, "key", "left")
    zero = F.lit(0)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", zero)).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("tail_score", F.lit(0.0))).alias("score"),
    )
