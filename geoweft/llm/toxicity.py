"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Words are runs of letters (A-Z lower-cased). A word's input joins an embedding of the word
(hashed) with the mean embedding of its byte trigrams, so unseen words still have an input.
Two gated recurrent layers read a window of words in both directions, attention pools their
states, and a logistic output scores the window. Every text is scored whole, by all its
overlapping windows; its score is that of the highest one, calibrated on held-back rows.

Training takes a bounded sample of labelled rows (``MAX_POSITIVE`` and ``MAX_NEGATIVE``
documents, those of the smallest id hash, and ``MAX_BYTES`` of text) from the training folds. Nothing but the text enters
a score. Null and empty texts, and texts without letters, get the score of an empty window.
Without labels of both kinds every score is the share of positives. Rows are scored one by
one; repeated rows and null ids give a result each (a null id is in no label row); an empty
table gives no rows. A very long text is scored by all its windows, CHUNK at a time. Columns
other than id and text, whatever their names, play no part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.llm.textkit import LOWER, U64, blocks, hash_spans, mix, pick, run_spans, small_batches, utf8
from geoweft.plans.lineage import cut

#: Bounded training sample, and its share kept for calibration.
MAX_POSITIVE, MAX_NEGATIVE, CALIBRATION = 1500, 2500, 0.2
#: Bytes of the sample's texts, which the driver holds: of a larger sample those rows, in hash order, that fit.
MAX_BYTES = 64 << 20
WINDOW, STRIDE = 24, 12
WORD_BUCKETS, CHAR_BUCKETS, DIM, HIDDEN = 1 << 14, 1 << 12, 8, 8
EPOCHS, BATCH, RATE, SEED = 6, 256, 0.01, 7
FOLDS, HELD_OUT, CUT = 4, 2, 0.3
#: Windows scored at a time.
CHUNK = 8192

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def fold(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS for i in ids])


class Words:
    """Letter runs of a block: row of each word, index of its form, and the forms' features."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = LOWER[data]
        inside = _LETTER[low]
        starts, ends = run_spans(inside)
        edge = offsets[1:-1]  # a run never spans two texts
        edge = np.unique(edge[(edge > 0) & (edge < len(low))])
        edge = edge[inside[edge] & inside[edge - 1]]
        starts, ends = np.sort(np.concatenate((starts, edge))), np.sort(np.concatenate((ends, edge)))
        self.rows = np.searchsorted(offsets, starts, "right") - 1
        h = hash_spans(low, starts, ends)
        forms, first, self.form = np.unique(h, return_index=True, return_inverse=True)
        self.form = self.form.astype(np.int32)
        self.bucket = (forms & U64(WORD_BUCKETS - 1)).astype(np.int64)
        # trigrams of ^word$: as many as the word has bytes
        s, n = starts[first], (ends - starts)[first]
        self.tri_first = np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64) if len(n) else np.zeros(0, np.int64)
        at = np.arange(int(n.sum())) + np.repeat(s - self.tri_first, n)
        mid = low[at].astype(U64)
        left, right = np.full(len(at), 94, U64), np.full(len(at), 36, U64)
        if len(at):
            inner = np.ones(len(at), bool)
            inner[self.tri_first] = False
            left[inner] = low[at[inner] - 1]
            inner = np.ones(len(at), bool)
            inner[self.tri_first + n - 1] = False
            right[inner] = low[at[inner] + 1]
        self.tri = (mix((left << U64(16)) | (mid << U64(8)) | right) & U64(CHAR_BUCKETS - 1)).astype(np.int64)
        self.tri_n = n

    def subset(self, index: np.ndarray) -> tuple[Words, np.ndarray]:
        """The forms that some windows use, and the windows' indices into them."""
        used, at = np.unique(index, return_inverse=True)
        pad = int(used[:1].sum() == -1) if len(used) else 0
        used, at = used[pad:], at.reshape(index.shape) - pad
        out = object.__new__(Words)
        n = self.tri_n[used]
        out.bucket, out.tri_n = self.bucket[used], n
        out.tri_first = (np.cumsum(n) - n).astype(np.int64)
        out.tri = self.tri[np.arange(int(n.sum())) + np.repeat(self.tri_first[used] - out.tri_first, n)]
        return out, at

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of each window, form index per step; -1 is padding). All overlapping windows of every text."""
        count = np.bincount(self.rows, minlength=n) if len(self.rows) else np.zeros(n, np.int64)
        first = np.concatenate(([0], np.cumsum(count)[:-1]))
        per = np.where(count == 0, 0, np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1))
        row = np.repeat(np.arange(n), per)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
        begin = first[row] + nth * STRIDE
        left = np.minimum(WINDOW, first[row] + count[row] - begin)
        step = np.arange(WINDOW)
        at = np.minimum(begin[:, None] + step, max(len(self.form) - 1, 0))
        index = self.form[at] if len(self.form) else np.zeros((0, WINDOW), np.int32)
        index[step >= left[:, None]] = -1
        return row, index


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        w = lambda *s, k=0.3: r.normal(0, k, s).astype(np.float32)
        h = HIDDEN
        self.p = {"words": w(WORD_BUCKETS, DIM, k=0.1), "chars": w(CHAR_BUCKETS, DIM, k=0.1), "A": w(2 * h, 2 * h), "v": w(2 * h), "out": w(2 * h), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": w(2 * DIM, 3 * h), f"U{d}": w(h, 3 * h), f"c{d}": np.zeros(3 * h, np.float32)}
        self.scale = (1.0, 0.0)  # calibration of a text's highest logit
        self.prior = 0.0
        self.trained = False

    def inputs(self, words: Words) -> np.ndarray:
        """Input of each form, and a zero row for padding."""
        n = len(words.bucket)
        x = np.zeros((n + 1, 2 * DIM), np.float32)
        if n:
            x[:n, :DIM] = self.p["words"][words.bucket]
            x[:n, DIM:] = np.add.reduceat(self.p["chars"][words.tri], words.tri_first, axis=0) / words.tri_n[:, None]
        return x

    def _scan(self, gates, index, mask, d, keep=None):
        """States of one direction, (steps, windows, HIDDEN)."""
        p, h = self.p, HIDDEN
        state = np.zeros((index.shape[0], h), np.float32)
        out = np.empty((WINDOW, index.shape[0], h), np.float32)
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            g, u, m = gates[index[:, t]], state @ p[f"U{d}"], mask[:, t, None]
            zr = _sigmoid(g[:, : 2 * h] + u[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(g[:, 2 * h :] + r * u[:, 2 * h :])
            new = n + z * (state - n)
            if keep is not None:
                keep.append((t, state, z, r, n, u[:, 2 * h :]))
            state = new * m + state * (1 - m)
            out[t] = state
        return out

    def forward(self, x, index, trace=None):
        """Logit of each window."""
        p, mask = self.p, (index >= 0).astype(np.float32)
        index = np.where(index < 0, len(x) - 1, index)
        kf, kb = ([], []) if trace is not None else (None, None)
        f = self._scan(x @ p["Wf"] + p["cf"], index, mask, "f", kf)
        b = self._scan(x @ p["Wb"] + p["cb"], index, mask, "b", kb)
        hs = np.concatenate((f, b), axis=2)
        k = np.tanh(hs @ p["A"])
        s = (k @ p["v"]).T - 1e9 * (1 - mask)
        a = np.exp(s - s.max(axis=1, keepdims=True, initial=-1e9)) * mask
        a /= np.maximum(a.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("wt,twh->wh", a, hs)
        if trace is not None:
            trace.update(mask=mask, index=index, kf=kf, kb=kb, hs=hs, k=k, a=a, pooled=pooled)
        return pooled @ p["out"] + p["bias"][0]

    def backward(self, words: Words, x, dlogit, tr) -> dict[str, np.ndarray]:
        p, h, g = self.p, HIDDEN, {}
        hs, a, k = tr["hs"], tr["a"], tr["k"]
        g["out"], g["bias"] = tr["pooled"].T @ dlogit, np.array([dlogit.sum()], np.float32)
        dpool = dlogit[:, None] * p["out"]
        da = np.einsum("wh,twh->wt", dpool, hs)
        dh = a.T[:, :, None] * dpool[None]
        ds = a * (da - (a * da).sum(axis=1, keepdims=True))
        dk = ds.T[:, :, None] * p["v"] * (1 - k * k)
        g["v"] = np.einsum("wt,twh->h", ds, k)
        g["A"] = np.einsum("twi,twj->ij", hs, dk)
        dh += dk @ p["A"].T
        dx = np.zeros_like(x)
        for d, keep, part in (("f", tr["kf"], dh[:, :, :h]), ("b", tr["kb"], dh[:, :, h:])):
            dgates, gu, nxt = np.zeros((len(x), 3 * h), np.float32), np.zeros_like(p[f"U{d}"]), np.zeros((dh.shape[1], h), np.float32)
            for t, state, z, r, n, un in reversed(keep):
                m = tr["mask"][:, t, None]
                dnew = (part[t] + nxt) * m
                keep_grad = (part[t] + nxt) * (1 - m)
                dn = dnew * (1 - z) * (1 - n * n)
                dz = dnew * (state - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                dg = np.concatenate((dz, dr, dn), axis=1)
                du = np.concatenate((dz, dr, dn * r), axis=1)
                np.add.at(dgates, tr["index"][:, t], dg)
                gu += state.T @ du
                nxt = dnew * z + du @ p[f"U{d}"].T + keep_grad
            g[f"U{d}"], g[f"W{d}"], g[f"c{d}"] = gu, x.T @ dgates, dgates.sum(axis=0)
            dx += dgates @ p[f"W{d}"].T
        n = len(words.bucket)
        g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
        used = np.flatnonzero(np.abs(dx[:n]).sum(axis=1))
        np.add.at(g["words"], words.bucket[used], dx[used, :DIM])
        if len(used):
            each = dx[:n, DIM:] / words.tri_n[:, None]
            tri_use = np.repeat(np.isin(np.arange(n), used), words.tri_n)
            np.add.at(g["chars"], words.tri[tri_use], np.repeat(each, words.tri_n, axis=0)[tri_use])
        return g

    def logits(self, words: Words, index: np.ndarray) -> np.ndarray:
        x = self.inputs(words)
        parts = [self.forward(x, index[a : a + CHUNK]) for a in range(0, len(index), CHUNK)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def highest(self, words: Words, row: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
        """Highest window logit of each text."""
        out = np.full(n, -np.inf)
        np.maximum.at(out, row, self.logits(words, index))
        out[np.isinf(out)] = self.p["bias"][0]
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(offsets) - 1, self.prior)
        a, b = self.scale
        n, words = len(offsets) - 1, Words(data, offsets)
        return _sigmoid(a * self.highest(words, *words.windows(n), n) + b)


def train(texts: list[str], labels: np.ndarray, share: float, seed: int = SEED) -> Network:
    """Fit on labelled texts; ``share`` is the share of positives among all labelled rows.

    A text's label holds for its best window only. The first choice goes by the log-odds of
    words between the classes, later ones by the network itself.
    """
    net, r = Network(seed), np.random.default_rng(seed)
    net.prior = float(share)
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        return net
    data, offs = utf8(pa.array(texts, pa.string()))
    words = Words(data, offs)
    row, index = words.windows(len(texts))
    held = r.random(len(texts)) < CALIBRATION
    if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
        held[:] = False
    fit = ~held

    seen = np.unique(np.stack((words.rows, words.form)), axis=1)
    seen = seen[:, fit[seen[0]]]
    pos = np.bincount(seen[1][labels[seen[0]] == 1], minlength=len(words.bucket))
    neg = np.bincount(seen[1][labels[seen[0]] == 0], minlength=len(words.bucket))
    odds = np.log((pos + 0.5) / (labels[fit].sum() + 1)) - np.log((neg + 0.5) / ((1 - labels[fit]).sum() + 1))
    odds = np.append(np.where(pos + neg >= 3, odds, 0), 0)
    rank = np.maximum(odds[index], 0).max(axis=1) if len(index) else np.zeros(0)

    def choose(rank):
        """The best window of each fit text, and some others of the negatives."""
        order = np.lexsort((-rank, row))
        best = order[np.concatenate(([True], row[order][1:] != row[order][:-1]))] if len(order) else order
        best = best[fit[row[best]]]
        spare = np.flatnonzero((labels[row] == 0) & fit[row])
        return np.concatenate((best, r.choice(spare, min(len(spare), 2 * len(best)), replace=False)))

    m1, m2, step = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    for epoch in range(EPOCHS):
        if epoch >= EPOCHS // 2 and epoch % 2 == 0:
            rank = net.logits(words, index)
        use = r.permutation(choose(rank))
        y_all = labels[row[use]].astype(np.float32)
        up = max(1.0, (1 - y_all).sum() / max(1.0, y_all.sum())) ** 0.5
        for a in range(0, len(use), BATCH):
            part, y = use[a : a + BATCH], y_all[a : a + BATCH]
            few, at = words.subset(index[part])
            x, tr = net.inputs(few), {}
            q = _sigmoid(net.forward(x, at, tr))
            dl = ((q - y) * np.where(y > 0, up, 1.0) / len(part)).astype(np.float32)
            grads, step = net.backward(few, x, dl, tr), step + 1
            for k, g in grads.items():
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.001 * (g * g - m2[k])
                net.p[k] = net.p[k] - (RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    net.trained = True

    # calibration: logistic fit of the highest logit, classes weighted to their true shares
    top = net.highest(words, row, index, len(texts))
    on = held if held.any() else fit
    t, y = top[on], labels[on].astype(float)
    weight = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    a, b = 1.0, 0.0
    for _ in range(50):
        q = np.clip(_sigmoid(a * t + b), 1e-6, 1 - 1e-6)
        gr = np.array([(weight * (q - y) * t).sum() + 0.1 * (a - 1), (weight * (q - y)).sum() + 0.01 * b])
        s = weight * q * (1 - q)
        hess = np.array([[(s * t * t).sum() + 0.1, (s * t).sum()], [(s * t).sum(), s.sum() + 0.01]])
        move = np.linalg.solve(hess, gr)
        a, b = a - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -2, 2))
    net.scale = (max(a, 0.05), b)
    return net


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of the bounded sample, and the share of positives in the training folds."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    rows = rows.where(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % FOLDS != HELD_OUT)
    share = rows.agg(F.avg("toxic")).first()[0] or 0.0
    first = lambda t, n: rows.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = first(1, MAX_POSITIVE).unionByName(first(0, MAX_NEGATIVE))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").distinct()  # at most MAX_POSITIVE + MAX_NEGATIVE ids
    found = cut(found.withColumn("key", F.xxhash64("doc_id", "text", "toxic")))
    sizes = found.select("key", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect()
    sizes.sort(key=lambda r: r.key)
    total = np.cumsum([r.n for r in sizes]) if sizes else np.zeros(0)
    use = [r.key for r, t in zip(sizes, total.tolist(), strict=True) if t <= MAX_BYTES]
    rows = found.collect() if len(use) == len(sizes) else found.where(F.col("key").isin(use)).collect()
    got = sorted((r.doc_id, r.text or "", r.toxic) for r in rows)
    return [g[1] for g in got], np.array([g[2] for g in got], np.int64), float(share)


RESULT = "doc_id long, held_out boolean, score double, predicted int"


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    return train(*training_rows(docs, labels))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """Score every whole text; the network (a few hundred KB, fixed size) is broadcast."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = model.value
        for batch in batches:
            data, offs = utf8(pick(batch, "text"))
            ids = pick(batch, "doc_id").cast(pa.int64())
            for a, b in blocks(offs):
                s = net.scores(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]).astype(np.float64)
                mine = ids.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([mine, pa.array(fold(mine.to_pylist()) == HELD_OUT), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, RESULT)


def drop_toxic(docs: DataFrame, net: Network, below: float = CUT) -> DataFrame:
    """The documents whose score is under ``below``, with all their columns; no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = model.value
        for batch in batches:
            data, offs = utf8(pick(batch, "text"))
            keep = [net.scores(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) < below for a, b in blocks(offs)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return small_batches(docs).mapInArrow(run, docs.schema)
