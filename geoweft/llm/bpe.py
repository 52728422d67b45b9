"""BPE encoding and decoding by batched numpy merge rounds.

Texts of a block are lower-cased, joined and cut into the tokenizer's pieces (letter runs, single
numerals, runs of other signs, contractions) by array operations on their bytes. New pieces of
a block are encoded together: their symbols lie in one flat array, each round looks every
adjacent pair up by binary search over the sorted pair keys and merges, in every piece at once,
the pair of lowest rank. A piece's ids never depend on its neighbours, so the ids of pieces
seen before come from a bounded table (64-bit hashes of the pieces' bytes).

Inputs: any texts. Null and empty texts, and empty tables, have no tokens or rows. Special
token strings in a text are that token, as in the library. A text is held whole in memory, with
some ten times its bytes of scratch; its length is otherwise unbounded. Repeated rows and ids
give repeated results; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from geoweft.llm.textkit import U64, give_back, hash_spans, pick, small_batches

#: Pieces whose ids a worker keeps; beyond it the table starts anew.
CACHE_PIECES = 1 << 19
#: Texts handled at a time hold about so many characters.
BATCH_CHARS = 1_000_000
_NONE = np.iinfo(np.int64).max

# Unicode White_Space.
_WHITE = "\t\n\v\f\r \x85\xa0                　"
# Code points that are letters or numerals since Unicode 17; the tokenizers library follows version 16.
_NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 "
    "10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 "
    "16ebb-16ed3 16ff2-16ff3 16ff4-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 "
    "1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 "
    "1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f "
)
# Capitals since Unicode 16, which str.lower() doesn't know, and what the library makes of them.
_CAPITALS = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
_CAPITAL = re.compile(f"[{''.join(map(chr, _CAPITALS))}]")
# The contractions that are pieces of their own.
_SHORT, _LONG = ["s", "t", "m", "d"], ["re", "ve", "ll"]
# The settings of a tokenizer file that this module implements.
_SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "decoder": None,
}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
_FLAGS = ("single_word", "lstrip", "rstrip", "normalized")

_SPACE, _LETTER, _NUMERAL, _OTHER = range(4)
#: Bytes that never occur in UTF-8 stand for the special tokens of a block.
_MARK = 0xF8


def _byte_symbols() -> list[str]:
    """Printable stand-ins of the 256 bytes: printable Latin-1 is itself, the rest follows from 256 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    extra = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(extra)) for b in range(256)]


def _classes() -> np.ndarray:
    """Kind of every code point."""
    out = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMERAL, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    for span in _NEWER.split():
        first, _, last = span.partition("-")
        out[int(first, 16) : int(last or first, 16) + 1] = _OTHER
    out[list(map(ord, _WHITE))] = _SPACE
    return out


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all ranges, one after the other."""
    first = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - first, sizes)


class PieceTable:
    """Numbers of known pieces by hash (open addressing), and their ids in one flat array."""

    def __init__(self):
        self.n, self.used = 0, 0
        self.slots = np.full(1 << 16, -1, np.int32)
        self.keys = np.zeros(1 << 14, U64)
        self.first, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, or -1."""
        mask = U64(len(self.slots) - 1)
        out = self.slots[keys & mask]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        at = keys[todo]
        while len(todo):
            at = at + U64(1)
            found = self.slots[at & mask]
            out[todo] = found
            on = (found >= 0) & (self.keys[found] != keys[todo])
            todo, at = todo[on], at[on]
        return out

    def _place(self, numbers: np.ndarray) -> None:
        mask, at = U64(len(self.slots) - 1), self.keys[numbers]
        while len(numbers):
            slot = at & mask
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            lost = self.slots[slot] != numbers
            numbers, at = numbers[lost], at[lost] + U64(1)

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Distinct new keys with their ids."""
        n, used = self.n + len(keys), self.used + len(ids)
        if n > len(self.keys):
            grown = max(n, 2 * len(self.keys))
            self.keys, self.first, self.size = (np.resize(x, grown) for x in (self.keys, self.first, self.size))
        if used > len(self.flat):
            self.flat = np.resize(self.flat, max(used, 2 * len(self.flat)))
        self.keys[self.n : n], self.size[self.n : n] = keys, sizes
        self.first[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : used] = ids
        fresh = np.arange(self.n, n, dtype=np.int32)
        self.n, self.used = n, used
        if 4 * n > len(self.slots):
            self.slots = np.full(1 << (8 * n).bit_length(), -1, np.int32)
            fresh = np.arange(n, dtype=np.int32)
        self._place(fresh)

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, flat, and the count of each."""
        size = self.size[numbers]
        return self.flat[_spread(self.first[numbers], size)], size


class Encoded:
    """Pieces and ids of a block of texts; text i has pieces cuts[i] : cuts[i + 1] and ids ends[i] : ends[i + 1]."""

    __slots__ = ("at", "pieces", "cuts", "ids", "ends")

    def __init__(self, at, pieces, cuts, ids, sizes):
        self.at, self.pieces, self.cuts, self.ids = at, pieces, cuts, ids
        self.ends = np.concatenate(([0], np.cumsum(sizes)))[cuts]

    def __len__(self):
        return len(self.cuts) - 1

    def counts(self) -> np.ndarray:
        """Ids of each text."""
        return np.diff(self.ends)


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        unlike = [k for k, v in _SETTINGS.items() if spec.get(k) != v] + [k for k, v in _MODEL.items() if model.get(k, v) != v]
        unlike += [f for t in spec["added_tokens"] for f in _FLAGS if t.get(f)]
        if unlike or len(spec["added_tokens"]) > 256 - _MARK:
            raise ValueError(f"settings of {path} that are not implemented: {unlike or 'added_tokens'}")
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.marks = {t: bytes([_MARK + k]) for k, t in enumerate(self.special)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        sym = _byte_symbols()
        self.plain = np.array([vocab.get(s, -1) for s in sym], np.int64)
        self.final = np.array([vocab.get(s + self.suffix, -1) for s in sym], np.int64)
        self.kinds = _classes()
        self.byte_kinds = np.append(self.kinds[:128], np.full(128, _NUMERAL, np.uint8))  # a mark stands alone, as a numeral does
        self.decimal = {i: str(i).encode() for i in self.tokens}
        self.forms = {i: t.encode() for i, t in self.tokens.items()}
        self._start()

    def _start(self) -> None:
        """An empty table, but for the special tokens."""
        self.table = PieceTable()
        if self.marks:
            marks, at = np.frombuffer(b"".join(self.marks.values()), np.uint8), np.arange(len(self.marks))
            self.table.add(hash_spans(marks, at, at + 1), np.array(list(self.special.values()), np.uint32), np.ones(len(at), np.int64))
        self.shown: tuple[list[bytes], list[bytes]] = ([], [])

    # -- encoding ----------------------------------------------------------------------

    def _look_up(self, sym, owner, at) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pairs (at, at + 1); no pair crosses a piece."""
        key = (sym[at] << 32) | sym[at + 1]
        k = np.searchsorted(self.keys, key)
        k[k == len(self.keys)] = 0
        hit = (self.keys[k] == key) & (owner[at] == owner[at + 1])
        return np.where(hit, self.ranks[k], _NONE), self.merged[k]

    def merge(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and the count of each; ``flat`` holds their bytes.

        A round merges the lowest pair of every piece; only pairs beside a merge are looked up
        again, and pieces without a pair leave the flat array.
        """
        owner = np.repeat(np.arange(len(lengths)), lengths)
        sym = self.plain[flat]
        if len(flat):
            last = np.cumsum(lengths)[lengths > 0] - 1
            sym[last] = self.final[flat[last]]
        known = sym >= 0
        sym, owner = sym[known], owner[known]
        rank, result = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
        if len(sym):
            every = np.arange(len(sym) - 1)
            rank[:-1], result[:-1] = self._look_up(sym, owner, every)
        ended = []
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            going = low != _NONE
            if not going.all():
                ended.append((sym[~going], owner[~going]))
                sym, owner, rank, result, low = sym[going], owner[going], rank[going], result[going], low[going]
                if not len(sym):
                    break
            # in a run of the same pair (aaaa) every second one merges, from the left
            run = np.flatnonzero(rank == low)
            fresh = np.concatenate(([True], np.diff(run) != 1))
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))
            run = run[(np.arange(len(run)) - begin) % 2 == 0]
            sym[run] = result[run]
            keep = np.ones(len(sym), bool)
            keep[run + 1] = False
            new = run - np.arange(len(run))  # each earlier merge took one symbol away
            sym, owner, rank, result = sym[keep], owner[keep], rank[keep], result[keep]
            rank[new] = _NONE
            beside = np.zeros(len(sym), bool)
            beside[new] = True
            beside[new[new > 0] - 1] = True
            beside[-1] = False
            near = np.flatnonzero(beside)
            rank[near], result[near] = self._look_up(sym, owner, near)
        if not ended:
            return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
        ids, who = np.concatenate([e[0] for e in ended]), np.concatenate([e[1] for e in ended])
        ids = ids[np.argsort(who, kind="stable")]  # a piece's symbols end in the same round, in order
        return ids, np.bincount(who, minlength=len(lengths))

    def _normal(self, text: str | None) -> bytes:
        """Normalised bytes of a text, with marks for special tokens."""
        if not text:
            return b""
        if self.marks and "<" in text and (parts := self.special_re.split(text))[1:]:
            return b"".join(self.marks[p] if p in self.marks else self._normal(p) for p in parts)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a final sigma isn't special
            if _CAPITAL.search(text):
                text = text.translate(_CAPITALS)
        return text.lower().encode()

    def _kinds(self, data: np.ndarray) -> np.ndarray:
        """Kind of each byte's character."""
        kind = self.byte_kinds[data]
        lead = np.flatnonzero((data >= 0xC0) & (data < _MARK))
        if len(lead):
            b = data[lead]
            size = 2 + (b >= 0xE0).astype(np.int64) + (b >= 0xF0)
            code = (b & (0x7F >> size)).astype(np.int64)
            for k in (1, 2, 3):
                more = size > k
                code[more] = code[more] << 6 | (data[lead[more] + k] & 0x3F)
            own = self.kinds[code]
            for k in (0, 1, 2, 3):
                more = size > k
                kind[lead[more] + k] = own[more]
        return kind

    def pieces(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of normalised bytes that end with three spaces."""
        kind = self._kinds(data)
        edge = np.ones(len(data), bool)
        edge[1:] = kind[1:] != kind[:-1]
        edge |= (kind == _NUMERAL) & ((data & 0xC0) != 0x80)
        quote = np.flatnonzero(data == 0x27)
        quote = quote[(quote == 0) | (kind[quote - 1] != _OTHER)]  # others are inside a run of signs
        a, b = data[quote + 1], data[quote + 2]
        for forms in (_SHORT, _LONG):
            for form in forms:
                at = quote[(a == ord(form[0])) & (b == ord(form[1]))] if len(form) > 1 else quote[a == ord(form)]
                edge[at + 1] = False
                edge[at + 1 + len(form)] = True
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(data))
        real = kind[starts] != _SPACE
        return starts[real], ends[real]

    def _block(self, at: int, texts: list) -> Encoded:
        if self.table.n > CACHE_PIECES:
            self._start()
        raw = list(map(self._normal, texts))
        data = np.frombuffer(b" ".join(raw) + b"   ", np.uint8)
        first = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)))
        starts, ends = self.pieces(data)
        keys = hash_spans(data, starts, ends)
        numbers = self.table.find(keys)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            fresh, where = np.unique(keys[new], return_index=True)
            s, size = starts[new[where]], (ends - starts)[new[where]]
            self.table.add(fresh, *self.merge(data[_spread(s, size)], size))
            numbers[new] = self.table.find(keys[new])
        return Encoded(at, numbers, np.searchsorted(starts, first), *self.table.ids(numbers))

    def blocks(self, texts: list):
        """Encoded runs of texts."""
        give_back()
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= BATCH_CHARS or i + 1 == len(texts):
                yield self._block(at, texts[at : i + 1])
                at, size = i + 1, 0

    def encode(self, text: str | None) -> list[int]:
        return next(self.blocks([text])).ids.tolist()

    # -- decoding ----------------------------------------------------------------------

    def decode(self, ids) -> str:
        """Token strings joined by a space, special ones kept (this tokenizer has no decoder)."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def show(self, block: Encoded):
        """Per text of the last block: its decimal ids and its decoded form, as bytes."""
        decimals, forms = self.shown
        if len(forms) < self.table.n:
            size = self.table.size[len(forms) : self.table.n].tolist()
            ids = iter(self.table.flat[int(self.table.first[len(forms)]) : self.table.used].tolist())
            for n in size:
                mine = [next(ids) for _ in range(n)]
                decimals.append(b" ".join(map(self.decimal.__getitem__, mine)))
                forms.append(b" ".join(map(self.forms.__getitem__, mine)))
        pieces, cuts = block.pieces, block.cuts.tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            mine = pieces[a:b].tolist()
            yield b" ".join(map(decimals.__getitem__, mine)), b" ".join(map(forms.__getitem__, mine))


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: token count and digests of its ids and of its decoded form; no shuffle."""

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            n, a, b = [], [], []
            for block in bpe.blocks(pick(batch, text_col).to_pylist()):
                n += block.counts().tolist()
                for ids, form in bpe.show(block):
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(form).hexdigest())
            yield pa.RecordBatch.from_arrays([pick(batch, id_col).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(docs.select(id_col, text_col)).mapInArrow(run, RESULT)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: its ids (array) and the decoded text."""

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            ids, out = [], []
            for block in bpe.blocks(pick(batch, text_col).to_pylist()):
                ids += np.split(block.ids.astype(np.int32), block.ends[1:-1])
                out += [form.decode() for _, form in bpe.show(block)]
            yield pa.RecordBatch.from_arrays([pick(batch, id_col).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(out, pa.string())], ["doc_id", "ids", "decoded"])

    return small_batches(docs.select(id_col, text_col)).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
