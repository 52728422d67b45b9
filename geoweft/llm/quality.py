"""Line-first cleaning: lines that break a rule go, then documents that lose too much go.

Rules of a line that has a word (all counts are of whole lines of whole texts):

* symbols: more than a tenth as many of ``#*$%&|<>`` as word characters;
* navigation: at most ``nav_words`` words and no closing punctuation;
* boilerplate: one of the phrases below, in any letter case (A-Z);
* repeated: equal to an earlier line of the document.

A document is rejected if the base rules reject it (fewer than ten words, or more than a fifth
of its words in five-word windows that occur twice), or if the removed lines hold more than
``most_lost`` percent of its word characters. Null texts are empty and rejected. Documents are
judged one by one: repeated rows get the same result, null ids stay null, nothing is shuffled; an
empty table gives no rows. A very long text is read whole. Other columns play no part, and stay
as they are in ``clean_documents``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoweft.llm.textkit import blocks, hash_spans, mix, ngram_hash, per_row, pick, small_batches, utf8, word_spans
from geoweft.llm.textkit import LOWER, U64

# Boilerplate phrases.
PHRASES = [
    "all rights reserved", "click here", "cookie policy", "licensed under", "log in to", "privacy policy",
    "share this", "sign up for", "subscribe to", "terms of service", "terms of use", "this website uses cookies",
]
# Symbols, and the last bytes of closing punctuation.
SYMBOLS, CLOSING = b"#*$%&|<>", b".!?:;\")'"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
NAV_WORDS, MOST_LOST = 3, 50

RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lost_chars long, kept boolean"


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL, _CLOSE = _table(SYMBOLS), _table(CLOSING)
_PHRASE = re.compile("|".join(map(re.escape, PHRASES)).encode())


def _repeated(key: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def measure(data: np.ndarray, offsets: np.ndarray, nav_words: int = NAV_WORDS, most_lost: int = MOST_LOST) -> dict[str, np.ndarray]:
    """Measures of each text of a block, and its lines: line_start, line_end, line_row, line_failed."""
    n = len(offsets) - 1
    ws, we, wr = word_spans(data, offsets)
    n_words = per_row(wr, n)
    point = (data & 0xC0) != 0x80
    points = np.concatenate(([0], np.cumsum(point)))
    chars = points[we] - points[ws]
    word_chars = per_row(wr, n, chars)
    at_symbol = np.flatnonzero(_SYMBOL[data])
    n_symbols = per_row(np.searchsorted(offsets, at_symbol, "right") - 1, n)

    # five-word windows that occur twice in a text; a window never spans two texts
    g = ngram_hash(hash_spans(data, ws, we), WINDOW)
    covered = np.zeros(len(ws) + 1, np.int64)
    if len(g):
        inside = np.flatnonzero(wr[: len(g)] == wr[WINDOW - 1 :])
        twice = inside[_repeated(g[inside] ^ mix(wr[inside].astype(U64)))] if len(inside) else inside
        np.add.at(covered, twice, 1)
        np.subtract.at(covered, np.minimum(twice + WINDOW, len(ws)), 1)
    n_repeat = per_row(wr[np.cumsum(covered[:-1]) > 0], n)

    # lines with a word
    newline = np.flatnonzero(data == 10)
    cut_at = np.unique(np.concatenate((offsets[:-1], newline + 1, offsets[-1:])))
    ls, le = cut_at[:-1], cut_at[1:].copy()
    if len(ls):
        le[data[le - 1] == 10] -= 1
    word_line = np.searchsorted(ls, ws, "right") - 1
    has = np.unique(word_line)
    lw, lc = per_row(word_line, len(ls))[has], per_row(word_line, len(ls), chars)[has]
    last = np.zeros(len(ls), np.int64)
    last[word_line] = we - 1  # the last word of a line wins
    lsym = per_row(np.searchsorted(ls, at_symbol, "right") - 1, len(ls))[has]
    closed = _CLOSE[data[last[has]]]
    ls, le = ls[has], le[has]
    lr = np.searchsorted(offsets, ls, "right") - 1
    key = hash_spans(data, ls, le) ^ mix(lr.astype(U64))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    phrase = np.zeros(len(ls), bool)
    hits = [m.start() for m in _PHRASE.finditer(LOWER[data].tobytes())]
    if hits and len(ls):
        hits = np.array(hits)
        line = np.searchsorted(ls, hits, "right") - 1
        ok = (line >= 0) & (hits < le[line])
        phrase[line[ok]] = True
    failed = (lsym * 10 > lc) | ((lw <= nav_words) & ~closed) | phrase | again
    lost = per_row(lr[failed], n, lc[failed])
    base = (n_words < MIN_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": per_row(lr[again], n), "n_repeat_words": n_repeat,
        "base_failed": base, "lost_chars": lost, "kept": ~base & (100 * lost <= most_lost * word_chars),
        "line_start": ls, "line_end": le, "line_row": lr, "line_failed": failed,
    }


def _cleaned(data: np.ndarray, n: int, m: dict[str, np.ndarray]) -> list[str]:
    """Texts of the lines that stay, joined by a newline."""
    raw, out = data.tobytes(), [[] for _ in range(n)]
    stay = ~m["line_failed"]
    for r, a, b in zip(m["line_row"][stay].tolist(), m["line_start"][stay].tolist(), m["line_end"][stay].tolist(), strict=True):
        out[r].append(raw[a:b])
    return [b"\n".join(x).decode() for x in out]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, nav_words: int = NAV_WORDS, most_lost: int = MOST_LOST) -> DataFrame:
    """Rows RESULT per document; ``with_text`` adds the cleaned text."""
    names = [x.split()[0] for x in RESULT.split(", ")][1:]

    def run(batches):
        for batch in batches:
            data, offs = utf8(pick(batch, text_col))
            ids = pick(batch, id_col).cast(pa.int64())
            for a, b in blocks(offs):
                part, o = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                m = measure(part, o, nav_words, most_lost)
                cols = [ids.slice(a, b - a), *[pa.array(m[c]) for c in names]]
                if with_text:
                    cols.append(pa.array(_cleaned(part, b - a, m), pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *names, *(["text"] if with_text else [])])

    return small_batches(docs.select(id_col, text_col)).mapInArrow(run, RESULT + (", text string" if with_text else ""))


def clean_documents(docs: DataFrame, **kw) -> DataFrame:
    """The documents that stay, with their cleaned text and its length; other columns as they were."""
    schema, names = docs.schema, docs.columns

    def run(batches):
        for batch in batches:
            data, offs = utf8(pick(batch, "text"))
            for a, b in blocks(offs):
                part, o = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                m = measure(part, o, **kw)
                stay = pa.array(m["kept"])
                texts = pa.array(_cleaned(part, b - a, m), pa.string()).filter(stay)
                rows = batch.slice(a, b - a).filter(stay)
                new = {"text": texts, "n_chars": pa.array([len(t) for t in texts.to_pylist()], pa.int64())}
                new = {c: v.cast(rows.schema.field(c).type) for c, v in new.items() if c in names}
                yield pa.RecordBatch.from_arrays([new.get(c, rows.column(i)) for i, c in enumerate(names)], names)

    return small_batches(docs).mapInArrow(run, schema)


def oracle_sql() -> str:
    word, symbol = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"
    phrase = "|".join(p.replace(" ", r"\x20") for p in PHRASES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(text, '{word}') AS ws FROM d)),
wc AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r),
g AS (SELECT r, i, word || chr(10) || lead(word, 1) OVER x || chr(10) || lead(word, 2) OVER x || chr(10) || lead(word, 3) OVER x || chr(10) || lead(word, 4) OVER x AS g FROM w WINDOW x AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, i FROM g WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS j FROM t) GROUP BY r),
l0 AS (SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT r, string_split(text, chr(10)) AS ls FROM d)),
l1 AS (SELECT r, line, i, regexp_extract_all(line, '{word}') AS ws FROM l0),
l AS (SELECT r, line, len(ws) AS lw, list_sum(list_transform(ws, lambda x: length(x))) AS lc, len(regexp_extract_all(line, '{symbol}')) AS ls, right(ws[-1], 1) AS z, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again FROM l1 WHERE len(ws) > 0),
f AS (SELECT r, sum(again::INT) AS dup, sum(CASE WHEN ls * 10 > lc OR (lw <= {NAV_WORDS} AND NOT contains('{CLOSING.decode().replace("'", "''")}', z)) OR regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{phrase}') OR again THEN lc ELSE 0 END) AS lost FROM l GROUP BY r),
m AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '{symbol}'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_chars FROM d LEFT JOIN wc USING (r) LEFT JOIN rep USING (r) LEFT JOIN f USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, NOT base_failed AND 100 * lost_chars <= {MOST_LOST} * word_chars AS kept FROM b"""
