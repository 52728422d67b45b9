"""Media columns: PNG written and read back in numpy, and cosine-transform hashes.

A payload is stored as rows of 8-bit RGB samples. Each row takes that of the five row filters whose
differences are smallest in sum. Reading tests the signature, every chunk's checksum and order,
inflates the data and undoes the filters in numpy, for the rows of many images at once: along a
diagonal no sample depends on another, so a diagonal of all images is one array operation. The
feature is a 64-bit hash: signs of the low-frequency cosine coefficients against their median,
in integers, so that equal texts have equal hashes wherever they stand.

Null texts are empty; an empty text still has one row of samples; an empty table has no rows.
Equal texts give equal values, repeated rows and ids a result each. A very long text is handled by
itself; it takes some ten times its bytes. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoweft.llm.textkit import blocks, pick, small_batches, utf8

# Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
NONE, SUB, UP, AVERAGE, PAETH = range(5)
#: Bytes of a sample row: 64 RGB pixels.
ROW_BYTES = 192
#: Rows filtered at a time, and lanes in which images are read at a time.
FILTER_ROWS, LANES = 4096, 64


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, up and corner (int16) the one nearest to left + up - corner; ties go in this order."""
    p, q = b - c, a - c
    r = np.abs(p + q)
    np.abs(p, out=p)
    np.abs(q, out=q)
    return np.where((p <= q) & (p <= r), a, np.where(q <= r, b, c))


def filter_rows(rows: np.ndarray, tops: np.ndarray, c: int, row_filter: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Filter of each row and its filtered bytes; ``tops`` marks the first row of each image.

    Without ``row_filter`` a row takes the filter with the least sum of absolute differences.
    """
    kinds, out = np.zeros(len(rows), np.uint8), np.empty_like(rows)
    for lo in range(0, len(rows), FILTER_ROWS):
        hi = min(len(rows), lo + FILTER_ROWS)
        x = rows[lo:hi].astype(np.int16)
        up = np.zeros_like(x)
        up[1:] = x[:-1]
        if lo:
            up[0] = rows[lo - 1]
        up[tops[lo:hi]] = 0
        left, corner = np.zeros_like(x), np.zeros_like(x)
        left[:, c:], corner[:, c:] = x[:, :-c], up[:, :-c]
        guesses = [None, left, up, (left + up) >> 1, _paeth(left, up, corner)]
        if row_filter is not None:
            kinds[lo:hi] = row_filter
        least = None
        for kind, guess in enumerate(guesses):
            if row_filter not in (None, kind):
                continue
            d = (x if guess is None else x - guess).astype(np.uint8)
            if row_filter is not None:
                out[lo:hi] = d
                continue
            cost = np.abs(d.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64)
            if least is None:
                least, out[lo:hi] = cost, d
            else:
                better = cost < least
                out[lo:hi][better] = d[better]
                kinds[lo:hi][better], least = kind, np.minimum(cost, least)
    return kinds, out


def unfilter_rows(kinds: np.ndarray, rows: np.ndarray, heights: np.ndarray, c: int) -> np.ndarray:
    """Undo the filters of images of one width, whose rows follow each other.

    Images are dealt to lanes of about equal height; in every lane the diagonals go one by one.
    """
    if kinds.max(initial=0) > PAETH:
        raise ValueError("unknown row filter")
    n, width = rows.shape
    if not n or not width:
        return rows.copy()
    first = np.cumsum(heights) - heights
    lanes = int(max(1, min(LANES, len(heights), n // max(1, int(heights.max())))))
    tall = -(-n // lanes)
    # an image goes to the lane in which its first row would lie; lanes end up at most one image apart
    lane = first // tall
    start = np.zeros(lanes, np.int64)
    start[np.unique(lane)] = first[np.unique(lane, return_index=True)[1]]
    size = np.bincount(lane, heights, lanes).astype(np.int64)
    high = int(size.max())
    w = max(2, width // c)
    image = np.zeros((lanes, (high + 1) * w + 1, c), np.uint8)  # one row of zeros and one sample before
    kind, top = np.zeros((lanes, high), np.uint8), np.zeros((lanes, high), bool)
    inside = image[:, w + 1 :].reshape(lanes, high, w, c)
    tops = np.zeros(n, bool)
    tops[first] = True
    for i, (a, m) in enumerate(zip(start.tolist(), size.tolist(), strict=True)):
        inside[i, :m, : width // c] = rows[a : a + m].reshape(m, width // c, c)
        kind[i, :m], top[i, :m] = kinds[a : a + m], tops[a : a + m]
    for d in range(high + w - 1):
        y0, y1 = max(0, d - w + 1), min(high - 1, d) + 1
        at = 1 + w + y0 * (w - 1) + d
        end = at + (y1 - y0 - 1) * (w - 1) + 1
        part = lambda back: image[:, at - back : end - back : w - 1].astype(np.int16)  # noqa: E731, B023
        left, up, corner = part(1), part(w), part(w + 1)
        if y1 - 1 == d:  # the first sample of a row
            left[:, -1], corner[:, -1] = 0, 0
        fresh = top[:, y0:y1]
        up[fresh], corner[fresh] = 0, 0
        k = kind[:, y0:y1, None]
        guess = np.where(k == PAETH, _paeth(left, up, corner), np.where(k == AVERAGE, (left + up) >> 1, np.where(k == UP, up, np.where(k == SUB, left, 0))))
        image[:, at : end : w - 1] += guess.astype(np.uint8)
    out = np.empty_like(rows)
    for i, (a, m) in enumerate(zip(start.tolist(), size.tolist(), strict=True)):
        out[a : a + m] = inside[i, :m, : width // c].reshape(m, width)
    return out


def _png(kinds: np.ndarray, rows: np.ndarray, c: int, level: int) -> bytes:
    h, n = rows.shape
    lines = np.empty((h, n + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kinds, rows
    color = {v: k for k, v in CHANNELS.items()}[c]
    head = struct.pack(">IIBBBBB", n // c, h, 8, color, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.data, level)) + _chunk(b"IEND", b"")


def encode_png(samples: np.ndarray, row_filter: int | None = None, level: int = 6) -> bytes:
    """(height, width, channels) uint8 samples; without ``row_filter`` each row takes its best one."""
    h, w, c = samples.shape
    if row_filter is not None and not NONE <= row_filter <= PAETH:
        raise ValueError(f"row_filter: {row_filter}")
    return _png(*filter_rows(samples.reshape(h, w * c), np.arange(h) == 0, c, row_filter), c, level)


def chunks(png: bytes):
    """(kind, body) of each chunk; ValueError at a bad signature, length or checksum."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("truncated chunk")
        (n,) = struct.unpack_from(">I", png, at)
        if at + 12 + n > len(png):
            raise ValueError("truncated chunk")
        body = png[at + 4 : at + 8 + n]
        if struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(body):
            raise ValueError(f"checksum of {body[:4]!r}")
        yield body[:4], body[4:]
        at += 12 + n


def inflate(png: bytes) -> tuple[np.ndarray, int]:
    """(height, 1 + row bytes) filtered lines and the channels of an 8-bit, non-interlaced PNG."""
    head, data, ended = None, [], False
    for kind, body in chunks(png):
        if ended or (head is None) != (kind == b"IHDR"):
            raise ValueError("chunk order")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
    if head is None or not ended:
        raise ValueError("truncated PNG")
    w, h, depth, color, *rest = head
    if depth != 8 or color not in CHANNELS or any(rest):
        raise ValueError("only 8-bit samples without interlacing")
    c = CHANNELS[color]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(raw) != h * (w * c + 1):
        raise ValueError("data size")
    return raw.reshape(h, w * c + 1), c


def unfilter(lines: np.ndarray, c: int) -> np.ndarray:
    """Samples of one image's filtered lines."""
    return unfilter_rows(lines[:, 0], lines[:, 1:], np.array([len(lines)]), c)


def decode_png(png: bytes) -> np.ndarray:
    """(height, width, channels) samples."""
    lines, c = inflate(png)
    return unfilter(lines, c).reshape(len(lines), -1, c)


_N = 32
#: Cosine basis in units of 1 / 4096.
_DCT = np.round(4096 * np.cos(np.pi / _N * (np.arange(_N)[None, :] + 0.5) * np.arange(8)[:, None])).astype(np.int64)


def _slices(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of _N nearly equal slices of each size (they overlap where it is smaller)."""
    nth = np.arange(_N)
    low = size[:, None] * nth // _N
    return low, np.maximum(low + 1, size[:, None] * (nth + 1) // _N)


def cosine_hashes(rows: np.ndarray, heights: np.ndarray, c: int) -> list[str]:
    """Of each image 64 signs of the 8 x 8 low-frequency coefficients of its grey values, as hex."""
    grey = rows.reshape(len(rows), -1, c).sum(axis=2, dtype=np.int64)
    sums = np.zeros((len(grey) + 1, grey.shape[1]), np.int64)
    np.cumsum(grey, axis=0, out=sums[1:])
    first = (np.cumsum(heights) - heights)[:, None]
    low, high = _slices(heights)
    xl, xh = (x[0] for x in _slices(np.array([grey.shape[1]])))
    small = sums[first + high] - sums[first + low]  # image, slice, column
    across = np.zeros((*small.shape[:2], small.shape[2] + 1), np.int64)
    np.cumsum(small, axis=2, out=across[:, :, 1:])
    area = (high - low)[:, :, None] * (xh - xl)
    mean = 1024 * (across[:, :, xh] - across[:, :, xl]) // area
    flat = (_DCT @ mean @ _DCT.T).reshape(len(heights), 64)
    bits = flat > np.median(flat[:, 1:], axis=1, keepdims=True)
    return [b.tobytes().hex() for b in np.packbits(bits, axis=1)]


def cosine_hash(samples: np.ndarray) -> str:
    h, w, c = samples.shape
    return cosine_hashes(samples.reshape(h, w * c), np.array([h]), c)[0]


def hamming(a: str, b: str) -> int:
    return (int(a, 16) ^ int(b, 16)).bit_count()


def sample_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sample rows of the texts of a block, each filled up with spaces, and the rows of each."""
    size = np.diff(offsets)
    heights = np.maximum(1, -(-size // ROW_BYTES))
    flat = np.full(int(heights.sum()) * ROW_BYTES, 32, np.uint8)
    at = (np.cumsum(heights) - heights) * ROW_BYTES
    for i, (a, n) in enumerate(zip(at.tolist(), size.tolist(), strict=True)):
        flat[a : a + n] = data[offsets[i] : offsets[i] + n]
    return flat.reshape(-1, ROW_BYTES), heights


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Store each text as PNG, read it back and describe it; ``with_media`` keeps the binary column."""

    def described(data, offsets):
        rows, heights = sample_rows(data, offsets)
        ends = np.cumsum(heights).tolist()
        tops = np.zeros(len(rows), bool)
        tops[[0, *ends[:-1]]] = True
        kinds, filtered = filter_rows(rows, tops, 3)
        spans = list(zip([0, *ends], ends, strict=False))
        pngs = [_png(kinds[a:b], filtered[a:b], 3, 6) for a, b in spans]
        del rows, kinds, filtered
        lines = np.concatenate([inflate(p)[0] for p in pngs])
        back = unfilter_rows(lines[:, 0], lines[:, 1:], heights, 3)
        del lines
        hashes = cosine_hashes(back, heights, 3)
        for n, png, (a, b), feature in zip(np.diff(offsets).tolist(), pngs, spans, hashes, strict=True):
            payload = back[a:b].tobytes()
            row = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), feature)
            yield (*row, png) if with_media else row

    def run(batches):
        for batch in batches:
            data, offs = utf8(pick(batch, text_col))
            ids = pick(batch, id_col).cast(pa.int64())
            for a, b in blocks(offs):
                cols = zip(*described(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]), strict=True)
                arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *arrays], ["doc_id", *names])

    i, s = pa.int64(), pa.string()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [i, i, s, i, i, s, s]
    if with_media:
        names, types = [*names, "media"], [*types, pa.binary()]
    return small_batches(docs.select(id_col, text_col)).mapInArrow(run, RESULT + (", media binary" if with_media else ""))
