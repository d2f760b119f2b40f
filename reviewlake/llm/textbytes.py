"""Arrow string columns as numpy byte arrays: words, 64-bit word hashes and shingle hashes.

Every function works on whole texts.  A batch is cut between documents into slices of about
``SLICE_BYTES`` so that the temporary arrays stay bounded; a single longer document is one slice.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits (public splitmix64 constants)."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))
#: A-Z as a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table over byte values, true inside the closed ranges."""
    table = np.zeros(256, dtype=bool)
    for a, b in ranges:
        table[a:b + 1] = True
    return table


#: Word bytes of `[^\x20\x09-\x0D]+`: all but ASCII white space.
NON_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: digits, a-z, all of non-ASCII.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, UTF-8 bytes, offsets of rows and the end) of an Arrow string array.

    A null counts as an empty text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def word_spans(lowered: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words before each document (and in all)."""
    inside = is_word[lowered]
    size = len(lowered)
    edge = offsets[(offsets < size)]
    before = np.empty(size, dtype=bool)
    if size:
        before[0] = False
        before[1:] = inside[:-1]
        before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(size, dtype=bool)
    if size:
        after[-1] = False
        after[:-1] = inside[1:]
        after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _power_table(name: str, base: np.uint64, size: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < size:
        step = np.full(max(size, SLICE_BYTES + 1), base, dtype=np.uint64)
        step[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(step)
        if size <= 4 * SLICE_BYTES:
            _powers[name] = have
    return have


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of every span: a polynomial over random byte values, then mixed."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[data] * _power_table("up", _BASE, len(data))[:len(data)], out=total[1:])
        poly = (total[ends] - total[starts]) * _power_table("down", _INVERSE, len(data) + 1)[starts]
        return mix64(poly + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` consecutive words and their bounds per document.

    A document of fewer words, but not none, has its whole sequence as its one shingle.
    """
    n = len(words)
    counts = np.diff(bounds)
    salts = mix64(np.arange(11, 11 + width, dtype=np.uint64)) | _U(1)
    per_doc = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate(([0], np.cumsum(per_doc)))
    with np.errstate(over="ignore"):
        if n >= width:
            full = words[:n - width + 1] * salts[0]
            for k in range(1, width):
                full = full + words[k:n - width + 1 + k] * salts[k]
            full = mix64(full)
        else:
            full = np.empty(0, dtype=np.uint64)
        out = np.empty(out_bounds[-1], dtype=np.uint64)
        long_docs = counts >= width
        # positions where a whole shingle starts: all words but the last width-1 of each long document
        start_of = np.repeat(bounds[:-1][long_docs] - out_bounds[:-1][long_docs], per_doc[long_docs])
        place = np.repeat(long_docs, per_doc)
        where = np.flatnonzero(place)
        out[where] = full[where + start_of]
        for d in np.flatnonzero((counts > 0) & (counts < width)):
            h = _U(counts[d])
            for k, w in enumerate(words[bounds[d]:bounds[d + 1]]):
                h = h + w * salts[k]
            out[out_bounds[d]] = mix64(h + _U(0x51ED270B))
    return out, out_bounds


def segment_min(values: np.ndarray, bounds: np.ndarray, empty: int) -> np.ndarray:
    """Minimum of each segment [bounds[i], bounds[i+1]); `empty` where the segment has no value."""
    counts = np.diff(bounds)
    out = np.full(len(counts), empty, dtype=values.dtype)
    full = counts > 0
    if full.any():
        out[full] = np.minimum.reduceat(values, bounds[:-1][full])
    return out


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Row sums of each segment of a 1-d or 2-d array; zero where the segment is empty."""
    counts = np.diff(bounds)
    out = np.zeros((len(counts), *values.shape[1:]), dtype=values.dtype)
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0)
    return out
