"""Operator 2: token counts by compiled finite-state transducers.

Two deterministic transducers run in cascade, and no text is ever tokenised:

* The *boundary* transducer reads classes of code points and emits where pre-tokens begin.  It has a
  dozen states, so a chunk of text is a map from state to state; the maps of all chunks of a block are
  built side by side and composed by a parallel prefix scan, after which each chunk knows its state.
* The *count* transducer reads the bytes of a pre-token and emits changes of the token count.  Its state
  is all that merging can still depend on: the longest suffix that begins a token, and the last token
  and the count at each position in it.  It is in its start state at each boundary, so its chunk maps are
  constant there and compose by addition.  Transitions are compiled when first taken and kept up to a
  bound; compiling again gives the same.

A byte-pair encoding is the only sequence of tokens whose neighbours would not merge differently if
they were encoded alone as a pair; hence the encoding of a prefix ends in exactly one token that fits
the one before it, and the count at a position is one more than where that token begins.
"""
from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

# ---- boundary transducer -------------------------------------------------------------------------

#: Unicode White_Space (fixed values).
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# classes of code points; TEXT_START precedes each text
OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE, TEXT_START, ENDS, BEGINS_E, L_LOWER, E_LOWER = range(11)
# states: what the current pre-token is so far
START, LETTERS, NUMBERS, MARKS, SPACE_1, SPACE_N, BLANK_1, BLANK_N, QUOTED, QUOTED_E, QUOTED_L = range(11)
HERE, BEFORE = 1, 2  # emitted: a pre-token begins at this code point, or at the one before
_LETTERS = (LETTER, ENDS, BEGINS_E, L_LOWER, E_LOWER)


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[WHITE_SPACE] = BLANK
    table[0x20], table[0x27] = SPACE, QUOTE
    for c in "stmd":  # the endings of one letter
        table[ord(c)] = ENDS
    table[ord("r")] = table[ord("v")] = BEGINS_E
    table[ord("l")], table[ord("e")] = L_LOWER, E_LOWER
    return table


def boundary_transitions() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) by state and class, of
    `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`.
    """
    fresh = {OTHER: MARKS, NUMBER: NUMBERS, SPACE: SPACE_1, BLANK: BLANK_1, QUOTE: QUOTED, TEXT_START: START} | {c: LETTERS for c in _LETTERS}
    runs = {LETTERS: _LETTERS, NUMBERS: (NUMBER,), MARKS: (OTHER, QUOTE)}
    nxt, emit = np.zeros((11, 11), dtype=np.uint8), np.zeros((11, 11), dtype=np.uint8)
    for state in range(11):
        for c in range(11):
            to, out = fresh[c], HERE
            if state in runs and c in runs[state]:
                to, out = state, 0
            elif state in (SPACE_1, SPACE_N, BLANK_1, BLANK_N):
                if c in (SPACE, BLANK):
                    to, out = (SPACE_N if c == SPACE else BLANK_N), 0
                elif state in (SPACE_1, SPACE_N):  # the last space belongs to what follows
                    to, out = (MARKS if c == QUOTE else fresh[c]), (BEFORE if state == SPACE_N else 0)
                else:
                    out = HERE | (BEFORE if state == BLANK_N else 0)
            elif state == QUOTED:
                if c in (OTHER, QUOTE):
                    to, out = MARKS, 0
                elif c in (ENDS, BEGINS_E, L_LOWER):
                    to, out = {ENDS: START, BEGINS_E: QUOTED_E, L_LOWER: QUOTED_L}[c], 0
            elif state in (QUOTED_E, QUOTED_L):
                if c == (E_LOWER if state == QUOTED_E else L_LOWER):
                    to, out = START, 0
                else:  # no ending after all: the letter before begins a run of letters
                    out = BEFORE if c in _LETTERS else BEFORE | HERE
            if c == TEXT_START:
                to, out = START, (BEFORE if state in (QUOTED_E, QUOTED_L) else 0)
            nxt[state, c], emit[state, c] = to, out
    return nxt, emit


_NEXT, _EMIT = boundary_transitions()
_CHUNK = 64


def boundaries(classes: np.ndarray) -> np.ndarray:
    """True where a pre-token begins, for a block of texts that each follow a TEXT_START.

    Chunk maps are composed by a parallel prefix scan; then every chunk runs from its own state.
    """
    n, states = len(classes), len(_NEXT)
    chunks = max(1, -(-n // _CHUNK))
    padded = np.full(chunks * _CHUNK, TEXT_START, dtype=np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(chunks, _CHUNK).T)
    nxt, emit, k = _NEXT.ravel(), _EMIT.ravel(), _NEXT.shape[1]
    row_of = np.arange(256, dtype=np.uint8) * k  # state -> row of the flat tables
    maps = np.repeat(np.arange(states, dtype=np.uint8)[:, None], chunks, axis=1)
    for column in columns:
        maps = nxt[row_of[maps] + column]
    maps = np.ascontiguousarray(maps.T)  # one map for each chunk
    step = 1
    while step < chunks:
        maps = np.concatenate((maps[:step], np.take_along_axis(maps[step:], maps[:-step], axis=1)))
        step *= 2
    state = np.empty(chunks, dtype=np.uint8)
    state[0] = START
    state[1:] = maps[:-1, START]
    out = np.empty((_CHUNK, chunks), dtype=np.uint8)
    for j, column in enumerate(columns):
        at = row_of[state] + column
        out[j] = emit[at]
        state = nxt[at]
    emitted = np.ascontiguousarray(out.T).ravel()
    begins = (emitted & HERE).astype(bool)
    begins[:-1] |= (emitted[1:] & BEFORE).astype(bool)
    return begins[:n]


# ---- count transducer ----------------------------------------------------------------------------

#: Compiled states, and pre-tokens of each of two generations whose count is remembered, in one Python worker.
MAX_STATES, MAX_KNOWN = 250_000, 200_000


def byte_of_symbol() -> dict[str, int]:
    """The byte that each printable symbol of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class CountTransducer:
    """The byte-pair encoding of a `tokenizers` file as a transducer of token counts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_of_symbol()
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        to_bytes = lambda s: bytes(of[c] for c in s)
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        self.tokens: set[bytes] = {bytes([b]) for b in range(256)}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            left, right = to_bytes(a), to_bytes(b)
            self.ranks[left, right] = rank
            self.tokens.add(left + right)
        self.prefixes = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: (suffix, last token at each position from its start, count there less the count now)
        start = (b"", (None,), (0,))
        self.states, self.number, self.moves = [start], {start: 0}, {}
        if len(self.fits) > 2 * MAX_STATES:
            self.fits = {}

    def merge(self, raw: bytes) -> list[bytes]:
        """Tokens of a short byte string by its merges, lowest rank first, leftmost first."""
        parts = [raw[i:i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.ranks:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _fits(self, left: bytes | None, token: bytes) -> bool:
        key = (left or b"", token)
        if key not in self.fits:
            self.fits[key] = self.merge(key[0] + token) == ([left, token] if left else [token])
        return self.fits[key]

    def _compile(self, state: int, byte: int) -> int:
        """The transition of `byte` from `state`: next state << 9 | change of the count + 256."""
        suffix, last, counts = self.states[state]
        longer = suffix + bytes([byte])
        m = len(longer)
        for at in range(m):  # the longest token first
            token = longer[at:]
            if token in self.tokens and self._fits(last[at], token):
                break
        else:
            raise ValueError("the vocabulary does not cover a byte")
        change = counts[at] + 1
        keep = next((k for k in range(m) if longer[k:] in self.prefixes), m)
        new = (longer[keep:], (*last[keep:], token) if keep < m else (token,), tuple(c - change for c in (*counts[keep:], change)) if keep < m else (0,))
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
        move = self.moves[state << 8 | byte] = number << 9 | change + 256
        return move

    def count(self, piece: bytes) -> int:
        """Tokens of one pre-token."""
        found = self.known.get(piece)
        if found is not None:
            return found
        found = self.older.get(piece)
        if found is not None:
            return self._remember(piece, found)
        if len(self.states) > MAX_STATES:
            self._reset()
        state, total, get = 0, 0, self.moves.get
        for b in piece:
            move = get(state << 8 | b)
            if move is None:
                move = self._compile(state, b)
            state = move >> 9
            total += (move & 511) - 256
        return self._remember(piece, total) if len(piece) <= 64 else total

    def _remember(self, piece: bytes, total: int) -> int:
        if len(self.known) >= MAX_KNOWN:
            self.known, self.older = {}, self.known
        self.known[piece] = total
        return total


@lru_cache(maxsize=2)
def transducer(path: str) -> CountTransducer:
    return CountTransducer(path)


def token_counts(texts: list[str], path: str) -> np.ndarray:
    """Token count of each text; special strings in a text are one token each, as the library's default."""
    machine = transducer(path)
    owners, parts, extra = [], [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        pieces = [text]
        for special in machine.special:
            if special in text:
                pieces = [q for p in pieces for q in p.split(special)]
        extra[i] = len(pieces) - 1
        owners += [i] * len(pieces)
        parts += pieces
    # a TEXT_START before every part: one code point that is counted nowhere
    joined = "\0" + "\0".join(parts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    classes = code_point_classes()[points]
    marks = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    classes[marks[:-1]] = TEXT_START
    begins = boundaries(classes)
    begins[marks[:-1]] = True
    data = np.frombuffer(joined.encode("utf-8"), dtype=np.uint8)
    byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    start_points = np.flatnonzero(begins)
    starts = byte_at[start_points]
    ends = np.append(starts[1:], len(data))
    # the mark itself is a span of one byte, or joins none: skip it
    is_mark = np.zeros(len(points), dtype=bool)
    is_mark[marks[:-1]] = True
    starts = starts + is_mark[start_points]
    real = starts < ends
    starts, ends, start_points = starts[real], ends[real], start_points[real]
    _, first, inverse = np.unique(tb.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    raw = data.tobytes()
    count = machine.count
    each = np.fromiter((count(raw[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist())), dtype=np.int64, count=len(first))
    part = np.searchsorted(marks, start_points, side="right") - 1
    totals = np.bincount(np.array(owners)[part], weights=each[inverse], minlength=len(texts)).astype(np.int64) if len(part) else np.zeros(len(texts), dtype=np.int64)
    return totals + extra


def token_count_report(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, by the byte-level `tokenizers` file at `path`.

    A null text counts as empty: 0 bytes, 0 tokens.  Rows are independent: repeated rows and null ids
    are returned as they come; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in tb.text_slices(batch.column(1), 1 << 20):
                texts = [t or "" for t in batch.column(1).slice(first, end - first).to_pylist()]
                tokens = token_counts(texts, path)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, end - first), pa.array(np.diff(offsets), pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit, pa.bool_()),
                ], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
