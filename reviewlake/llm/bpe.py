"""Operator 7: byte-level BPE encoding by overlapping chunks, and decoding.

A long text is cut into chunks that overlap; the chunks are pre-tokenised in parallel, each from its
own start, and stitched where two neighbours have a pre-token boundary in common: from a shared boundary
on they agree, since the split looks only forward.  A pre-token that covers a whole overlap leaves no
shared boundary; then the text is split again from the last sure one.  Pieces are encoded one by one;
decoding joins the raw bytes of the ids.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Code points of a chunk, and those it shares with the next one.
CHUNK, OVERLAP = 32_768, 512
#: Pieces of each of two generations whose ids one Python worker remembers, and the longest such piece.
MAX_KNOWN, LONGEST_KNOWN = 250_000, 64


class _Known(dict):
    """Ids of pieces; a missing one is encoded, or taken over from the older generation."""

    def __init__(self, encode_piece: Callable[[bytes], list[int]]):
        self.encode_piece, self.older = encode_piece, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.older.get(piece)
        if found is None:
            found = tuple(self.encode_piece(piece.encode()))
        if len(piece) <= LONGEST_KNOWN:
            if len(self) >= MAX_KNOWN:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class BytePairs:
    """Ranks of a tiktoken file: encoding and decoding of pieces."""

    def __init__(self, path: str):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.known = _Known(self.encode_piece)

    def encode_piece(self, raw: bytes) -> list[int]:
        """Merge the adjacent pair of the lowest rank, the leftmost first, until none is left."""
        if raw in self.ranks:
            return [self.ranks[raw]]
        return self._encode_short(raw) if len(raw) <= 64 else self._encode_long(raw)

    def _encode_short(self, raw: bytes) -> list[int]:
        get, none = self.ranks.get, 1 << 60
        parts = [raw[i:i + 1] for i in range(len(raw))]
        pairs = [get(raw[i:i + 2], none) for i in range(len(raw) - 1)]
        while pairs:
            least = min(pairs)
            if least == none:
                break
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def _encode_long(self, raw: bytes) -> list[int]:
        n, ranks = len(raw), self.ranks
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        pair = lambda i: ranks.get(raw[i:after[after[i]]]) if after[i] < n else None
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or after[after[i]] != end:
                continue  # one of its parts has been merged since
            gone = after[i]
            alive[gone] = False
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            for j in (before[i], i):
                if j >= 0 and (r := pair(j)) is not None:
                    heapq.heappush(heap, (r, j, after[after[j]]))
        return [ranks[raw[i:after[i]]] for i in range(n) if alive[i]]

    def encode(self, pieces: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(path)


def pretoken_ends(chunk: str, pattern: str) -> list[int]:
    """End of every pre-token of a chunk."""
    return [m.end() for m in regex.compile(pattern).finditer(chunk)]


def stitch(text: str, starts: list[int], ends: list[list[int]], pattern: str) -> list[int]:
    """Pre-token ends of the whole text from those of its chunks, each counted from the chunk's start.

    A chunk's last pre-token may go on in the next chunk, and is not sure.
    """
    sure = list(ends[0])
    for start, own in zip(starts[1:], ends[1:]):
        sure.pop()
        here = [start + e for e in own]
        known = set(sure[bisect_left(sure, start):])
        common = next((k for k, e in enumerate(here) if e in known), None)
        if start in known or (sure and sure[-1] == start):
            common = -1
        if common is not None:
            at = start if common < 0 else here[common]
            del sure[bisect_left(sure, at) + 1:]
            sure += here[common + 1:]
        else:  # no boundary in common: split again from the last sure one to this chunk's end
            again = sure[-1] if sure else 0
            stop = here[-1] if here else start
            sure += [again + e for e in pretoken_ends(text[again:stop], pattern)]
    return sure


def _pieces(text: str, ends: list[int]) -> list[str]:
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _finish(kind: str, coder: BytePairs) -> Callable[[list[list[int]]], list[pa.Array]]:
    """Columns made of the ids of each row."""

    def digests(ids: list[list[int]]) -> list[pa.Array]:
        return [
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids], pa.string()),
        ]

    def whole(ids: list[list[int]]) -> list[pa.Array]:
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))]

    return digests if kind == "digests" else whole


COLUMNS = {"digests": (["n_tokens", "ids_sha256", "decoded_sha256"], "n_tokens long, ids_sha256 string, decoded_sha256 string"),
           "ids": (["n_tokens", "token_ids"], "n_tokens long, token_ids array<int>")}


def _encode_short(path: str, pattern: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, split = byte_pairs(path), regex.compile(pattern).findall
        finish = _finish(kind, coder)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [coder.encode(split(t or "")) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(1), *finish(ids)], ["row", *COLUMNS[kind][0]])

    return run


def _cut(chunk: int, overlap: int, row_type):
    """(text, row, key) of long texts -> overlapping chunks; the row goes with the first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, key = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                row = batch.column(1).slice(i, 1)
                for k, a in enumerate(range(0, len(text), chunk)):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([key], pa.int64()), pa.array([k], pa.int64()), pa.array([a], pa.int64()), pa.array([text[a:a + chunk + overlap]], pa.string()),
                        row if k == 0 else pa.nulls(1, row.type),
                    ], ["key", "k", "start", "chunk", "row"])

    return run


def _split(pattern: str):
    """Pre-tokenise chunks, each for itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                ends = pretoken_ends(part.column(3)[0].as_py(), pattern)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([ends], pa.list_(pa.int32()))], [*part.schema.names, "ends"])

    return run


def _join(path: str, pattern: str, chunk: int, kind: str):
    """Chunks sorted by text and place -> the encoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pairs(path)
        finish = _finish(kind, coder)

        def done(parts: list[tuple], row: pa.Array) -> pa.RecordBatch:
            text = "".join([p[1][:chunk] for p in parts[:-1]] + [parts[-1][1]])
            ends = stitch(text, [p[0] for p in parts], [p[2] for p in parts], pattern)
            return pa.RecordBatch.from_arrays([row, *finish([coder.encode(_pieces(text, ends))])], ["row", *COLUMNS[kind][0]])

        key, parts, row = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                k = batch.column(0)[i].as_py()
                if k != key and parts:
                    yield done(parts, row)
                    parts = []
                if not parts:
                    key, row = k, batch.column(4).slice(i, 1)
                parts.append((batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), batch.column(5)[i].as_py()))
        if parts:
            yield done(parts, row)

    return run


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", kind: str = "ids", keep: list[str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The rows of `docs` (their columns `keep`, all by default) with n_tokens and the ids of the text,
    or digests of the ids and of the decoded bytes, by the ranks in the tiktoken file at `path`.

    A null or empty text has no ids.  Rows are independent: repeated rows, null ids and further columns
    pass through; a column named like a new one is replaced; an empty table gives no rows.
    """
    names, fields = COLUMNS[kind]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    rows = docs.select(F.col(text_col).alias("text"), row.alias("row"))
    shape = rows.schema["row"].dataType.simpleString()
    short = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk).mapInArrow(_encode_short(path, pattern, kind), f"row {shape}, {fields}")
    # the place of a row in the scan names it: the same again if a task is run again
    long = rows.withColumn("key", F.monotonically_increasing_id()).where(F.length("text") > chunk)
    cut = long.mapInArrow(_cut(chunk, overlap, shape), f"key long, k long, start long, chunk string, row {shape}")
    width = shared.shuffle_width(docs.sparkSession)
    split = cut.repartition(width, "key", "k").mapInArrow(_split(pattern), f"key long, k long, start long, chunk string, row {shape}, ends array<int>")
    joined = split.repartition(width, "key").sortWithinPartitions("key", "k").mapInArrow(_join(path, pattern, chunk, kind), f"row {shape}, {fields}")
    return short.unionByName(joined).select("row.*", *names)


def decode(encoded: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """`encoded` with the bytes of its ids as a binary column; null ids give null."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != out_col)
    names = [f.name for f in encoded.schema if f.name != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pairs(path)
        for batch in batches:
            raw = [None if x is None else coder.decode(x) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(raw, pa.binary())], [*names, out_col])

    return encoded.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, f"{shape}, `{out_col}` binary")


def encoding_report(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    out = encode(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), path, pattern, kind="digests", keep=["doc_id"])
    return out.select("doc_id", *COLUMNS["digests"][0])
