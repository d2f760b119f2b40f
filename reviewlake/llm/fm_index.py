"""Operator 9: benchmark decontamination by an FM-index per shard of training text.

A shard is a block of whole documents inside a task.  Its words become symbols: a benchmark word has
its own symbol, all others one break symbol.  The shard's FM-index (suffix order, Burrows-Wheeler
string in a wavelet matrix, suffix positions sampled every `SAMPLE` symbols) is searched backwards for
all phrases at once; occurrences are located by walking to a sampled position, and their word spans are
merged per document.

Runs of benchmark words shorter than the shortest phrase are left out of the shard's string: no phrase
can occur in them.  Break symbols sort by position, which keeps repeated documents cheap; every
position after a break is sampled, so no walk crosses one.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, textbytes as tb

SHARD_BYTES = 1 << 20
SAMPLE = 8
#: Text bytes of the benchmark items that one pass searches; a larger benchmark takes several passes.
BENCHMARK_BLOCK = 4 << 20


class Phrases:
    """The distinct windows of a block of benchmark items, over symbols of the block's own words."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int):
        words, ids = [], []
        for item, text in items:
            starts_hashes = text_words(text)
            if len(starts_hashes):
                ids.append(item)
                words.append(starts_hashes)
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.empty(0, dtype=np.uint64)
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        of: dict[tuple[int, ...], set[int]] = {}
        for item, hashes in zip(ids, words):
            symbols = (np.searchsorted(self.vocabulary, hashes) + 1).tolist()
            for k in range(max(1, len(symbols) - width + 1)):
                of.setdefault(tuple(symbols[k:k + width]), set()).update([] if item is None else [item])
        windows = sorted(of, key=lambda w: (len(w), w))
        self.lengths = np.array([len(w) for w in windows], dtype=np.int64)
        self.symbols = np.zeros((len(windows), width), dtype=np.int64)
        for i, w in enumerate(windows):
            self.symbols[i, width - len(w):] = w
        self.items = [sorted(of[w]) for w in windows]
        self.shortest = int(self.lengths.min()) if len(windows) else 0

    def symbols_of(self, hashes: np.ndarray) -> np.ndarray:
        """1.. for a benchmark word, 0 for any other."""
        out = np.zeros(len(hashes), dtype=np.int64)
        likely = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        if len(likely):
            at = np.searchsorted(self.vocabulary, hashes[likely])
            at[at == len(self.vocabulary)] = 0
            same = self.vocabulary[at] == hashes[likely]
            out[likely[same]] = at[same] + 1
        return out


def text_words(text: str | None) -> np.ndarray:
    """Word hashes of one text."""
    raw = tb.LOWER[np.frombuffer((text or "").encode(), dtype=np.uint8)]
    starts, ends, _ = tb.word_spans(raw, np.array([0, len(raw)]), tb.ALNUM)
    return tb.span_hashes(raw, starts, ends)


def suffix_order(t: np.ndarray, bits: int) -> np.ndarray:
    """Positions of `t` in suffix order; every 0 is a symbol of its own, ordered by position.

    The last symbol must be 0.
    """
    n = len(t)
    packed = min(n, max(1, 63 // bits))
    key, alive = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for k in range(packed):
        symbol = np.zeros(n, dtype=np.int64)
        symbol[:n - k] = t[k:]
        alive &= symbol > 0
        key = (key << bits) | np.where(alive, symbol, 0)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = (ordered[1:] != ordered[:-1]) | ((ordered[1:] & ((1 << bits) - 1)) == 0)  # a break inside: settled by position
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = packed
    while True:
        tied = ~new
        tied[:-1] |= tied[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            return order
        at = order[rows]
        follow = rank[at + step]
        inside = np.lexsort((follow, rank[at]))
        at, follow = at[inside], follow[inside]
        order[rows] = at
        group = rank[at]
        fresh = np.ones(len(rows), dtype=bool)
        fresh[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        new[rows] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, rows, 0))
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a string, one bit plane for each bit of a symbol."""

    def __init__(self, s: np.ndarray, bits: int):
        self.planes = []
        for b in range(bits - 1, -1, -1):
            bit = ((s >> b) & 1).astype(bool)
            ones = np.zeros(len(s) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.planes.append((b, len(s) - int(ones[-1]), ones))
            s = np.concatenate((s[~bit], s[bit]))

    def path(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, zeros, ones in self.planes:
            up = ones[at]
            at = np.where((symbols >> b) & 1, zeros + up, at - up)
        return at


class FMIndex:
    def __init__(self, t: np.ndarray, bits: int):
        self.n = len(t)
        order = suffix_order(t, bits)
        self.bwt = t[order - 1]  # position 0 follows the last symbol, a break
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=1 << bits))))
        self.tree = WaveletMatrix(self.bwt, bits)
        symbols = np.arange(1 << bits)
        self.origin = self.tree.path(symbols, np.zeros(1 << bits, dtype=np.int64))
        self.sampled = (order % SAMPLE == 0) | (self.bwt == 0)
        self.sample_at = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def step(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Row of `symbol` put before the suffix of each row (or before a range's end)."""
        return self.counts[symbols] + self.tree.path(symbols, rows) - self.origin[symbols]

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all phrases: (phrase, first row, end row) of those that occur."""
        width = phrases.symbols.shape[1]
        live = np.arange(len(phrases.lengths))
        lo, hi = np.zeros(len(live), dtype=np.int64), np.full(len(live), self.n, dtype=np.int64)
        for k in range(width):
            symbols = phrases.symbols[live, width - 1 - k]
            on = symbols > 0
            lo, hi = np.where(on, self.step(symbols, lo), lo), np.where(on, self.step(symbols, hi), hi)
            found = lo < hi
            live, lo, hi = live[found], lo[found], hi[found]
        return live, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row."""
        walked, out, todo = np.zeros(len(rows), dtype=np.int64), np.empty(len(rows), dtype=np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            done = self.sampled[rows[todo]]
            ready = todo[done]
            out[ready] = self.samples[self.sample_at[rows[ready]]] + walked[ready]
            todo = todo[~done]
            rows[todo] = self.step(self.bwt[rows[todo]], rows[todo])
            walked[todo] += 1
        return out


def shard_string(symbols: np.ndarray, bounds: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of runs of at least `shortest` benchmark words, a break after each, and their words."""
    at = np.flatnonzero(symbols)
    if not len(at):
        return np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    doc = np.searchsorted(bounds, at, side="right")
    starts = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]))))
    lengths = np.diff(np.concatenate((starts, [len(at)])))
    keep = lengths >= shortest
    at = at[np.repeat(keep, lengths)]
    run = np.repeat(np.arange(keep.sum()), lengths[keep])
    t = np.zeros(len(at) + int(keep.sum()) + (not keep.any()), dtype=np.int64)
    word = np.zeros(len(t), dtype=np.int64)
    t[np.arange(len(at)) + run] = symbols[at]
    word[np.arange(len(at)) + run] = at
    return t, word


def shard_matches(data: np.ndarray, offsets: np.ndarray, phrases: Phrases):
    """Of one shard: (words per document, hit words per document, (document, item) pairs, spans).

    Spans are (document, first byte, end byte) of maximal runs of hit words, within the shard's bytes.
    """
    lowered = tb.LOWER[data]
    starts, ends, bounds = tb.word_spans(lowered, offsets, tb.ALNUM)
    hit = np.zeros(len(starts) + 1, dtype=np.int64)
    pairs = np.empty((0, 2), dtype=np.int64)
    if phrases.shortest and len(starts):
        t, word = shard_string(phrases.symbols_of(tb.span_hashes(lowered, starts, ends)), bounds, phrases.shortest)
        if len(t) > phrases.shortest:
            index = FMIndex(t, phrases.bits)
            found, lo, hi = index.search(phrases)
            many = hi - lo
            rows = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum()) if len(many) else np.empty(0, dtype=np.int64)
            first = word[index.locate(rows)]
            phrase = np.repeat(found, many)
            np.add.at(hit, first, 1)
            np.add.at(hit, first + phrases.lengths[phrase], -1)
            doc = np.searchsorted(bounds, first, side="right") - 1
            seen = np.unique(np.stack([doc, phrase], 1), axis=0) if len(doc) else pairs
            pairs = np.array(sorted({(int(d), i) for d, p in seen for i in phrases.items[p]}), dtype=np.int64).reshape(-1, 2)
    is_hit = (np.cumsum(hit)[:-1] > 0).astype(np.int64)
    at = np.flatnonzero(is_hit)
    doc = np.searchsorted(bounds, at, side="right") - 1
    edge = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]))) if len(at) else np.empty(0, dtype=bool)
    firsts = np.flatnonzero(edge)
    lasts = np.concatenate((firsts[1:], [len(at)]))[:len(firsts)] - 1
    spans = np.stack([doc[firsts], starts[at[firsts]], ends[at[lasts]]], 1) if len(at) else np.empty((0, 3), dtype=np.int64)
    return np.diff(bounds), tb.segment_sum(is_hit, bounds), pairs, spans


FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<long>, n_hit long"


def _find(phrases, with_text: bool):
    """(id, text) -> (id, [text,] FOUND columns); spans in bytes of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = phrases.value
        for batch in batches:
            for first, end, data, offsets in tb.text_slices(batch.column(1), SHARD_BYTES):
                n_words, n_hit, pairs, spans = shard_matches(data, offsets, block)
                items: list[list[int]] = [[] for _ in range(end - first)]
                for d, i in pairs.tolist():
                    items[d].append(i)
                places: list[list[dict]] = [[] for _ in range(end - first)]
                for d, a, b in spans.tolist():
                    places[d].append({"start": a - int(offsets[d]), "end": b - int(offsets[d])})
                kept = ["id", "text"][:1 + with_text]
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(k).slice(first, end - first) for k in kept), pa.array(n_words, pa.int64()),
                    pa.array(places, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(items, pa.list_(pa.int64())), pa.array(n_hit, pa.int64()),
                ], [*kept, "n_words", "spans", "items", "n_hit"])

    return run


def _block_bounds(benchmark: DataFrame, text_col: str, limit: int) -> range:
    """Numbers of the blocks of about `limit` text bytes that the benchmark is dealt to."""
    total = benchmark.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return range(max(1, -(-total // limit)))


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The blocks of the benchmark, one at a time on the driver."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    blocks = _block_bounds(benchmark, text_col, limit)
    for b in blocks:
        part = items if len(blocks) == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(len(blocks))) == b)
        yield [(r["id"], r["text"]) for r in part.collect()]


def _block_hits(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, width: int, block_bytes: int) -> DataFrame:
    """(key, all, items) of the rows (key, text, ..) with a hit: the spans and items of all blocks of the benchmark."""
    spark = rows.sparkSession
    found = []
    for items in _item_blocks(benchmark, item_col, item_text_col, block_bytes):
        phrases = spark.sparkContext.broadcast(Phrases(items, width))
        found.append(rows.select(F.col("key").alias("id"), "text").mapInArrow(_find(phrases, False), f"id long, {FOUND}").where("n_hit > 0").select(F.col("id").alias("key"), "spans", "items"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"),
                                    F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def _keyed(rows: DataFrame) -> DataFrame:
    """`rows` written once with a key of each row's own, so that all blocks see the same keys."""
    return shared.stored(rows.withColumn("key", F.monotonically_increasing_id()), "fm-rows")


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", width: int = 10, block_bytes: int = BENCHMARK_BLOCK, with_text: bool = True) -> DataFrame:
    """One row per document: id, [text,] n_words, spans (byte ranges of hit words, merged), items, n_hit.

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters.  A phrase is `width`
    consecutive words of an item, or all words of a shorter one; phrases match whole words within a
    document.  Null or empty texts have no words; items without words match nothing; items without an
    id are searched but not named; repeated items count once; an empty benchmark finds nothing.  Other columns are not read.  A benchmark above
    `block_bytes` is searched block by block and the hits are merged by a key of each row's own, so null
    and repeated ids give the same rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shape = f"id long, {'text string, ' * with_text}{FOUND}"
    if len(_block_bounds(benchmark, item_text_col, block_bytes)) == 1:
        items = next(_item_blocks(benchmark, item_col, item_text_col, block_bytes))
        return rows.mapInArrow(_find(docs.sparkSession.sparkContext.broadcast(Phrases(items, width)), with_text), shape)
    rows = _keyed(rows)
    joined = rows.join(_block_hits(rows, benchmark, item_col, item_text_col, width, block_bytes), "key", "left")
    return joined.select("id", "text", "all", "items").mapInArrow(_merge(with_text), shape)


def merged_spans(text: str | None, found: list[dict] | None) -> tuple[list[dict], int]:
    """The sorted spans of several blocks as maximal runs of hit words, and the number of words under them."""
    if not found:
        return [], 0
    raw, out = (text or "").encode(), []
    for s in found:
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        elif out and not tb.ALNUM[tb.LOWER[np.frombuffer(raw[out[-1]["end"]:s["start"]], dtype=np.uint8)]].any():
            out[-1]["end"] = s["end"]
        else:
            out.append(dict(s))
    return out, sum(len(text_words(raw[s["start"]:s["end"]].decode())) for s in out)


def _merge(with_text: bool):
    """(id, text, all, items) -> (id, [text,] FOUND columns); null `all`: no hit in any block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in tb.text_slices(batch.column("text"), SHARD_BYTES):
                _, _, bounds = tb.word_spans(tb.LOWER[data], offsets, tb.ALNUM)
                part = batch.slice(first, end - first)
                merged = [merged_spans(t, f) for t, f in zip(part.column("text").to_pylist(), part.column("all").to_pylist())]
                kept = ["id", "text"][:1 + with_text]
                yield pa.RecordBatch.from_arrays([
                    *(part.column(k) for k in kept), pa.array(np.diff(bounds), pa.int64()),
                    pa.array([m for m, _ in merged], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([i or [] for i in part.column("items").to_pylist()], pa.list_(pa.int64())), pa.array([n for _, n in merged], pa.int64()),
                ], [*kept, "n_words", "spans", "items", "n_hit"])

    return run


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    found = benchmark_matches(docs, benchmark, with_text=False, **options)
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the byte ranges `spans` (sorted, apart) and the spaces before them."""
    if not spans or text is None:
        return text
    raw, out, at = text.encode(), [], 0
    for start, end in spans:
        out.append(raw[at:start].rstrip(b" "))
        at = end
    return b"".join([*out, raw[at:]]).decode()


def _clean(phrases, names: list[str]):
    """(text, others) -> (text without hit spans, n_hit, others), for a benchmark of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = phrases.value
        for batch in batches:
            for first, end, data, offsets in tb.text_slices(batch.column(0), SHARD_BYTES):
                _, n_hit, _, spans = shard_matches(data, offsets, block)
                part = batch.slice(first, end - first)
                text = part.column(0)
                if len(spans):
                    places: dict[int, list[tuple[int, int]]] = {}
                    for d, a, b in spans.tolist():
                        places.setdefault(d, []).append((a - int(offsets[d]), b - int(offsets[d])))
                    text = pa.array([cut(t, places.get(d, [])) for d, t in enumerate(text.to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([text, pa.array(n_hit, pa.int64()), *part.columns[1:]], ["text", "n_hit", *names])

    return run


def _clean_joined(names: list[str]):
    """(text, all, others) -> (text without hit spans, n_hit, others), for hits of several blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            merged = [merged_spans(t, f) for t, f in zip(texts, batch.column("all").to_pylist())]
            text = [cut(t, [(s["start"], s["end"]) for s in m]) for t, (m, _) in zip(texts, merged)]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array([n for _, n in merged], pa.int64()), *(batch.column(c) for c in names)],
                                             ["text", "n_hit", *names])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BENCHMARK_BLOCK, **options) -> DataFrame:
    """`docs` with every hit span cut out of its text; documents of which no word is left are dropped.

    Documents without a hit stay as they are, wordless and null texts too.  Columns keep their names and
    order.  A benchmark above `block_bytes` is searched block by block, as in `benchmark_matches`.
    """
    other = [f for f in docs.schema if f.name != text_col]
    names = [f"c{i}" for i in range(len(other))]
    shape = ", ".join(["text string, n_hit long", *(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, other))])
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{f.name}`").alias(n) for n, f in zip(names, other)])
    blocks = list(_block_bounds(benchmark, options.get("item_text_col", "text"), block_bytes))
    if len(blocks) == 1:
        items = next(_item_blocks(benchmark, options.get("item_col", "item_id"), options.get("item_text_col", "text"), block_bytes))
        phrases = docs.sparkSession.sparkContext.broadcast(Phrases(items, options.get("width", 10)))
        out = rows.mapInArrow(_clean(phrases, names), shape)
    else:
        rows = _keyed(rows)
        hits = _block_hits(rows, benchmark, options.get("item_col", "item_id"), options.get("item_text_col", "text"), options.get("width", 10), block_bytes)
        out = rows.join(hits, "key", "left").select("text", "all", *names).mapInArrow(_clean_joined(names), shape)
    left = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").rlike(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
    back = {f.name: n for n, f in zip(names, other)} | {text_col: "text"}
    return out.where((F.col("n_hit") == 0) | left).select(*[F.col(back[c]).alias(c) for c in docs.columns])


def items_digest(items: list[int]) -> str:
    """The digest of a list of items, as the report gives it."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
