"""Operator 3: near-duplicate groups by an LSH forest of MinHash signatures.

Every document has `trees` sorted signature orders of `depth` MinHash values each.  Documents whose
longest common prefix in some order is at least `min_prefix` share a *region* there.  A region whose
shingles fit one task is linked as it is; a larger one is cut at deeper prefixes until its parts fit
(adaptive depth).  Inside a part, neighbours in the sorted order are compared first and only documents
that are still in different components are compared further, on the whole shingle sets.  What cutting
could lose is restored exactly: the members of a cut region whose components differ are compared in
blocks against all of its members.

Exact copies (equal shingle sets) are one node; a task emits at most one link per member, so a group
of thousands of copies gives thousands of links, never their square.

With 16 trees and a prefix of 4, two documents of similarity 0.85 share no region with probability
(1 - 0.85^4)^16 = 8e-6 (0.80: 2e-4).  Within a region a pair is confirmed on full sets unless its 128
MinHash values agree by `slack` less than the threshold (0.15: over 4.2 standard deviations at 0.80).
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, textbytes as tb
from .components import components

TREES, DEPTH, MIN_PREFIX, SLACK = 16, 8, 4, 0.15
#: Shingle hashes (8 bytes each) of one task's region.
REGION_WEIGHT = 2_000_000
#: Bits of the filter of document ids whose sets a later step needs (8 MB).
FILTER_BITS = 1 << 26
_EMPTY_DIGEST = b"\x00" * 16


def document_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    for first, end, data, offsets in tb.text_slices(texts):
        lowered = tb.LOWER[data]
        starts, ends, bounds = tb.word_spans(lowered, offsets, tb.NON_SPACE)
        hashes, spans = tb.shingle_hashes(tb.span_hashes(lowered, starts, ends), bounds, shingle)
        for i in range(end - first):
            h = np.sort(hashes[spans[i]:spans[i + 1]])
            yield h if len(h) < 2 else h[np.concatenate(([True], h[1:] != h[:-1]))]


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """`size` MinHash values (uint32) of each set; all ones for an empty set."""
    multipliers = tb.mix64(np.arange(1000, 1000 + size, dtype=np.uint64)) | np.uint64(1)
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    flat = np.concatenate(sets) if len(sets) else np.empty(0, dtype=np.uint64)
    out = np.empty((len(sets), size), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k in range(size):
            out[:, k] = tb.segment_min(((flat * multipliers[k]) >> np.uint64(32)).astype(np.uint32), bounds, 0xFFFFFFFF)
    return out


def region_keys(sig: np.ndarray, trees: int, depth: int, prefix: int) -> np.ndarray:
    """One 64-bit key for each tree: a hash of the tree and of the first `prefix` values of its order."""
    salts = tb.mix64(np.arange(500, 500 + prefix, dtype=np.uint64)) | np.uint64(1)
    values = sig.reshape(len(sig), trees, depth)[:, :, :prefix].astype(np.uint64)
    with np.errstate(over="ignore"):
        return tb.mix64((values * salts).sum(2) + tb.mix64(np.arange(trees, dtype=np.uint64))).view(np.int64)


def _describe(shingle: int, trees: int, depth: int, prefix: int):
    """(id, text) -> (id, n_shingles, digest of the set, region keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = list(document_sets(part.column(1), shingle))
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else _EMPTY_DIGEST for s in sets]
                keys = region_keys(signatures(sets, trees * depth), trees, depth, prefix)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                    pa.array([k.tolist() if len(s) else None for k, s in zip(keys, sets)], pa.list_(pa.int64())),
                ], ["id", "n_shingles", "digest", "keys"])

    return run


def _place(col: str):
    """Bit of an id in the filter of wanted ids."""
    return F.pmod(F.xxhash64(col), F.lit(FILTER_BITS))


def wanted_bits(ids: DataFrame, col: str = "id") -> np.ndarray:
    """A filter of FILTER_BITS bits with the bit of every id set: built in Spark, of a fixed size however many ids."""
    place = _place(col) + 1
    rows = ids.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in rows:
        out[(r["b"] - 1) * 4096:r["b"] * 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def _with_sets(shingle: int, size: int, wanted):
    """(id, text, place) -> (id, sig, hashes): the full sets of documents whose id may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            place = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = list(document_sets(part.column(1), shingle))
                sig = signatures(sets, size).astype(">u4")
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([r.tobytes() for r in sig], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()),
                ], ["id", "sig", "hashes"])

    return run


class _Members:
    """The members of one region part, with the exact and the estimated similarity of pairs."""

    def __init__(self, table: pa.Table, size: int, num: int, den: int, slack: float):
        self.ids = table.column("id").to_numpy()
        self.sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()]
        self.sizes = np.array([len(s) for s in self.sets])
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=">u4").reshape(-1, size).astype(np.uint32)
        self.num, self.den, self.least = num, den, size * (num / den - slack)

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of `others` that link with member i, confirmed on full sets."""
        big, small = np.maximum(self.sizes[others], self.sizes[i]), np.minimum(self.sizes[others], self.sizes[i])
        others = others[small * self.den >= big * self.num]
        if len(others):
            others = others[(self.sig[others] == self.sig[i]).sum(1) >= self.least]
        if not len(others):
            return others
        bounds = np.concatenate(([0], np.cumsum(self.sizes[others])))
        flat, own = np.concatenate([self.sets[j] for j in others]), self.sets[i]
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        common = np.add.reduceat((own[at] == flat).astype(np.int64), bounds[:-1])
        return others[common * self.den >= (self.sizes[others] + self.sizes[i] - common) * self.num]


def link_region(m: _Members, labels: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """Links that join components.  `labels`: components known so far; `first`: the members to compare
    with all others, in sorted order.  One link at most for each union.
    """
    labels, links = labels.copy(), []

    def join(i: int, found: np.ndarray) -> None:
        for j in found:
            if labels[j] != labels[i]:
                links.append((int(m.ids[i]), int(m.ids[j])))
                labels[labels == labels[j]] = labels[i]

    n = len(m.ids)
    for step in (1, 2):  # the neighbours of the longest common prefix
        for i in range(n - step):
            if labels[i] != labels[i + step]:
                join(i, m.linked(i, np.array([i + step])))
    for i in first:
        join(i, m.linked(i, np.flatnonzero(labels != labels[i])))
    return links


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream sorted by `keys`, one table each."""
    rest: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        change = np.zeros(table.num_rows, dtype=bool)
        for k in keys:
            values = table.column(k).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(change), table.num_rows]
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            yield table.slice(a, b - a)
        rest = table.slice(cuts[-2]).combine_chunks()
    if rest is not None:
        yield rest


def _link(size: int, num: int, den: int, slack: float, keys: list[str]):
    """Members sorted by region part and signature order -> links (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for table in _groups(batches, keys):
            if table.num_rows < 2:
                continue
            m = _Members(table, size, num, den, slack)
            if "comp" in table.column_names:
                labels = table.column("comp").to_numpy()
                first = np.flatnonzero(table.column("is_u").to_numpy(zero_copy_only=False))
            else:
                labels, first = np.arange(len(m.ids)), np.arange(len(m.ids))
            out += link_region(m, labels, first)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["u", "v"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["u", "v"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100,
                    trees: int = TREES, depth: int = DEPTH, min_prefix: int = MIN_PREFIX, slack: float = SLACK, region_weight: int = REGION_WEIGHT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Documents link when |A & B| * den >= |A | B| * num over their sets of distinct `shingle`-word
    shingles (A-Z lower-cased; words are runs without ASCII white space).  component_id is the smallest
    id reachable over links; kept is id = component_id.

    Null and wordless texts have an empty set, 0 shingles, and stand alone.  Rows with equal texts are
    one component.  Rows that repeat an id are returned each; the links of all their texts count for the
    id, so an id has one component_id.  A null id takes part in nothing (component_id null, kept true).
    An empty table gives no rows.  Other columns are not read.
    """
    options = (shingle, num, den, trees, depth, min_prefix, slack, region_weight)
    if docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return _near_duplicates(docs, id_col, text_col, *options)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = shared.stored(rows.withColumn("key", F.monotonically_increasing_id()), "forest-rows")
    named = rows.where("id is not null")
    found = _near_duplicates(named, "key", "text", *options).select(F.col("key").alias("k"), "n_shingles", F.col("component_id").alias("c"))
    placed = shared.stored(named.select("id", "key").join(found, F.col("key") == F.col("k")).select("id", "n_shingles", "c"), "forest-placed")
    # the components of an id's rows are one
    first = placed.groupBy(F.col("id").alias("of")).agg(F.min("c").alias("first"))
    joined = components(placed.join(first, F.col("id") == F.col("of")).select(F.col("c").alias("u"), F.col("first").alias("v")))
    whole = placed.join(joined, F.col("c") == F.col("node"), "left").withColumn("w", F.coalesce("component", "c")).select("id", "n_shingles", "w")
    least = whole.groupBy(F.col("w").alias("of")).agg(F.min("id").alias("component_id"))
    out = whole.join(least, F.col("w") == F.col("of")).select("id", "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept").unionByName(_near_duplicates(rows.where("id is null"), "id", "text", *options).withColumnRenamed("id", id_col))


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, shingle: int, num: int, den: int, trees: int, depth: int, min_prefix: int, slack: float, region_weight: int) -> DataFrame:
    """`near_duplicates` of a table without repeated ids."""
    size = trees * depth
    base_in = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = shared.stored(base_in.mapInArrow(_describe(shingle, trees, depth, min_prefix), "id long, n_shingles long, digest binary, keys array<long>"), "forest")

    classes = (base.where("n_shingles > 0 and id is not null").groupBy("digest")
               .agg(F.min(F.struct("id", "n_shingles", "keys")).alias("m")).select("digest", "m.*"))
    classes = shared.stored(classes.withColumnRenamed("id", "rep"), "forest-classes")
    keyed = classes.select("rep", "n_shingles", F.posexplode("keys").alias("tree", "key"))
    weight = F.sum(F.col("n_shingles") + size).alias("weight")
    top = keyed.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n"), weight, F.min("rep").alias("least"),
                                           F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who")).where("n > 1")
    top = shared.stored(top, "forest-regions")
    # parts that fit a task; the same members in several trees are one part
    parts = top.where(F.col("weight") <= region_weight).dropDuplicates(["n", "least", "who"]).select("key")
    large = top.where(F.col("weight") > region_weight).select(F.col("key").alias("top"))
    member_rows = keyed.join(parts, "key").select("rep", "tree", "key")
    cut = not large.isEmpty()
    needed = member_rows.select(F.col("rep").alias("id"))
    if cut:
        inside = shared.stored(keyed.withColumnRenamed("key", "top").join(large, "top"), "forest-large")
        needed = needed.union(inside.select(F.col("rep").alias("id")))
    # texts are not shuffled: a filter of fixed size leaves out most that no region needs, the joins below the others
    wanted = docs.sparkSession.sparkContext.broadcast(wanted_bits(needed))
    texts = base_in.where("id is not null").withColumn("place", _place("id"))
    sets = texts.mapInArrow(_with_sets(shingle, size, wanted), "id long, sig binary, hashes binary")
    if cut:
        sets = shared.stored(sets, "forest-sets")
        # adaptive depth: rows of a large region take the shallowest deeper prefix whose part fits
        left = inside.join(sets.select(F.col("id").alias("rep"), "sig").dropDuplicates(["rep"]), "rep")
        for d in range(min_prefix + 1, depth + 1):
            here = F.xxhash64("tree", F.lit(d), F.substring(F.col("sig"), F.col("tree") * (depth * 4) + 1, F.lit(d * 4)))
            left = shared.stored(left.withColumn("key", here), f"forest-depth{d}")
            found = left.groupBy("key").agg(F.count(F.lit(1)).alias("n"), weight)
            sized = left.join(found, "key")
            fits = sized.where((F.col("weight") <= region_weight) & (F.col("n") > 1))
            member_rows = member_rows.unionByName(fits.select("rep", "tree", "key"))
            left = sized.where(F.col("weight") > region_weight).drop("n", "weight", "key")
            if d == depth:
                # equal to the full depth: blocks by hash; the pass over components below does the rest
                blocks = F.ceil(F.col("weight") / region_weight).cast("long")
                whole = sized.where(F.col("weight") > region_weight)
                member_rows = member_rows.unionByName(whole.select("rep", "tree", F.xxhash64("key", F.pmod(F.xxhash64("rep"), blocks)).alias("key")))
        member_rows = shared.stored(member_rows.distinct(), "forest-members")
    width = shared.shuffle_width(docs.sparkSession)
    order = F.substring(F.col("sig"), F.col("tree") * (depth * 4) + 1, F.lit(depth * 4))

    def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.withColumn("ord", order).repartition(width, *keys).sortWithinPartitions(*keys, "ord", "id").drop("ord", "tree")

    placed = member_rows.withColumnRenamed("rep", "id").join(sets, "id")
    links = dealt(placed, ["key"]).mapInArrow(_link(size, num, den, slack, ["key"]), "u long, v long")
    comps = components(links)
    if cut:
        inside = inside.withColumnRenamed("rep", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node"))
        inside = shared.stored(inside.select("node", "n_shingles", "tree", "top", "comp"), "forest-inside")
        by_comp = inside.groupBy("top", "comp").agg(weight)
        split = by_comp.groupBy("top").agg(F.max_by("comp", "weight").alias("main"), F.count(F.lit(1)).alias("n"), F.sum("weight").alias("all"), F.max("weight").alias("most")).where("n > 1")
        rows = inside.join(split, "top").withColumn("is_u", F.col("comp") != F.col("main"))
        grid = lambda w: F.greatest(F.lit(1), F.ceil(w / (region_weight / 2))).cast("long")
        rows = rows.withColumn("nb", grid(F.col("all"))).withColumn("nu", grid(F.col("all") - F.col("most")))
        one = rows.withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb"))).withColumn("ub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nu") - 1))).withColumn("is_u", F.lit(False))
        two = rows.where("is_u").withColumn("ub", F.pmod(F.xxhash64("node"), F.col("nu"))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
        both = one.unionByName(two).select(F.col("node").alias("id"), "tree", "top", "b", "ub", "comp", "is_u").join(sets, "id")
        more = dealt(both, ["top", "b", "ub"]).mapInArrow(_link(size, num, den, slack, ["top", "b", "ub"]), "u long, v long")
        comps = components(comps.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    named = classes.select("digest", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select(F.col("digest").alias("set_digest"), F.coalesce("component", "rep").alias("component_id"))
    some = base.where("n_shingles > 0").select("id", "n_shingles", "digest").join(named, F.col("digest") == F.col("set_digest"), "left")
    none = base.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = some.select("id", "n_shingles", "component_id").unionByName(none)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
