"""Operator 11: SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are grouped into parts, correlated bits together.  Part i has a threshold t_i (or -1: the part
is not searched) with sum(t_i) = radius - parts + 1; two fingerprints within the radius then differ in at
most t_i bits of some part i.  Dynamic programming picks the thresholds, and the number of parts, that
cost the fewest candidates and probes, estimated over all fingerprints.  Each fingerprint enters the
buckets of its part values and, where t_i > 0, of the values at most t_i bits away; the members of a bucket
are verified on all 64 bits and give at most a few links each, never all their pairs.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, textbytes as tb
from .components import components

SEED, SHINGLE, RADIUS = 42, 4, 4
#: Numbers of parts that are weighed up.
PARTS = (2, 3, 4, 5)
#: Cost of a probe (a row that is dealt out) in candidates (a comparison of two numbers).
PROBE_COST = 40.0
#: Members of a bucket that one task compares with each other; larger buckets are cut.
BUCKET = 8192
_SMALL = 32
_SHIFTS = 16
_VOTE_ROWS = 1 << 16
_ROWS = 1024


def shingle_prints(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit fingerprint of each text: a bit is set if it is in over half of the XXH64 hashes of the
    text's word shingles, repeats included."""
    out = np.zeros(len(texts), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for first, end, data, offsets in tb.text_slices(texts):
        lowered = tb.LOWER[data]
        starts, ends, bounds = tb.word_spans(lowered, offsets, tb.NON_SPACE)
        if not len(starts):
            continue
        # the words of the slice joined by one space each
        sizes = ends - starts
        at = np.concatenate(([0], np.cumsum(sizes + 1)))
        source = np.repeat(starts - at[:-1], sizes + 1) + np.arange(at[-1])
        joined = lowered[np.minimum(source, len(lowered) - 1)]
        joined[at[1:] - 1] = 32
        text = joined.tobytes()
        counts = np.diff(bounds)
        per_doc = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
        spans = np.concatenate(([0], np.cumsum(per_doc)))
        word = np.arange(spans[-1]) + np.repeat(bounds[:-1] - spans[:-1], per_doc)
        last = np.minimum(word + shingle, np.repeat(bounds[1:], per_doc))
        ups = np.zeros((end - first, 64), dtype=np.int64)
        doc = np.repeat(np.arange(end - first), per_doc)
        for lo in range(0, len(word), _VOTE_ROWS):
            a, b = at[word[lo:lo + _VOTE_ROWS]].tolist(), (at[last[lo:lo + _VOTE_ROWS]] - 1).tolist()
            hashes = np.array([digest(text[x:y], seed) for x, y in zip(a, b)], dtype=np.uint64)
            raised = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            here, begin = np.unique(doc[lo:lo + _VOTE_ROWS], return_index=True)
            ups[here] += np.add.reduceat(raised, begin, axis=0, dtype=np.int64)
        bits = np.packbits(2 * ups > per_doc[:, None], axis=1, bitorder="little")
        out[first:end] = bits.view("<u8").ravel()
    return out


def _fingerprint(shingle: int, seed: int):
    """(id, text) -> (id, fp) with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shingle_prints(part.column(1), shingle, seed).view(np.int64))], ["id", "fp"])

    return run


def _bit_matrix(fps: np.ndarray) -> np.ndarray:
    """0 / 1 for bit 0 to 63 of each fingerprint."""
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp -> (k, n): how often bits k // 64 and k % 64 are both set; 4096 counts the rows."""
    total = np.zeros(64 * 64 + 1, dtype=np.int64)
    for batch in batches:
        bits = _bit_matrix(batch.column(0).to_numpy()).astype(np.float64)
        total[:-1] += np.rint(bits.T @ bits).astype(np.int64).ravel()
        total[-1] += len(bits)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "n"])


def correlation(both: np.ndarray, n: int) -> np.ndarray:
    """Absolute correlation of bits from the counts of joint ones; 0 for a bit that never changes."""
    share = np.diagonal(both) / n
    spread = np.sqrt(share * (1 - share))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.abs(both / n - np.outer(share, share)) / np.outer(spread, spread)
    return np.nan_to_num(out, nan=0.0, posinf=0.0)


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Disjoint groups of bits, of equal sizes but for one bit.  A group starts from the free bit least
    correlated with those before and takes the free bit of the highest mean correlation with it."""
    bits, groups = len(corr), []
    free = list(range(bits))
    for g in range(parts):
        size = bits // parts + (g < bits % parts)
        taken = [b for group in groups for b in group]
        group = [min(free, key=lambda b: (corr[b, taken].sum(), b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def mask_of(group: list[int]) -> int:
    return sum(1 << b for b in group)


def _distances(masks: list[int], most: int):
    """fp -> (k, n): of pairs of rows a few places apart, how many differ in (k % (most + 1)) bits under mask
    k // (most + 1); the last k counts the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(masks) * (most + 1) + 1, dtype=np.int64)
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for shift in range(1, min(_SHIFTS, len(fps) - 1) + 1):
                apart = fps[shift:] ^ fps[:-shift]
                total[-1] += len(apart)
                for i, m in enumerate(masks):
                    near = np.bitwise_count(apart & np.uint64(m))
                    total[i * (most + 1):(i + 1) * (most + 1)] += np.bincount(near[near <= most], minlength=most + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "n"])

    return run


def near_share(seen: np.ndarray, pairs: int, differ: np.ndarray) -> np.ndarray:
    """Estimated share of pairs within 0, 1, ... bits of a part: as seen in the pairs, and at least what
    independent bits that differ with probabilities `differ` give (too rare to be seen)."""
    chance = np.zeros(len(seen) + 1)
    chance[0] = 1.0
    for p in differ:
        chance[1:] = chance[1:] * (1 - p) + chance[:-1] * p
        chance[0] *= 1 - p
    observed = np.cumsum(seen) / pairs if pairs else np.zeros(len(seen))
    return np.maximum(observed, np.cumsum(chance[:-1]))


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds of each part with the given sum and the least total cost; costs[i][t + 1] is part i's
    cost at threshold t, from -1 on."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t, c in enumerate(row, start=-1):
                key = total + t
                if key not in following or cost + c < following[key][0]:
                    following[key] = (cost + c, [*chosen, t])
        best = following
    return best[budget]


def search_plan(prints: DataFrame, radius: int = RADIUS, choices: tuple[int, ...] = PARTS, probe_cost: float = PROBE_COST) -> list[tuple[int, int]]:
    """(mask, threshold) of each part that is searched, for a table of distinct fingerprints `fp`.

    Two passes over the fingerprints count joint bits and distances of pairs of rows; the driver gets
    4,097 and a few dozen numbers.
    """
    rows = prints.mapInArrow(_bit_counts, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(64 * 64 + 1, dtype=np.int64)
    for r in rows:
        both[r["k"]] = r["n"]
    n = int(both[-1])
    if n < 2:
        return []
    both = both[:-1].reshape(64, 64)
    groups = {m: group_bits(correlation(both, n), m) for m in choices}
    flat = [g for m in choices for g in groups[m]]
    rows = prints.mapInArrow(_distances([mask_of(g) for g in flat], radius), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(len(flat) * (radius + 1) + 1, dtype=np.int64)
    for r in rows:
        seen[r["k"]] = r["n"]
    share = np.diagonal(both) / n
    differ = 2 * share * (1 - share)
    plans, at = [], 0
    for m in choices:
        costs = []
        for g in groups[m]:
            near = near_share(seen[at * (radius + 1):(at + 1) * (radius + 1)], int(seen[-1]), differ[g])
            # half of the probes are made: see _flips
            probes = [1 + sum(comb(len(g), k) for k in range(1, t + 1)) / 2 for t in range(radius + 1)]
            costs.append([0.0] + [n * (probe_cost * probes[t] + n * near[t] / 2) for t in range(radius + 1)])
            at += 1
        cost, chosen = allocate(costs, radius - m + 1)
        plans.append((cost, [(mask_of(g), t) for g, t in zip(groups[m], chosen) if t >= 0]))
    return min(plans, key=lambda p: p[0])[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _flips(mask: int, threshold: int) -> list[tuple[int, int]]:
    """(bits to flip, their lowest bit) of every value 1 to `threshold` bits away.  A fingerprint makes a
    probe only where its own lowest flipped bit is 0, so of two rows one probes the other."""
    bits = [b for b in range(64) if mask >> b & 1]
    return [(_signed(sum(1 << b for b in c)), _signed(1 << c[0])) for k in range(1, threshold + 1) for c in combinations(bits, k)]


def bucket_rows(prints: DataFrame, plan: list[tuple[int, int]]) -> DataFrame:
    """(key, fp, own): every fingerprint in the bucket of each part value, and as a probe (own false) in
    those within the part's threshold."""
    made = []
    for i, (mask, threshold) in enumerate(plan):
        value = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        flips = _flips(mask, threshold)
        keys = F.array(F.struct(value.alias("v"), F.lit(True).alias("own")))
        if flips:
            away = F.from_json(F.lit(str([list(f) for f in flips])), "array<array<bigint>>")
            away = F.filter(away, lambda f: value.bitwiseAND(f[1]) == 0)
            keys = F.concat(keys, F.transform(away, lambda f: F.struct(value.bitwiseXOR(f[0]).alias("v"), F.lit(False).alias("own"))))
        made.append(prints.select("fp", F.explode(keys).alias("k")).select(F.xxhash64(F.lit(i), "k.v").alias("key"), "fp", "k.own"))
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def _pairs_of_small(key: np.ndarray, fps: np.ndarray, own: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """Linked pairs (u, v) of sorted rows whose buckets have at most _SMALL members."""
    for shift in range(1, _SMALL):
        i = np.flatnonzero(key[shift:] == key[:-shift])
        if not len(i):
            return
        j = i + shift
        i, j = (x[(own[i] | own[j]) & (np.bitwise_count(fps[i] ^ fps[j]) <= radius) & (fps[i] != fps[j])] for x in (i, j))
        if len(i):
            yield np.stack((fps[i], fps[j]))


def link_bucket(fps: np.ndarray, own: np.ndarray, labels: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join members of different labels: each `own` member with all others, at most one link
    for each union."""
    labels, links = labels.copy(), []
    for i in np.flatnonzero(own):
        other = np.flatnonzero(labels != labels[i])
        if not len(other):
            break
        for j in other[np.bitwise_count(fps[other] ^ fps[i]) <= radius]:
            if labels[j] != labels[i]:
                links.append((fps[i], fps[j]))
                labels[labels == labels[j]] = labels[i]
    return links


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by `key`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if held and held[-1].column("key")[-1].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        elif cut:  # the group held ends in this batch
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, batch = [], batch.slice(cut)
            cut = 0
        if cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
            batch = batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _link(radius: int):
    """(key, fp, own[, label]) sorted by key -> links (u, v)."""

    def batch_of(found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in np.ascontiguousarray(found)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            key, fps = table.column("key").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
            own = table.column("own").to_numpy()
            labels = table.column("label").to_numpy() if "label" in table.column_names else None
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.append(starts, len(key)))
            small = np.repeat((sizes <= _SMALL) & (labels is None), sizes)
            for found in _pairs_of_small(key[small], fps[small], own[small], radius):
                yield batch_of(found)
            for a, size in zip(starts, sizes):
                if (size > _SMALL or labels is not None) and size > 1:
                    here = slice(a, a + size)
                    known = np.unique(fps[here], return_inverse=True)[1] if labels is None else labels[here]
                    links = link_bucket(fps[here], own[here], known, radius)
                    if links:
                        yield batch_of(np.array(links, dtype=np.uint64).T)

    return run


def _dealt(rows: DataFrame, width: int, radius: int) -> DataFrame:
    return rows.repartition(width, "key").sortWithinPartitions("key").mapInArrow(_link(radius), "u long, v long")


def linked_prints(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, choices: tuple[int, ...] = PARTS) -> DataFrame:
    """(node, component) of every distinct fingerprint `fp` that is linked and is not its component's least.

    A bucket above `bucket` members is cut into blocks by a hash; members whose components then still
    differ from the bucket's largest are compared, block by block, with all of its members.
    """
    width = shared.shuffle_width(prints.sparkSession)
    plan = search_plan(prints, radius, choices)
    if not plan:
        return prints.select(F.col("fp").alias("node"), F.col("fp").alias("component")).limit(0)
    rows = bucket_rows(prints, plan)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("own").cast("long")).alias("owners"))
    large = shared.stored(sizes.where(F.col("n") > bucket).select("key", "n"), "pigeonhole-large")
    if large.isEmpty():
        return components(_dealt(rows, width, radius))
    dealt = rows.join(large, "key", "left").withColumn("part", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / bucket).cast("long")))
    dealt = dealt.select(F.when(F.col("n").isNull(), F.col("key")).otherwise(F.xxhash64("key", "part")).alias("key"), "fp", "own")
    known = components(_dealt(dealt, width, radius))
    inside = rows.join(large, "key").join(known, F.col("fp") == F.col("node"), "left").select("key", "n", "fp", "own", F.coalesce("component", "fp").alias("label"))
    inside = shared.stored(inside, "pigeonhole-inside")
    by_label = inside.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    split = by_label.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.count(F.lit(1)).alias("labels"), F.max("m").alias("most")).where("labels > 1")
    inside = inside.join(split, "key").withColumn("odd", F.col("label") != F.col("main"))
    # odd members meet all members on a grid: odd block x block of the bucket
    inside = inside.withColumn("nb", F.ceil(F.col("n") / bucket).cast("long")).withColumn("no", F.ceil((F.col("n") - F.col("most")) / bucket).cast("long"))
    line = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    place = lambda count: F.pmod(F.xxhash64("fp"), F.col(count))
    all_rows = inside.withColumn("b", place("nb")).withColumn("o", line("no"))
    odd_rows = inside.where("odd").withColumn("o", place("no")).withColumn("b", line("nb"))
    grid = all_rows.unionByName(odd_rows).groupBy(F.xxhash64("key", "o", "b").alias("key"), "fp", "label").agg(F.max("own").alias("own"))
    more = _dealt(grid, width, radius)
    return components(known.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS,
                    bucket: int = BUCKET) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (the smallest id reachable over
    fingerprints at most `radius` bits apart, itself included).

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer words than a shingle is one
    shingle; null, empty and blank texts have fingerprint zero, which links like any other.  Equal
    fingerprints are one node.  Rows that repeat an id are returned each with the component of their own
    fingerprint.  A row without an id links others like any row; its component_id is the smallest id
    reachable, null where no row reachable has an id.  An empty table gives no rows.  Other columns are
    not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = shared.stored(base.mapInArrow(_fingerprint(shingle, seed), "id long, fp long"), "pigeonhole")
    prints = shared.stored(base.groupBy("fp").agg(F.min("id").alias("least")), "pigeonhole-prints")
    found = linked_prints(prints.select("fp"), radius, bucket)
    named = prints.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = named.join(least, "component").select(F.col("fp").alias("of"), "component_id")
    out = base.join(by_print, F.col("fp") == F.col("of"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
