"""Operator 1: SimHash document fingerprints and search by permuted block tables.

Terms are the words of a text (A-Z lower-cased, runs without ASCII white space).  A term votes with the
signs of its hash bits, weighted by its damped count and its length; the signs of the sums are the
fingerprint.  Pairs within a Hamming radius agree on at least `blocks - radius` of the blocks that a
fingerprint is cut into, so one table for each choice of that many blocks finds them all.
"""
from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, textbytes as tb

BITS = 128
_SLICE = 1 << 20
_ROWS = 1024


def _votes(hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sign bits of the weighted votes of each segment: (segments, 8) bytes."""
    raised = np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64)
    ups = tb.segment_sum(raised * weights[:, None], bounds)
    return np.packbits(2 * ups > tb.segment_sum(weights, bounds)[:, None], axis=1)


def fingerprints(texts: pa.Array, bits: int = BITS) -> list[bytes]:
    """Fingerprint of every text; all zero bits for a null, empty or blank one."""
    out: list[bytes] = []
    for first, end, data, offsets in tb.text_slices(texts, _SLICE):
        lowered = tb.LOWER[data]
        starts, ends, bounds = tb.word_spans(lowered, offsets, tb.NON_SPACE)
        words, lengths = tb.span_hashes(lowered, starts, ends), ends - starts
        terms, weights, sizes = [], [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            term, at, count = np.unique(words[a:b], return_index=True, return_counts=True)
            terms.append(term)
            weights.append(np.rint(4 * (1 + np.log2(count)) * np.minimum(lengths[a:b][at], 12)).astype(np.int32))
            sizes.append(len(term))
        flat, weight = np.concatenate(terms), np.concatenate(weights)
        spans = np.concatenate(([0], np.cumsum(sizes)))
        planes = [_votes(tb.mix64(flat + np.uint64(1 + k)), weight, spans) for k in range(bits // 64)]
        out += [r.tobytes() for r in np.concatenate(planes, axis=1)]
    return out


def likeness(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Share of equal bits of fingerprints, pair by pair."""
    if not a:
        return np.empty(0)
    x, y = (np.frombuffer(b"".join(v), dtype=np.uint8).reshape(len(v), -1) for v in (a, b))
    return 1 - np.bitwise_count(x ^ y).sum(1) / (8 * x.shape[1])


def _digest(bits: int):
    """Sorted (bucket, guest, id, text) rows -> the report's rows; each row's next one follows it."""

    def block(rows: list[tuple], out_type) -> pa.RecordBatch:
        """All rows but the last; guests give no row."""
        own = [(r, nxt) for r, nxt in zip(rows, rows[1:]) if not r[1]]
        texts = [r[3] for r, _ in own]
        following = [n[3] for _, n in own]
        edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(texts, following)]
        fp = fingerprints(pa.array(texts, pa.string()), bits)
        fp_edited = fingerprints(pa.array(edited, pa.string()), bits)
        fp_next = fingerprints(pa.array(following[-1:], pa.string()), bits)
        # the next row is mostly the next of `own`; a guest's text stands in at the end of a bucket
        nexts = []
        for k, (r, n) in enumerate(own):
            same = k + 1 < len(own) and own[k + 1][0] is n
            nexts.append(fp[k + 1] if same else fp_next[0] if k + 1 == len(own) else fingerprints(pa.array([n[3]], pa.string()), bits)[0])
        return pa.RecordBatch.from_arrays([
            pa.array([r[2] for r, _ in own], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array([x.hex() for x in fp], pa.string()), pa.array([x.hex() for x in fp_edited], pa.string()),
            pa.array(likeness(fp, fp_edited), pa.float64()), pa.array(likeness(fp, nexts), pa.float64()),
        ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS).to_pydict()
                rows = rest + list(zip(part["bucket"], part["guest"], part["id"], part["text"]))
                yield block(rows, None)
                rest = rows[-1:]

    return run


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, buckets_per_task: int = 4) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document's, in ascending id (after the last: the first; a lone document is its own next).
    near_* is the share of equal bits of two fingerprints.

    Null texts count as empty; null ids come first; rows that repeat an id follow each other by text.  An
    empty table gives no rows.  Other columns are not read.

    The order is made without a global sort: ids are dealt to buckets by their quantiles (one number for
    each bucket on the driver), each bucket is sorted in its task, and the first row of the next bucket is
    sent along as a guest.
    """
    spark = docs.sparkSession
    width = shared.shuffle_width(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = width * buckets_per_task
    cuts = sorted({int(x) for x in rows.select("id").approxQuantile("id", [k / n for k in range(1, n)], 0.25 / n)})
    edges = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")  # one literal, however many cuts
    bucket = F.size(F.filter(edges, lambda c: c <= F.col("id"))) if cuts else F.lit(0)
    rows = rows.withColumn("bucket", F.when(F.col("id").isNull(), F.lit(-1)).otherwise(bucket))
    firsts = [(r["bucket"], r["id"]) for r in rows.groupBy("bucket").agg(F.min("id").alias("id")).orderBy("bucket").collect()]
    guests = [(firsts[k - 1][0], b, i) for k, (b, i) in enumerate(firsts)]
    if not firsts:
        guests = [(0, 0, None)]
    to = spark.createDataFrame(guests, "to int, at int, first long")
    sent = (rows.join(F.broadcast(to), (F.col("bucket") == F.col("at")) & F.col("id").eqNullSafe(F.col("first")))
            .select("id", "text", F.col("to").alias("bucket"), F.lit(True).alias("guest")))
    dealt = (rows.withColumn("guest", F.lit(False)).unionByName(sent).select("bucket", "guest", "id", "text")
             .repartition(width, "bucket").sortWithinPartitions("bucket", "guest", F.col("id").asc_nulls_first(), "text"))
    return dealt.mapInArrow(_digest(bits), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def block_tables(bits: int, blocks: int, radius: int) -> list[list[int]]:
    """One mask for each table and 64-bit word: the bits of the blocks that a table's key takes."""
    edges = [round(k * bits / blocks) for k in range(blocks + 1)]
    tables = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        tables.append([(mask >> (64 * w)) & ((1 << 64) - 1) for w in range(bits // 64)])
    return tables


def near_fingerprints(prints: DataFrame, radius: int = 3, blocks: int | None = None, fingerprint_col: str = "fingerprint", bits: int = BITS) -> DataFrame:
    """Pairs (a, b, distance) of different fingerprints (hex) within `radius` bits, a < b, each once.

    Equal fingerprints are one: join back by fingerprint to name their documents.  `blocks` (radius + 1 by
    default and at least) sets how many tables there are and how long their keys: C(blocks, radius) tables
    with keys of `bits` * (blocks - radius) / blocks bits, which should well exceed the binary logarithm of
    the number of fingerprints.
    """
    blocks = radius + 1 if blocks is None else blocks
    words = bits // 64
    one = prints.select(F.col(fingerprint_col).alias("fp")).where("fp is not null").distinct()
    # words of 64 bits, the least first
    longs = [F.conv(F.substring("fp", 16 * (words - 1 - w) + 1, 16), 16, -10).cast("long").alias(f"w{w}") for w in range(words)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    tables = block_tables(bits, blocks, radius)
    cut = one.select(*longs)
    keys = [F.xxhash64(F.lit(t), *[F.col(f"w{w}").bitwiseAND(F.lit(signed(m)).cast("long")) for w, m in enumerate(masks)]) for t, masks in enumerate(tables)]
    keyed = cut.select(*cut.columns, F.explode(F.array(*keys)).alias("key"))
    a = keyed.select("key", *[F.col(f"w{w}").alias(f"a{w}") for w in range(words)])
    b = keyed.select("key", *[F.col(f"w{w}").alias(f"b{w}") for w in range(words)])
    apart = sum((F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in range(words)), F.lit(0))
    name = lambda side: F.lower(F.concat(*[F.lpad(F.hex(F.col(f"{side}{w}")), 16, "0") for w in range(words - 1, -1, -1)]))
    # longs order like this only within a sign: any total order will do to take each pair once
    first = F.struct(*[F.col(f"a{w}") for w in range(words)]) < F.struct(*[F.col(f"b{w}") for w in range(words)])
    pairs = a.join(b, "key").where(first & (apart <= radius)).select(name("a").alias("x"), name("b").alias("y"), apart.alias("distance"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance").distinct()


def near_counts(report: DataFrame, radius: int = 3, blocks: int | None = None, bits: int = BITS) -> DataFrame:
    """`report` with n_near: how many other fingerprints are within `radius` bits of each row's own."""
    pairs = near_fingerprints(report, radius, blocks, bits=bits)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("_fp")).groupBy("_fp").agg(F.count(F.lit(1)).alias("n_near"))
    return report.join(ends, F.col("fingerprint") == F.col("_fp"), "left").drop("_fp").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
