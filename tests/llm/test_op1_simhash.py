import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from reviewlake.llm import simhash
from reviewlake.llm.queries import QUERIES

from .helpers import SF, edge_docs, empty_docs, rows_by, texts_of


def _bits(a: str, b: str) -> int:
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def _check(rows, ordered):
    """Against edited texts and fingerprints made one by one; `ordered`: (id, text) in order."""
    for k, (i, text) in enumerate(ordered):
        text, following = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        edited = text[:len(text) - len(text) // 2] + following[:len(text) // 2]
        fp, fe, fn = (x.hex() for x in simhash.fingerprints(pa.array([text, edited, following])))
        want = (len(text), hashlib.sha256(edited.encode()).hexdigest(), fp, fe, 1 - _bits(fp, fe) / 128, 1 - _bits(fp, fn) / 128)
        assert want in [tuple(r)[1:7] for r in rows if r.doc_id == i], i


def test_query_against_brute_force(spark):
    texts = texts_of(spark)
    rows = QUERIES["op1_simhash"](spark, SF).collect()
    assert len(rows) == len(texts)
    _check(rows, sorted(texts.items()))
    prints = {r.fingerprint for r in rows}
    for r in rows:
        assert r.n_near == sum(0 < _bits(r.fingerprint, p) <= 3 for p in prints)


def test_edges(spark):
    rows = simhash.fingerprint_report(edge_docs(spark)).collect()
    ordered = sorted(((r.doc_id, r.text or "") for r in edge_docs(spark).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(rows) == len(ordered)
    _check(rows, ordered)
    assert {r.fingerprint for r in rows if r.n_chars == 0} == {"0" * 32}
    assert simhash.fingerprint_report(empty_docs(spark)).collect() == []
    lone = simhash.fingerprint_report(edge_docs(spark).where("doc_id = 9")).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0


def test_block_tables_find_all_pairs_within_the_radius(spark):
    import random

    rng = random.Random(2)
    base = [rng.getrandbits(128) for _ in range(20)]
    prints = {f"{b:032x}" for b in base}
    for b in base:
        for n in (1, 2, 3, 4, 5):
            x = b
            for k in rng.sample(range(128), n):
                x ^= 1 << k
            prints.add(f"{x:032x}")
    df = spark.createDataFrame([(p,) for p in sorted(prints)] * 2 + [(None,)], "fingerprint string")
    want = {(a, b, _bits(a, b)) for a in prints for b in prints if a < b and _bits(a, b) <= 3}
    for blocks in (None, 5, 6):
        got = simhash.near_fingerprints(df, radius=3, blocks=blocks).collect()
        assert {(r.a, r.b, r.distance) for r in got} == want and len(got) == len(want) > 0
    assert simhash.near_fingerprints(df.where(F.lit(False))).collect() == []


def test_edited_texts_are_nearer_than_other_texts(spark):
    rows = rows_by(QUERIES["op1_simhash"](spark, SF))
    assert sum(r.near_edited > r.near_next for r in rows.values()) > 0.95 * len(rows)
