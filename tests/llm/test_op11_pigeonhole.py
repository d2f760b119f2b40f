import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from reviewlake.llm import pigeonhole
from reviewlake.llm.queries import QUERIES

from . import helpers
from .helpers import NON_SPACE, SF, edge_docs, empty_docs, lower, rows_by, texts_of


def fingerprint(text):
    """The contract word by word."""
    w = NON_SPACE.findall(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < 4 else [" ".join(w[i:i + 4]) for i in range(len(w) - 3)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=4):
    """Smallest reachable fingerprint, comparing all pairs."""
    prints = sorted(set(prints))
    parent = {p: p for p in prints}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i, a in enumerate(prints):
        for b in prints[i + 1:]:
            if bin(a ^ b).count("1") <= radius:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {p: find(p) for p in prints}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def clouds(seed):
    """Lone fingerprints, and dense clouds around centres."""
    rng = random.Random(seed)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for centre, size in zip(prints[:20], [1, 2, 5, 60] * 5):
        for _ in range(size):
            x = centre
            for _ in range(rng.randrange(1, 7)):
                x ^= 1 << rng.randrange(64)
            prints.append(x)
    return sorted(set(prints))


def test_query_against_brute_force(spark):
    texts = texts_of(spark)
    rows = rows_by(QUERIES["op11_pigeonhole_simhash"](spark, SF))
    want = {i: fingerprint(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in rows.items()} == {i: f"{p:016x}" for i, p in want.items()}
    of = components(want.values())
    least = {}
    for i, p in want.items():
        least[of[p]] = min(i, least.get(of[p], i))
    assert {i: r.component_id for i, r in rows.items()} == {i: least[of[p]] for i, p in want.items()}
    assert len(least) < len(texts)


@pytest.mark.parametrize("bucket,choices", [(8192, (2,)), (8192, (3,)), (8192, (4,)), (8192, (5,)), (20, pigeonhole.PARTS)])
def test_components_of_clouds(spark, bucket, choices):
    prints = clouds(7)
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp long").checkpoint()
    plan = pigeonhole.search_plan(table, 4, choices)
    masks = [m for m, _ in plan]
    assert all(a & b == 0 for i, a in enumerate(masks) for b in masks[i + 1:])
    assert len(choices) > 1 or sum(t + 1 for _, t in plan) == 4 + 1  # the sum of all thresholds is radius - parts + 1
    found = {r.node: r.component for r in pigeonhole.linked_prints(table, 4, bucket, choices).collect()}
    groups = lambda of: {frozenset(x for x in of if of[x] == c) for c in of.values()}
    assert groups({signed(p): found.get(signed(p), signed(p)) for p in prints}) == groups({signed(p): signed(c) for p, c in components(prints).items()})


def test_allocation_is_the_cheapest():
    rng = random.Random(1)
    costs = [[0.0] + sorted(rng.random() * 100 for _ in range(5)) for _ in range(3)]
    want = min((costs[0][a + 1] + costs[1][b + 1] + costs[2][c + 1], [a, b, c]) for a in range(-1, 5) for b in range(-1, 5) for c in range(-1, 5) if a + b + c == 2)
    got = pigeonhole.allocate(costs, 2)
    assert got[1] == want[1] and abs(got[0] - want[0]) < 1e-9


def test_correlated_bits_share_a_group():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 62, 4000, dtype=np.uint64)
    fps = (fps & ~np.uint64(1 << 40)) | ((fps & np.uint64(1)) << np.uint64(40))  # bit 40 repeats bit 0
    bits = pigeonhole._bit_matrix(fps).astype(float)
    groups = pigeonhole.group_bits(pigeonhole.correlation((bits.T @ bits).astype(np.int64), len(fps)), 4)
    assert sorted(b for g in groups for b in g) == list(range(64)) and [len(g) for g in groups] == [16] * 4
    assert any(0 in g and 40 in g for g in groups)


def test_fingerprints_of_slices_and_long_texts():
    texts = [helpers.LONG * 5, None, "", "a b", "A\tB  c\nd e", "x " * 70_000, "é É\xa0z w v"]
    got = pigeonhole.shingle_prints(pa.array(texts, pa.string()))
    assert [int(g) for g in got] == [fingerprint(t) for t in texts]


def test_edges(spark):
    rows = pigeonhole.near_duplicates(edge_docs(spark)).collect()
    assert len(rows) == len(helpers.EDGE_TEXTS) and set(rows[0].asDict()) == {"doc_id", "fingerprint", "component_id"}
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all(by[i].fingerprint == "0" * 16 and by[i].component_id == 0 for i in (0, 1, 4, 10))
    # rows without an id: one with fingerprint zero, one that nothing else is like
    assert sorted(str(r.component_id) for r in rows if r.doc_id is None) == ["0", "None"]
    assert by[8].component_id == 3 and by[2].component_id == 2
    assert pigeonhole.near_duplicates(empty_docs(spark)).collect() == []


def test_a_row_without_id_links_others(spark):
    """1 and 2 differ in 8 bits; the row between them has no id."""
    table = spark.createDataFrame([(0,), (0b1111,), (0b11111111,)], "fp long").checkpoint()
    found = {r.node: r.component for r in pigeonhole.linked_prints(table).collect()}
    assert found == {0b1111: 0, 0b11111111: 0}
