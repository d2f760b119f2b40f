import random

from reviewlake.llm import lsh_forest
from reviewlake.llm.components import components
from reviewlake.llm.queries import QUERIES

from . import helpers
from .helpers import SF, edge_docs, empty_docs, rows_by, shingles, texts_of


def _against_brute_force(rows, texts, width, num, den):
    sets = {i: shingles(t, width) for i, t in texts.items()}
    want = helpers.components(sets, num, den)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in rows.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in texts}
    return want


def test_query_against_brute_force(spark):
    texts = texts_of(spark)
    want = _against_brute_force(rows_by(QUERIES["op3_minhash_near_dedup"](spark, SF)), texts, 3, 85, 100)
    assert len(set(want.values())) < len(texts)


def test_dense_groups_cut_at_deeper_prefixes(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(80)]
    texts = {}
    for i in range(120):
        words = list(base) if i < 90 else [f"c{rng.randrange(4)}" for _ in range(30)]
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            words[rng.randrange(len(words))] = f"n{rng.randrange(300)}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for weight in (1_000, 2_000_000):
        rows = rows_by(lsh_forest.near_duplicates(docs, shingle=3, num=85, den=100, region_weight=weight))
        _against_brute_force(rows, texts, 3, 85, 100)


def test_edges(spark):
    rows = lsh_forest.near_duplicates(edge_docs(spark)).collect()
    assert len(rows) == len(helpers.EDGE_TEXTS)
    by = {r.doc_id: r for r in rows}
    assert by[8].component_id == 3 and not by[8].kept and by[3].kept
    assert all(by[i].n_shingles == 0 and by[i].component_id == i and by[i].kept for i in (0, 1, 4, 10))
    assert [r.kept for r in rows if r.doc_id == 2] == [True, True]
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert lsh_forest.near_duplicates(empty_docs(spark)).collect() == []


def test_an_id_with_several_texts_has_one_component(spark):
    a, b, c = ("a b c d e f", "g h i j k l", "m n o p q r")
    rows = [(3, a), (9, a), (9, b), (7, b), (7, b), (20, c), (5, c), (5, None), (None, a), (30, "s t u v w x")]
    got = lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [
        (3, 3, True), (5, 5, True), (5, 5, True), (7, 3, False), (7, 3, False), (9, 3, False), (9, 3, False), (20, 5, False), (30, 30, True)]
    assert [(r.component_id, r.kept, r.n_shingles) for r in got if r.doc_id is None] == [(None, True, 2)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (119, 100), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 120)}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
