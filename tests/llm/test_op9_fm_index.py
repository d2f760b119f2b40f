import random

import numpy as np
import pyarrow as pa

from reviewlake.llm import fm_index as fm, textbytes as tb
from reviewlake.llm.queries import QUERIES

from .helpers import SF, edge_docs, empty_docs, hits, rows_by, texts_of


def _matches(docs, bench, width, limit):
    phrases, out = fm.Phrases(bench, width), []
    for first, end, data, offsets in tb.text_slices(pa.array(docs, pa.string()), limit):
        words, hit, pairs, _ = fm.shard_matches(data, offsets, phrases)
        items = [[] for _ in range(end - first)]
        for d, i in pairs.tolist():
            items[d].append(i)
        out += [(int(w), int(h), sorted(i)) for w, h, i in zip(words, hit, items)]
    return out


def test_random_texts_against_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        words = ["a", "b", "c", "Da", "é"][:rng.randint(1, 5)] + [f"zz{k}" for k in range(rng.choice([0, 3, 50]))]
        make = lambda most: rng.choice([" ", ", "]).join(rng.choice(words) for _ in range(rng.randint(0, most)))
        bench = [(rng.choice([*range(10), None]), rng.choice([make(12), make(3), None, make(30)])) for _ in range(rng.randint(0, 6))]
        docs = [rng.choice([make(40), make(5), None, "", (bench[0][1] or "") if bench else ""]) for _ in range(rng.randint(1, 12))]
        docs += docs[:3]
        width = rng.choice([2, 3, 10])
        assert _matches(docs, bench, width, rng.choice([20, 100, 1 << 20])) == hits(docs, bench, width)


def test_index_against_naive_search():
    rng = random.Random(8)
    for _ in range(60):
        t = np.array([rng.randint(0, 3) for _ in range(rng.randint(1, 60))] + [0])
        index = fm.FMIndex(t, 2)
        order = fm.suffix_order(t, 2)
        naive = sorted(range(len(t)), key=lambda p: [(0, q) if t[q] == 0 else (int(t[q]), -1) for q in range(p, len(t))])
        assert order.tolist() == naive
        assert index.locate(np.arange(len(t))).tolist() == naive


def test_query_against_brute_force(spark):
    texts = texts_of(spark)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = rows_by(QUERIES["op9_benchmark_decontamination"](spark, SF))
    want = hits(list(texts.values()), bench)
    assert {i: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for i, r in rows.items()} == {
        i: (w, h, len(items), fm.items_digest(items), h > 0) for i, (w, h, items) in zip(texts, want)}
    assert any(r.contaminated for r in rows.values())


def test_benchmarks_above_one_block(spark):
    texts = list(texts_of(spark).values())[:60]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.createDataFrame([(k, (t or "") + " " + bench[k % 7][1]) for k, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    one = sorted(map(tuple, fm.contamination_report(docs, items).collect()))
    many = sorted(map(tuple, fm.contamination_report(docs, items, block_bytes=1500).collect()))
    assert one == many
    cut = lambda **o: {r.doc_id: r.text for r in fm.decontaminate(docs, items, **o).collect()}
    assert cut() == cut(block_bytes=1500)


def test_blocks_keep_rows_with_null_and_repeated_ids(spark):
    passages = [f"p{k} q{k} rr{k} s{k} t{k} u{k} v{k} é{k} x{k} y{k} z{k}" for k in range(40)]
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    more = [(None, f"ü {passages[0]} end"), (None, f"{passages[1]}"), (7, f"ééé {passages[2]}, {passages[3]} after"), (7, f"x {passages[4]}"), (7, "nothing é here"), (7, None)]
    extra = spark.createDataFrame([(i, t, *[None] * (len(edge_docs(spark).columns) - 2)) for i, t in more], edge_docs(spark).schema)
    docs = edge_docs(spark).unionByName(extra)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    one = rows(fm.contamination_report(docs, items))
    assert len(one) == docs.count() and sum(r[-1] for r in one) == 4
    assert rows(fm.contamination_report(docs, items, block_bytes=300)) == one
    assert rows(fm.benchmark_matches(docs, items, block_bytes=300)) == rows(fm.benchmark_matches(docs, items))
    assert rows(fm.decontaminate(docs, items, block_bytes=300)) == rows(fm.decontaminate(docs, items))


def test_spans_are_cut_out(spark):
    passage = "One two, three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"Before it. {passage} eleven. After it.", "x"), (2, "clean  text stays", "y"), (3, passage.upper() + "!", "z"), (4, None, "n"), (5, "...", "p"), (6, "with no id five: cut", "q")],
                                 "doc_id long, text string, c0 string")
    bench = spark.createDataFrame([(1, passage), (2, None), (None, "no id five")], "item_id long, text string")
    out = {r.doc_id: (r.text, r.c0) for r in fm.decontaminate(docs, bench).collect()}
    assert out == {1: ("Before it. eleven. After it.", "x"), 2: ("clean  text stays", "y"), 4: (None, "n"), 5: ("...", "p"), 6: ("with: cut", "q")}
    report = {r.doc_id: r for r in fm.contamination_report(docs, bench).collect()}
    assert (report[6].n_hit, report[6].n_items, report[6].contaminated) == (3, 0, True) and report[6].items_sha256 == fm.items_digest([])


def test_edges(spark):
    bench = spark.createDataFrame([(1, "two three"), (1, "two three"), (7, ""), (8, None), (9, "a b c d e f g h i j k l")], "item_id long, text string")
    rows = fm.contamination_report(edge_docs(spark), bench).collect()
    assert len(rows) == edge_docs(spark).count()
    assert sorted((r.doc_id, r.n_hit, r.n_items) for r in rows if r.contaminated) == [(2, 2, 1), (2, 2, 1)]
    assert {r.items_sha256 for r in rows if not r.contaminated} == {fm.items_digest([])}
    assert fm.contamination_report(empty_docs(spark), bench).collect() == []
    assert not any(r.contaminated for r in fm.contamination_report(edge_docs(spark), bench.limit(0)).collect())
    out = fm.decontaminate(edge_docs(spark), bench)
    assert out.columns == edge_docs(spark).columns and out.count() == edge_docs(spark).count()
    assert fm.decontaminate(empty_docs(spark), bench).collect() == []
