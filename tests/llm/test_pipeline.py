import corpus_pipeline
import public_tokenizers
import pytest

from reviewlake.llm import kneser_ney, pii_lstm

from . import helpers
from .helpers import SF, edge_docs, empty_docs, hits, shingles, texts_of
from .test_op6_pii_lstm import brute_force as personal
from .test_op7_bpe import library

STAGES = dict(corpus_pipeline.STAGES)


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "byte_bpe"] and corpus_pipeline.ORACLE_SQL is None


def test_run_against_brute_force(spark):
    texts = texts_of(spark)
    models = kneser_ney.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    rejected = dict(zip(texts, kneser_ney.predict([t or "" for t in texts.values()], models)[2]))
    texts = {i: t for i, t in texts.items() if not rejected[i]}
    group = helpers.components({i: shingles(t, 5) for i, t in texts.items()}, 80, 100)
    texts = {i: t for i, t in texts.items() if group[i] == i}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = dict(zip(texts, hits(list(texts.values()), bench)))
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(rows) == {i for i, (n, hit, _) in found.items() if hit == 0 or hit < n}
    own = library()
    decoded = {i: own.decode_bytes(r.token_ids).decode() for i, r in rows.items()}
    assert all(h == 0 for _, h, _ in hits(list(decoded.values()), bench))
    untouched = 0
    for i, text in decoded.items():
        assert not personal(text)
        assert len(text) == rows[i].n_chars and list(rows[i].token_ids) == own.encode_ordinary(text) and rows[i].n_tokens == len(rows[i].token_ids)
        if found[i][1] == 0 and not pii_lstm.zones(texts[i]):
            assert text == texts[i]
            untouched += 1
    assert untouched > 0.7 * len(rows)


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_edges(spark, name):
    docs = edge_docs(spark)
    out = STAGES[name](spark, docs, SF)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    kept = out.count()
    assert kept == {"language_id": kept, "near_dedup": docs.count() - 2, "decontamination": docs.count(), "pii": docs.count()}[name]
    assert STAGES[name](spark, empty_docs(spark), SF).collect() == []


def test_language_stage_drops_what_has_no_letter(spark):
    kept = {r.doc_id for r in STAGES["language_id"](spark, edge_docs(spark), SF).collect()}
    assert not kept & {0, 1, 4, 7, 10} and {2, 9} <= kept


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (3, None), (None, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in STAGES["near_dedup"](spark, docs, SF).collect()))) == ["(1, 'a b c d e f')", "(3, None)", "(None, 'a b c d e f')"]


def test_rows_of_one_id_go_by_their_own_text(spark):
    a, b = "a b c d e f", "g h i j k l"
    docs = spark.createDataFrame([(9, a, 1), (3, a, 2), (9, b, 3), (9, b, 4), (8, None, 5), (8, None, 6), (8, "", 7)], "doc_id long, text string, _gone int")
    out = STAGES["near_dedup"](spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(3, a), (8, ""), (9, b)]


def test_last_stage_edges(spark):
    out = STAGES["byte_bpe"](spark, edge_docs(spark), SF)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids"] and out.count() == edge_docs(spark).count()
    assert STAGES["byte_bpe"](spark, empty_docs(spark), SF).collect() == [] and public_tokenizers.PATTERN
