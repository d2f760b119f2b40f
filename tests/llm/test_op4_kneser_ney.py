import zlib

import numpy as np
from pyspark.sql import functions as F

from reviewlake.llm import kneser_ney as kn
from reviewlake.llm.queries import QUERIES

from .helpers import edge_docs, empty_docs

SF = "/root/testdata/sf0.01"


def test_query_accuracy_on_held_out_texts(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op4_kneser_ney"](spark, SF).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_probabilities_sum_to_one():
    texts = ["the cat sat on the mat and then it ate", "other thoughts on that matter"]
    model = kn.LanguageModels({"en": texts}, order=4)
    alphabet = sorted({chr(c) for c in kn.symbols(texts, 4)[0]})
    for context in ("the", "at o", "zzz"):
        total = 0.0
        for c in alphabet:
            s, _ = kn.symbols([context + (c if c != " " else " ")], 4)
            total += float(np.exp(model.log_probability(kn.gram_hashes(s, 4), np.array([len(s) - 1]))[0, 0]))
        rest = float(np.exp(model.log_probability(kn.gram_hashes(kn.symbols([context + "ж"], 4)[0], 4), np.array([len(kn.symbols([context + "ж"], 4)[0]) - 1]))[0, 0]))
        assert abs(total + rest - 1) < 1e-4


def test_prediction_ignores_neighbours_and_symbols_that_are_no_letters():
    model = kn.LanguageModels({"aa": ["abab abba baab"] * 5, "bb": ["cdcd dccd ddcc"] * 5})
    alone = [kn.predict([t], model)[0][0] for t in ("abba", "DCCD 12", "", "42 !")]
    assert alone == kn.predict(["abba", "DCCD 12", "", "42 !"], model)[0] == ["aa", "bb", "und", "und"]
    one, _ = model.cross_entropy(["abba"])
    many, _ = model.cross_entropy(["dd", "abba", ""])
    assert np.allclose(one[0], many[1])


def test_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    models = kn.fit(docs)
    odd = spark.createDataFrame([(1, "qzxkv wvzzq xkqjz zzxqw kkqxj qqzzx vvkxq zqxjk"), (2, "these are the words of that other nation"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.rejected for r in kn.identify(odd, models).collect()} == {1: True, 2: False, 3: True}
    assert kn.identify(docs, models).where("rejected").count() == 0


def test_texts_of_a_language_left_out_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(-1, "these words are of that other nation " * 40, "fr"), (-2, "qzxkv wvzzq xkqjz zzxqw kkqxj " * 40, "fr")], "doc_id long, text string, lang string")
    models = kn.fit(docs.where("lang <> 'es'").select("doc_id", "text", "lang").unionByName(junk))
    share = {r["lang"]: r["share"] for r in kn.identify(docs, models).groupBy("lang").agg(F.avg(F.col("rejected").cast("int")).alias("share")).collect()}
    assert share["es"] > 0.7 and max(share[k] for k in ("de", "en", "fr")) < 0.01


def test_mislabelled_held_out_texts_lift_no_limit():
    a, b = ["abab abba baab aabb " * 40] * 40, ["cdcd dccd ddcc cddc " * 40] * 40
    clean, dirty = (kn.LanguageModels({"aa": a[:10], "bb": b[:10]}) for _ in range(2))
    clean.calibrate({"aa": a, "bb": b})
    dirty.calibrate({"aa": a + b[:3], "bb": b})
    assert (clean.limits == dirty.limits).all() and np.isfinite(clean.limits).all()


def test_every_language_is_learned(spark):
    name = lambda k: f"l{k:03d}"
    texts = [(100 * k + n, " ".join(chr(0x4E00 + 8 * k + i % 8) * (1 + (i + n) % 3) for i in range(30)), name(k)) for k in range(300) for n in range(3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    models = kn.fit(docs)
    assert models.languages == [name(k) for k in range(300)]
    assert kn.identify(docs.where("doc_id % 100 = 0"), models).where("lang_pred <> lang or rejected").count() == 0


def test_blocks_of_languages_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, many = kn.fit(docs), kn.fit(docs, together=2)
    assert one.languages == many.languages and len(many.blocks) == 2 and np.array_equal(one.limits, many.limits)
    texts = [r.text for r in docs.where("text is not null").limit(50).collect()]
    assert np.array_equal(one.cross_entropy(texts)[0], many.cross_entropy(texts)[0])


def test_edges(spark):
    rows = kn.language_report(edge_docs(spark)).collect()
    assert len(rows) == edge_docs(spark).count()
    no_letter = {r.doc_id for r in rows if r.lang_pred == "und" and r.doc_id is not None}
    assert no_letter == {0, 1, 4, 7, 10}
    assert kn.language_report(empty_docs(spark)).collect() == []
    unlabelled = kn.language_report(edge_docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_sample_of_repeated_texts_and_null_ids(spark):
    """One text in thousands of rows, rows without an id, texts without a letter: every language is learned, no more texts than asked for."""
    rows = [(None, "the same words in all of them", "aa")] * 3200 + [(None, f"{chr(97 + i % 26)}{chr(97 + i % 7)} les mots {i}", "bb") for i in range(300)]
    rows += [(7, "42", "cc")] * 50 + [(7, "dernier mot", "cc"), (8, "123", "dd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = kn.fit(docs, texts_each=20)
    assert sorted(models.languages) == ["aa", "bb", "cc"]  # dd has no letter
    got = {r.lang: r.lang_pred for r in kn.identify(docs.dropDuplicates(["lang", "text"]), models).where("lang_pred <> 'und'").collect()}
    assert got == {"aa": "aa", "bb": "bb", "cc": "cc"}
    drawn = []
    was, kn.LanguageModels.__init__ = kn.LanguageModels.__init__, lambda self, texts, *a, **k: (drawn.append({n: len(t) for n, t in texts.items()}), was(self, texts, *a, **k))[1]
    try:
        kn.fit(docs, texts_each=20)
    finally:
        kn.LanguageModels.__init__ = was
    assert all(n <= 20 for d in drawn for n in d.values())
