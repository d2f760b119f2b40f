import random
import re
from collections import Counter

import pytest

from reviewlake.llm import collocations
from reviewlake.llm.queries import QUERIES

from . import helpers
from .helpers import SF, edge_docs, empty_docs, lower

_PIECE, _WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def brute_force(docs, longest=4, least=30, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase."""
    counts, total = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for piece in _PIECE.split(lower(text)):
            w = _WORD.findall(piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                f.update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {q[i:i + m] for q, b in found.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * b >= 80 * f[q[i:i + m]]}
        rows = []
        for p, a in found.items():
            if p not in covered:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def result(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_query_against_brute_force(spark):
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_force(docs)
    assert want and result(QUERIES["op13_rollup_collocations"](spark, SF)) == want


@pytest.mark.parametrize("longest,least,top", [(4, 6, 2000), (4, 3, 15), (2, 2, 50), (3, 5, 40), (5, 4, 60)])
def test_dense_texts(spark, longest, least, top):
    rng = random.Random(longest * least)
    words = ["of", "the", "New", "york", "é", "É", "日本", "x\x01y", "a-b", "'s", "\xa0"]
    docs = []
    for k in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ". ", "\n", ",", " ;", "?"]) for _ in range(rng.randrange(60)))
        docs.append((rng.choice(["en", "en", "de", None, "und"]), text if k % 9 else None))
    docs += [("en", "new york of the new york")] * 7
    df = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    got = result(collocations.collocations(df, longest=longest, least=least, top=top))
    assert got == brute_force(docs, longest, least, top) and got


def test_one_pair_everywhere(spark):
    """A hot pair with ever new neighbours."""
    docs = [("en", " ".join(f"of the w{i}x{k}" for k in range(40))) for i in range(50)]
    got = result(collocations.collocations(spark.createDataFrame(docs, "lang string, text string")))
    assert got == brute_force(docs) == [("en", 1, "of the", 2000, 2000, 2000, 6000, 1_000_000)]


@pytest.mark.parametrize("coded_words,hot_share", [(3, 0.0), (1 << 17, 0.02), (0, 1.0)])
def test_codes_and_hot_pairs(spark, coded_words, hot_share, monkeypatch):
    """Few codes, every pair hot, small chunks, words with control characters and marks: the same counts."""
    monkeypatch.setattr(collocations, "_CHUNK", 50)
    rng = random.Random(5)
    words = ["a", "b", "=c", "~d", "e\x01f", "g=", "\x02", "h" * 300, "é~"]
    docs = [(rng.choice(["en", "l n", None, "=x", ""]), " ".join(rng.choices(words, [30, 20, 9, 9, 9, 5, 5, 5, 5], k=200))) for _ in range(40)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    got = {(r.lang, r.phrase): r.f for r in collocations.phrase_counts(df, least=4, coded_words=coded_words, hot_share=hot_share).collect()}
    want = {}
    for lang, text in docs:
        w = _WORD.findall(text)
        f = want.setdefault("und" if lang is None else lang, Counter())
        f[""] += len(w)
        for m in range(1, 5):
            f.update(" ".join(w[i:i + m]) for i in range(len(w) - m + 1))
    assert got == {(k, p): n for k, f in want.items() for p, n in f.items() if n >= 4}


def test_few_files_from_a_wide_shuffle(spark, monkeypatch):
    """Stored tables have few files, not one for each shuffle partition, and the same rows."""
    rng = random.Random(9)
    docs = [("en", " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("xyz") for _ in range(400))) for _ in range(40)]
    files, stored = {}, collocations.shared.stored

    def counted(df, name):
        out = stored(df, name)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(collocations.shared, "stored", counted)
    wide = {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wide}
    try:
        for k, v in wide.items():
            spark.conf.set(k, v)
        got = result(collocations.collocations(spark.createDataFrame(docs, "lang string, text string"), least=2))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute_force(docs, least=2) and got
    most = max(spark.sparkContext.defaultParallelism, 100 // 16)
    assert set(files) == {"frequent-words", "collocations"} and max(files.values()) <= most, files


def test_edges(spark):
    docs = [(r.lang, r.text) for r in edge_docs(spark).collect()]
    assert result(collocations.collocations(edge_docs(spark), least=2)) == brute_force(docs, least=2)
    assert collocations.collocations(empty_docs(spark)).collect() == []
    assert sum(len(t or "") for _, t in helpers.EDGE_TEXTS) > 300_000  # with long texts
