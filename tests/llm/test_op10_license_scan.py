import random

import pyarrow as pa

from reviewlake.llm import license_scan as ls, textbytes as tb
from reviewlake.llm.queries import QUERIES

from .helpers import ALNUM, SF, edge_docs, empty_docs, lower, rows_by, texts_of


def _shingles(text):
    w = ALNUM.findall(lower(text))
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]


OWN = [(name, set(_shingles(t))) for name, texts in ls.TEMPLATES.items() for t in texts]


def brute_force(text):
    """Licences with a window that holds 0.8 of a template's shingles, trying every window."""
    found, s = set(), _shingles(text)
    for name, own in OWN:
        width = 1 << len(own).bit_length()
        width += width // 4
        for i in (i for i, x in enumerate(s) if x in own):
            if len(own.intersection(s[i:i + width])) >= 0.8 * len(own):
                found.add(name)
                break
    return found


def _found(texts, limit=1 << 19):
    known, out = ls.Templates(ls.TEMPLATES, ls.BANDS, ls.CONTAINED), []
    for first, end, data, offsets in tb.text_slices(pa.array(texts, pa.string()), limit):
        _, matches = ls.scan(data, offsets, known)
        names = [set() for _ in range(end - first)]
        for m in matches:
            names[m[0]].add(m[1])
        out += names
    return out


def test_altered_notices_against_brute_force():
    rng = random.Random(5)
    words, notices = ["lorem", "ipsum", "the", "license", "under", "this"], [t for texts in ls.TEMPLATES.values() for t in texts]
    pad = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))
    texts = []
    for _ in range(800):
        x = rng.choice(notices).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            x[rng.randrange(len(x))] = rng.choice(words)
        texts.append(rng.choice([f"{pad()} {' '.join(x)} {pad()}", " ".join(x), pad(), None, "", f"{pad()} {rng.choice(notices)} {rng.choice(notices)}"]))
    want = [brute_force(t) for t in texts]
    assert _found(texts) == _found(texts, 300) == want and sum(map(len, want)) > 300


def test_query_against_brute_force(spark):
    texts = texts_of(spark)
    rows = rows_by(QUERIES["op10_license_scan"](spark, SF))
    assert {i: set(filter(None, r.licenses.split(","))) for i, r in rows.items()} == {i: brute_force(t) for i, t in texts.items()}
    for i, r in rows.items():
        assert r.n_words == len(ALNUM.findall(lower(texts[i]))) and (r.n_matches > 0) == (r.best >= 0.8) == bool(r.licenses)


def test_spans(spark):
    notice = "Released under the MIT License."
    docs = spark.createDataFrame([(1, f"a b {notice} c"), (2, f"{notice} x y z {notice}")], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in ls.license_report(docs).collect()} == {1: "mit:2:7", 2: "mit:0:5,mit:8:13"}


def test_sibling_notices(spark):
    free = ("This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by "
            "the Free Software Foundation; either version {} of the License, or (at your option) any later version.").format
    notices = {"gpl-2.0": free("program", "", "2"), "gpl-3.0": free("program", "", "3"), "lgpl-2.1": free("library", "Lesser ", "2.1"),
               "lgpl-3.0": free("program", "Lesser ", "3"), "agpl-3.0": free("program", "Affero ", "3")}
    for name, kind in {"cc-by-4.0": "Attribution", "cc-by-sa-4.0": "Attribution-ShareAlike", "cc-by-nc-4.0": "Attribution-NonCommercial"}.items():
        notices[name] = f"This work is licensed under a Creative Commons {kind} 4.0 International License."
    docs = spark.createDataFrame([(k, f"Some words before. {t} And after.") for k, t in enumerate(notices.values())], "doc_id long, text string")
    assert [r.licenses for r in ls.license_report(docs).orderBy("doc_id").collect()] == list(notices)


def test_edges(spark):
    rows = ls.license_report(edge_docs(spark)).collect()
    assert len(rows) == edge_docs(spark).count() and {(r.n_matches, r.licenses, r.best, r.spans) for r in rows} == {(0, "", 0.0, "")}
    assert ls.license_report(empty_docs(spark)).collect() == []
