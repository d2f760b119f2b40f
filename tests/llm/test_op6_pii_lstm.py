import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from reviewlake.llm import pii_lstm as pii
from reviewlake.llm.queries import QUERIES

from .helpers import SF, edge_docs, empty_docs, rows_by, texts_of

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0


def brute_force(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")), "card": lambda: 16 <= len(d) <= 19 and _luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def _digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_base_spans_are_the_patterns_matches():
    rng = random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choice("ab@@..-+ 0123459()%é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_force(text)


def test_query_keeps_base_spans(spark):
    texts = texts_of(spark)
    rows = rows_by(QUERIES["op6_pii_bilstm_crf"](spark, SF))
    assert set(rows) == set(texts)
    for i, r in rows.items():
        base = brute_force(texts[i] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in PATTERNS]
        assert r.base_sha256 == _digest(base)
        every = [s for s in r.spans.split(",") if s]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(every) and len(every) == len(base) + r.n_added


def test_gradients_against_differences():
    model = pii.Tagger.fresh(1)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    symbols, mask = pii._padded([np.array([1, 2, 3, 4, 5]), np.array([6, 7, 1])])
    gold = pii._padded([np.array([0, 1, 2, 0, 3]), np.array([1, 2, 0])])[0]
    _, grads = model.gradients(symbols, mask, gold)
    for name, w in model.weights.items():
        at = (2, 3) if w.ndim == 2 else (3,)
        was, step = w[at], 1e-4
        w[at] = was + step
        up = model.gradients(symbols, mask, gold)[0]
        w[at] = was - step
        down = model.gradients(symbols, mask, gold)[0]
        w[at] = was
        assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-4, name


def test_viterbi_and_partition_against_all_paths():
    model = pii.Tagger.fresh(2)
    model.weights["move"] = np.random.default_rng(3).normal(0, 1, (pii.TAGS, pii.TAGS)).astype(np.float32)
    piece = np.array([1, 2, 3])
    symbols, mask = pii._padded([piece])
    scores = model.emissions(symbols, mask)[0].astype(np.float64)
    move = model.weights["move"]
    paths = {p: sum(scores[k, 0, t] for k, t in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])) for p in itertools.product(range(pii.TAGS), repeat=3)}
    assert tuple(model.decode([piece])[0][0]) == max(paths, key=paths.get)
    assert abs(model.marginals(scores, mask)[0][0] - np.log(np.exp(list(paths.values())).sum())) < 1e-6


@pytest.mark.parametrize("seed", [1, 2, 7])
def test_model_finds_held_out_spans(spark, seed):
    texts = sorted(t for t in texts_of(spark, "/root/testdata/sf0.01").values() if t and re.search("[0-9@]", t))
    model = pii.fit(texts[::2], seed)
    rest = texts[1::2]
    base = [set(brute_force(t)) for t in rest]
    found = [set(x) for x in pii.added_spans(rest, [[] for _ in rest], model)]
    total = Counter(k for b in base for k, _, _ in b)
    right = Counter(k for a, b in zip(base, found) for k, _, _ in a & b)
    assert all(right[k] >= 0.85 * total[k] for k in pii.KINDS), (right, total)
    assert sum(map(len, found)) < 1.1 * sum(total.values())


def test_model_adds_spans_that_the_patterns_miss(spark):
    """Other writings than the patterns', labelled, in the places of held-out spans."""
    texts = sorted(t for t in texts_of(spark, "/root/testdata/sf0.01").values() if t and re.search("[0-9@]", t))
    model = pii.fit(texts[::2])
    writings = {"ip": ["10[.]20[.]30[.]4", "192[.]168[.]7[.]250"], "card": ["4111.1111.1111.1111", "5500.0000.0000.0004"], "phone": ["(319) 555-5132", "319-555-5132"], "email": ["bob @ mail7.example.com", "ann.lee @ host.org"]}
    cases = []
    for t in texts[1::2]:
        for kind, a, b in brute_force(t)[:1]:
            for other, forms in writings.items():
                cases += [(other, t[max(0, a - 80):a] + w + t[b:b + 80], (min(a, 80), min(a, 80) + len(w))) for w in forms]
    made = pii.all_spans([c[1] for c in cases], model)
    missed, added = Counter(), Counter()
    for (kind, _, place), base, every in zip(cases, *made):
        if not any(x < place[1] and place[0] < y for _, x, y in base):
            missed[kind] += 1
            added[kind] += (kind, *place) in every
    assert all(missed[k] for k in pii.KINDS) and sum(added.values()) > 0.6 * sum(missed.values()), (added, missed)


def test_sample_is_of_distinct_texts(spark, monkeypatch):
    """However often a text is repeated, it is drawn once; no table with personal data has an empty sample."""
    drawn = []
    monkeypatch.setattr(pii, "fit", lambda texts, *a: drawn.append(texts))
    rows = [(k % 3, f"call +1 (319) 555-51{k % 3}2 today") for k in range(6000)] + [(9, "no such thing"), (10, None)]
    pii.fit_on(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [len(d) for d in drawn] == [3]
    monkeypatch.setattr(pii, "SAMPLE_TEXTS", 2)
    pii.fit_on(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [len(d) for d in drawn] == [3, 2]
    assert pii.fit_on(spark.createDataFrame(rows[-2:], "doc_id long, text string")) is None


def test_probability_of_a_span_against_all_paths():
    model = pii.Tagger.fresh(4)
    model.weights["move"] = np.random.default_rng(3).normal(0, 2, (pii.TAGS, pii.TAGS)).astype(np.float32)
    piece = np.array([1, 8, 1, 6])
    symbols, mask = pii._padded([piece])
    scores, move = model.emissions(symbols, mask)[0].astype(np.float64), model.weights["move"]
    weight = {p: np.exp(sum(scores[k, 0, t] for k, t in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))) for p in itertools.product(range(pii.TAGS), repeat=4)}
    (tags, sure), = model.decode([piece])
    assert sure
    for (a, b), p in sure.items():
        inside = [w for q, w in weight.items() if list(q[a:b]) == list(tags[a:b]) and (b == 4 or q[b] != tags[a] + 1)]
        assert abs(p - sum(inside) / sum(weight.values())) < 1e-6


def test_windows_cover_zones():
    for size in (1, 63, 64, 65, 96, 97, 300):
        parts = pii.windows((10, 10 + size))
        assert parts[0][0] == 10 and parts[-1][1] == 10 + size
        assert all(b[0] < a[1] and a[1] - b[0] >= pii.WINDOW - pii.STRIDE for a, b in zip(parts, parts[1:]))


def test_edges(spark):
    docs = edge_docs(spark)
    rows = pii.pii_report(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert (by[6].n_email, by[6].n_ip, by[6].n_card, by[6].n_phone) == (1, 1, 1, 1)
    assert by[1].spans == "" and by[0].base_sha256 == _digest([])
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = out.where("doc_id = 6").first().text
    assert text == "Mail <EMAIL> or <PHONE>, <IP>, <CARD>."
    assert out.where("doc_id = 1").first().text is None and out.where("doc_id = 5").first().text == docs.where("doc_id = 5").first().text
    assert pii.pii_report(empty_docs(spark)).collect() == [] and pii.redact(empty_docs(spark)).collect() == []
