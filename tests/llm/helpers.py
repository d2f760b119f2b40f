"""Brute-force versions and edge-case tables for the llm tests."""
from __future__ import annotations

import re

SF = "/root/testdata/sf0.001"
NON_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}

LONG = " ".join(f"w{(i * i) % 7919}x" for i in range(30_000))
#: Nulls, empty and long texts, repeated rows, and columns named like the operators' own.
EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, key int, score string, rejected string, n_hit int, spans int, token_ids string, bucket int, text_crc32 int, _gone long, _pred string"
EDGE_TEXTS = [
    (0, ""), (1, None), (None, "no name for this one"), (2, "one two three four"), (2, "one two three four"), (3, LONG),
    (4, " \t\n "), (5, "日本語 😀 naïve ½ it's"), (6, "Mail bob@mail7.example.com or +1 (319) 555-5132, 10.0.0.1, 4111 1111 1111 1111."), (7, "!!! ???"),
    (8, LONG + " end"), (9, "one"), (10, None), (11, "a" * 70_000), (None, None),
]


def lower(text: str | None) -> str:
    return (text or "").translate(_LOWER)


def edge_docs(spark):
    rows = [(i, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else "s", None, k, "r", k, "x", None, k, 1, None, k, 0, k, "zz") for k, (i, t) in enumerate(EDGE_TEXTS)]
    return spark.createDataFrame(rows, EDGE_SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


def texts_of(spark, sf: str = SF) -> dict[int, str | None]:
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def rows_by(df, key: str = "doc_id") -> dict:
    return {r[key]: r for r in df.collect()}


def components(sets: dict, num: int, den: int) -> dict:
    """Smallest reachable key of each, over links num / den of shingle sets, by comparing all pairs."""
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    keys = sorted(sets)
    for x, a in enumerate(keys):
        for b in keys[x + 1:]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) * den >= len(sets[a] | sets[b]) * num:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def shingles(text: str | None, width: int) -> frozenset:
    w = NON_SPACE.findall(lower(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < width else frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1))


def hits(docs: list, bench: list, width: int = 10) -> list:
    """(words, hit words, items) of each text, by comparing every window."""
    phrases: dict = {}
    for item, text in bench:
        w = ALNUM.findall(lower(text))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            phrases.setdefault(tuple(w[k:k + width]), set()).update([] if item is None else [item])
    out = []
    for text in docs:
        w, hit, items = ALNUM.findall(lower(text)), set(), set()
        for size in {len(p) for p in phrases}:
            for k in range(len(w) - size + 1):
                found = phrases.get(tuple(w[k:k + size]))
                if found is not None:
                    hit.update(range(k, k + size))
                    items |= found
        out.append((len(w), len(hit), sorted(items)))
    return out
