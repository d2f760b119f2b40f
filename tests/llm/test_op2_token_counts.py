import random

import public_tokenizers
from tokenizers import Tokenizer

from reviewlake.llm import fst_tokens
from reviewlake.llm.queries import QUERIES

from .helpers import SF, edge_docs, empty_docs, rows_by, texts_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _library(texts):
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_query_against_the_library(spark):
    texts = texts_of(spark)
    rows = rows_by(QUERIES["op2_token_counts"](spark, SF))
    for i, n in zip(texts, _library(texts.values())):
        size = len((texts[i] or "").encode())
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (size, n, n > 512)


def test_counts_of_awkward_texts():
    rng = random.Random(3)
    texts = ["", "it's we're 've 'll 'l 'r ''s !'s  's \n's", " \n\n x \t y   ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "a" * 5000, "  " * 300 + "x", "\0a\0\0b", "😀 👨‍👩‍👧", " '", "'reé 'vE"]
    texts += ["".join(rng.choice("ab 'srtvelmd\n\t 1é.!日 ") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    assert fst_tokens.token_counts(texts, PATH).tolist() == _library(texts)


def test_counts_stay_right_when_compiled_states_are_dropped(monkeypatch):
    monkeypatch.setattr(fst_tokens, "MAX_STATES", 50)
    monkeypatch.setattr(fst_tokens, "MAX_KNOWN", 5)
    fst_tokens.transducer.cache_clear()
    texts = ["The quick brown foxes jumped over unbelievable dogs"] * 2 + ["antidisestablishmentarianism, naturally"]
    assert fst_tokens.token_counts(texts, PATH).tolist() == _library(texts)
    fst_tokens.transducer.cache_clear()


def test_edges(spark):
    rows = fst_tokens.token_count_report(edge_docs(spark), PATH).collect()
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows)
    docs = [(r.doc_id, r.text) for r in edge_docs(spark).collect()]
    assert got == sorted((i is not None, i or 0, len((t or "").encode()), n) for (i, t), n in zip(docs, _library([t for _, t in docs])))
    assert fst_tokens.token_count_report(empty_docs(spark), PATH).collect() == []
