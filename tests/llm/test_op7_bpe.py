import base64
import hashlib
import random

import public_tokenizers
import tiktoken

from reviewlake.llm import bpe
from reviewlake.llm.queries import QUERIES

from .helpers import SF, edge_docs, empty_docs, rows_by, texts_of

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _digests(text, own):
    ids = own.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_against_the_library(spark):
    texts, own = texts_of(spark), library()
    rows = rows_by(QUERIES["op7_byte_bpe"](spark, SF))
    assert {i: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for i, r in rows.items()} == {i: _digests(t, own) for i, t in texts.items()}


def test_stitched_chunks_split_like_the_whole_text():
    rng, own = random.Random(2), library()
    for n in range(1500):
        text = "".join(rng.choice("ab 'srtvelmd\n\t 1é.!日") for _ in range(rng.randint(1, 120)))
        if n % 5 == 0:
            text = rng.choice("a 1\n") * rng.randint(1, 150) + text
        whole = bpe.pretoken_ends(text, PATTERN)
        for chunk, overlap in ((3, 2), (7, 5), (16, 8), (50, 20)):
            starts = list(range(0, len(text), chunk))
            assert bpe.stitch(text, starts, [bpe.pretoken_ends(text[a:a + chunk + overlap], PATTERN) for a in starts], PATTERN) == whole
        assert bpe.byte_pairs(PATH).encode(bpe._pieces(text, whole)) == own.encode_ordinary(text)


def test_chunked_rows_equal_whole_rows_and_decode_back(spark):
    docs = spark.createDataFrame([(1, "it's a  long\n\n text " * 40), (2, None), (3, ""), (4, "x" * 700), (4, "x" * 700)], "doc_id long, text string")
    whole = sorted(map(tuple, bpe.encode(docs, PATH, PATTERN).collect()), key=str)
    parts = bpe.encode(docs, PATH, PATTERN, chunk=50, overlap=7)
    assert sorted(map(tuple, parts.collect()), key=str) == whole
    for r in bpe.decode(parts, PATH).collect():
        assert bytes(r.decoded) == (r.text or "").encode()


def test_edges(spark):
    docs, own = edge_docs(spark), library()
    rows = bpe.encoding_report(docs, PATH, PATTERN).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, rows), key=key) == sorted(((r.doc_id, *_digests(r.text, own)) for r in docs.collect()), key=key)
    encoded = bpe.encode(docs, PATH, PATTERN)
    assert encoded.columns == [c for c in docs.columns if c != "token_ids"] + ["n_tokens", "token_ids"]
    assert bpe.encoding_report(empty_docs(spark), PATH, PATTERN).collect() == []
