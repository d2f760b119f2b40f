import random

import numpy as np
import pyarrow as pa

from reviewlake.llm import textbytes as tb

from .helpers import ALNUM, NON_SPACE, lower


def _words(texts, table, limit):
    out = []
    for first, end, data, offsets in tb.text_slices(pa.array(texts, pa.string()), limit):
        lowered = tb.LOWER[data]
        starts, ends, bounds = tb.word_spans(lowered, offsets, table)
        raw = lowered.tobytes()
        for i in range(end - first):
            out.append([raw[a:b].decode() for a, b in zip(starts[bounds[i]:bounds[i + 1]], ends[bounds[i]:bounds[i + 1]])])
    return out


def test_words_as_the_patterns_give_them():
    rng = random.Random(1)
    texts = [None, "", "x"] + ["".join(rng.choice("aB9 .\t\né日-_") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    for limit in (1, 40, 1 << 20):
        assert _words(texts, tb.NON_SPACE, limit) == [NON_SPACE.findall(lower(t)) for t in texts]
        assert _words(texts, tb.ALNUM, limit) == [ALNUM.findall(lower(t)) for t in texts]


def test_span_hashes_are_equal_only_for_equal_words():
    data = np.frombuffer(b"abc abd abc ab ababab", dtype=np.uint8)
    starts, ends, _ = tb.word_spans(data, np.array([0, len(data)]), tb.NON_SPACE)
    h = tb.span_hashes(data, starts, ends)
    assert h[0] == h[2] and len(set(h.tolist())) == 4


def test_shingles_of_short_and_long_texts():
    words = np.array([5, 6, 7, 5, 6, 9], dtype=np.uint64)
    hashes, bounds = tb.shingle_hashes(words, np.array([0, 3, 3, 5, 6]), 3)
    assert bounds.tolist() == [0, 1, 1, 2, 3]
    assert len(set(hashes.tolist())) == 3
    again, _ = tb.shingle_hashes(np.array([1, 1, 5, 6], dtype=np.uint64), np.array([0, 2, 4]), 3)
    assert again[1] == hashes[1]
