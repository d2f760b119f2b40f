"""Operator 4: language ID by interpolated Kneser-Ney character models.

One model for each language over letters (lower-cased) and word breaks, fitted on a bounded sample of
labelled texts.  The models of an order share one sorted array of n-gram hashes, with a column of log
probabilities for each language, and one of context hashes with back-off weights.  A text's language is
the one of the lowest cross-entropy per character; texts that no model explains are rejected by a limit
calibrated for each language and text length on labelled texts outside the fit.
"""
from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, textbytes as tb

ORDER = 4
#: The bound of the fit: labelled texts of each language, on average, and code points of each such text.
SAMPLE_TEXTS, SAMPLE_CHARS = 400, 20_000
#: Languages whose texts are on the driver at once and whose models share their arrays.
TOGETHER = 32
#: Text lengths in letters with a rejection limit of their own; the quantile of held-out texts, how many times its distance
#: from the median a limit lies above it, and the fewest texts of a limit.
LENGTHS, SHARE, REACH, LEAST = (1, 4, 8, 16, 32, 64, 128, 256, 512), 0.98, 5.0, 20
#: Symbols of a window.
WINDOW = 64
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BREAK = 0x20
_ROWS = 1024


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Lower-case letter of each code point, a break for what is no letter."""
    table = np.full(0x110000, _BREAK, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def symbols(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single breaks of each text behind `order` - 1 breaks, and the bounds of what counts.

    Returns (all symbols, bounds): text i counts from bounds[i] + order - 1 to bounds[i + 1].
    """
    joined = "".join(f"\0{t}" for t in texts)
    points = letter_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    is_break = points == _BREAK
    keep = ~is_break
    keep[1:] |= is_break[1:] & ~is_break[:-1]
    mark = first[:-1]
    keep[mark] = True  # one break before each text
    after = mark[(mark + 1 < first[1:])] + 1
    keep[after] &= ~is_break[after]
    counts = np.add.reduceat(keep, mark).astype(np.int64) if len(mark) else np.empty(0, dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum(counts + order - 2)))
    out = np.full(bounds[-1], _BREAK, dtype=np.uint64)
    kept = points[keep]
    out[np.arange(len(kept)) + np.repeat((order - 2) * np.arange(1, len(counts) + 1), counts)] = kept
    return out, bounds


def gram_hashes(symbols_: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the last 1 .. `order` symbols at every place (at index 0 .. order - 1)."""
    values = tb.mix64(symbols_ + np.uint64(1))
    out = [values]
    with np.errstate(over="ignore"):
        for _ in range(order - 1):
            longer = values.copy()
            longer[1:] += out[-1][:-1] * _MIX
            out.append(longer)
    return out


def _counted(bounds: np.ndarray, order: int) -> np.ndarray:
    """True at the symbols that count, false at the breaks put before each text."""
    counted = np.ones(bounds[-1], dtype=bool)
    counted[(bounds[:-1, None] + np.arange(order - 1)).ravel()] = False
    return counted


def _one_model(texts: list[str], order: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]], int]:
    """(n-gram hashes, log probabilities) and (context hashes, log back-off weights) by order, and the
    number of symbols."""
    all_symbols, bounds = symbols(texts, order)
    hashes = gram_hashes(all_symbols, order)
    at = np.flatnonzero(_counted(bounds, order))
    grams, first, counts = [None] * order, [None] * order, [None] * order
    for k in range(order):
        grams[k], where, raw = np.unique(hashes[k][at], return_index=True, return_counts=True)
        first[k] = at[where]
        counts[k] = raw
    for k in range(order - 1):  # lower orders count the symbols that may come before
        suffix = hashes[k][first[k + 1]]
        place = np.searchsorted(grams[k], suffix)
        counts[k] = np.bincount(place, minlength=len(grams[k]))
    size = len(grams[0])
    probability, contexts = [], []
    lower = np.full(size, 1.0 / (size + 1))
    for k in range(order):
        ones, twos = (counts[k] == 1).sum(), (counts[k] == 2).sum()
        discount = min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones else 0.5
        before = hashes[k - 1][first[k] - 1] if k else np.zeros(size, dtype=np.uint64)
        context, inverse = np.unique(before, return_inverse=True)
        total = np.bincount(inverse, weights=counts[k])
        kinds = np.bincount(inverse)
        total = np.maximum(total, 1)
        back = np.minimum(discount * kinds / total, 1.0)
        if k:
            lower = probability[k - 1][np.searchsorted(grams[k - 1], hashes[k - 1][first[k]])]
        probability.append(np.maximum(counts[k] - discount, 0) / total[inverse] + back[inverse] * lower)
        contexts.append((context, np.log(back)))
    return [(g, np.log(p)) for g, p in zip(grams, probability)], contexts, size


class _Block:
    """Sorted hash arrays of some languages' models."""

    def __init__(self, models: list, order: int):
        self.order = order
        self.grams, self.contexts = [], []
        for k in range(order):
            self.grams.append(_merged([m[0][k] for m in models], np.nan))
            self.contexts.append(_merged([m[1][k] for m in models], 0.0))
        self.unseen = np.array([-np.log(m[2] + 1.0) for m in models], dtype=np.float32)

    def log_probability(self, hashes: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """(places, languages): log probability of each symbol after the ones before it."""
        out = np.full((len(at), len(self.unseen)), np.nan, dtype=np.float32)
        back = np.zeros_like(out)
        rows = np.arange(len(at))
        for k in range(self.order - 1, -1, -1):
            keys, values = self.grams[k]
            found, place = _find(keys, hashes[k][at[rows]])
            got = np.full((len(rows), out.shape[1]), np.nan, dtype=np.float32)
            got[found] = values[place[found]]
            new = np.isnan(out[rows]) & ~np.isnan(got)
            out[rows] = np.where(new, back[rows] + got, out[rows])
            rows = rows[np.isnan(out[rows]).any(1)]
            if not len(rows):
                return out
            keys, values = self.contexts[k]
            before = hashes[k - 1][at[rows] - 1] if k else np.zeros(len(rows), dtype=np.uint64)
            found, place = _find(keys, before)
            back[rows[found]] += values[place[found]]
        out[rows] = np.where(np.isnan(out[rows]), back[rows] + self.unseen, out[rows])
        return out


class LanguageModels:
    """The models of all languages, in blocks of TOGETHER."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER):
        self.languages, self.order, self.blocks = [], order, []
        self.limits = np.empty((0, len(LENGTHS)))
        self.add(samples)

    def add(self, samples: dict[str, list[str]]) -> None:
        """Learn further languages."""
        names = sorted(samples)
        for k in range(0, len(names), TOGETHER):
            self.blocks.append(_Block([_one_model(samples[name], self.order) for name in names[k:k + TOGETHER]], self.order))
        self.languages += names
        self.limits = np.full((len(self.languages), len(LENGTHS)), np.inf)

    def log_probability(self, hashes: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """(places, languages): log probability of each symbol after the ones before it."""
        return np.concatenate([b.log_probability(hashes, at) for b in self.blocks], axis=1)

    def _scored(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, languages) log probabilities, 0 at breaks before a text, the bounds of the texts and their numbers of letters."""
        all_symbols, bounds = symbols(texts, self.order)
        hashes = gram_hashes(all_symbols, self.order)
        counted = _counted(bounds, self.order)
        at = np.flatnonzero(counted)
        _, first, inverse = np.unique(hashes[-1][at], return_index=True, return_inverse=True)
        each = np.zeros((len(all_symbols), len(self.languages)))
        each[at] = self.log_probability(hashes, at[first])[inverse]
        return each, bounds, tb.segment_sum((counted & (all_symbols != _BREAK)).astype(np.int64), bounds)

    def _mean(self, each: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return -tb.segment_sum(each, bounds) / np.maximum(np.diff(bounds) - (self.order - 1), 1)[:, None]

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) cross-entropy per symbol in nats, and the number of letters of each text."""
        each, bounds, letters = self._scored(texts)
        return self._mean(each, bounds), letters

    def explained(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`cross_entropy`, and what of each text is held to a limit: the median over its windows of about
        WINDOW symbols of the lowest cross-entropy, so that mixed texts and foreign passages pass.
        """
        each, bounds, letters = self._scored(texts)
        entropy = self._mean(each, bounds)
        held = entropy.min(1)
        n = np.diff(bounds) - (self.order - 1)
        some = np.flatnonzero(n > 0)
        if len(some):
            many = np.maximum(n[some] // WINDOW, 1)
            text, first = np.repeat(np.arange(len(some)), many), np.cumsum(many) - many
            k, size = np.arange(many.sum()) - first[text], n[some][text]
            starts = size * k // many[text]
            sums = np.add.reduceat(each, bounds[some][text] + self.order - 1 + starts, axis=0)
            mean = -sums.max(1) / (size * (k + 1) // many[text] - starts)
            mean = mean[np.lexsort((mean, text))]
            held[some] = (mean[first + (many - 1) // 2] + mean[first + many // 2]) / 2
        return entropy, letters, held

    def calibrate(self, texts: dict[str, list[str]], share: float = SHARE, reach: float = REACH, least: int = LEAST) -> None:
        """Set the rejection limit of each language and length in letters, from held-out labelled texts.

        Only texts that the models give their label count, so that mislabelled ones do not.  A limit lies
        `reach` times as far above the median cross-entropy as the `share` quantile; for the shorter
        lengths pieces of these texts are measured, for the longest the whole texts.  A language with
        fewer than `least` texts at a length takes the limit of the length below, and has none below the first.
        """
        for i, name in enumerate(self.languages):
            if not texts.get(name):
                continue
            entropy, letters = self.cross_entropy(texts[name])
            right = [t for t, e, n in zip(texts[name], entropy, letters) if n and e.argmin() == i]
            for j, length in enumerate(LENGTHS):
                self.limits[i, j] = self.limits[i, j - 1] if j else np.inf
                whole = j == len(LENGTHS) - 1
                pieces = right if whole else [p for t in right for p in _pieces(t, length)]
                if pieces:
                    _, letters, held = self.explained(pieces)
                    own = held[letters >= length] if whole else held
                    if len(own) >= least:
                        middle, high = np.quantile(own, [0.5, share])
                        self.limits[i, j] = middle + reach * (high - middle)
        # a shorter text is never held to less than a longer one
        self.limits = np.maximum.accumulate(self.limits[:, ::-1], axis=1)[:, ::-1]

    def limit(self, language: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The rejection limit of texts of `letters` letters, that of the measured length next below."""
        return self.limits[language, np.maximum(np.searchsorted(LENGTHS, letters, side="right") - 1, 0)]


def _pieces(text: str, letters: int, most: int = 4) -> list[str]:
    """Up to `most` pieces of about `letters` letters, evenly spread over the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.flatnonzero(letter_table()[points] != _BREAK)
    count = min(most, len(at) // letters)
    firsts = [k * (len(at) - letters) // max(1, count - 1) for k in range(count)]
    return [text[at[f]:at[f + letters - 1] + 1] for f in firsts]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]], absent: float) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(np.concatenate([k for k, _ in parts]))
    values = np.full((len(keys), len(parts)), absent, dtype=np.float32)
    for i, (k, v) in enumerate(parts):
        values[np.searchsorted(keys, k), i] = v
    return keys, values


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return (keys[place] == wanted) if len(keys) else np.zeros(len(wanted), dtype=bool), place


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER,
        texts_each: int = SAMPLE_TEXTS, chars_each: int = SAMPLE_CHARS, together: int = TOGETHER) -> LanguageModels | None:
    """Models of every language, from `texts_each` distinct texts of each with a letter (those of the smallest
    hashes, or all if there are fewer), at most the first `chars_each` code points of each, a fifth of them for
    calibration.  None without a labelled text.

    Null texts and null languages are left out; ids are not read.  The sample of `together` languages is on
    the driver at once.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    rows = rows.where(F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("text", F.lit("kneser-ney")).alias("h"), F.substring("text", 1, chars_each).alias("text"))
    smallest = Window.partitionBy("lang").orderBy("h")
    drawn = rows.select("lang", "h").distinct().withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= texts_each).select("lang", "h")
    chosen = rows.join(drawn, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    chosen = shared.stored(chosen.select("lang", "text", F.pmod(F.xxhash64("h"), F.lit(5)).alias("fold")), "language-sample")
    names = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())
    if not names:
        return None
    blocks = [names[k:k + together] for k in range(0, len(names), together)]
    letters = letter_table()
    has = lambda t: bool((letters[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)] != _BREAK).any())

    def sample(block: list[str], fold: bool) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
        fitted: dict[str, list[str]] = {}
        held: dict[str, list[str]] = {}
        part = chosen if len(blocks) == 1 else chosen.where(F.col("lang").isin(block))
        for r in sorted((part.where("fold = 0") if fold else part).collect(), key=lambda r: (r["lang"], r["fold"], r["text"])):
            (held if r["fold"] == 0 else fitted).setdefault(r["lang"], []).append(r["text"])
        for name in held:
            fitted.setdefault(name, held[name])  # so few texts that none was left for the fit
        return {k: v for k, v in ((k, [t for t in v if has(t)]) for k, v in fitted.items()) if v}, held

    models = None
    for block in blocks:
        fitted, held = sample(block, False)
        if fitted and models is None:
            models = LanguageModels(fitted, order)
        elif fitted:
            models.add(fitted)
    if models is None:
        return None
    for block in blocks:  # held to all models
        models.calibrate(held if len(blocks) == 1 else sample(block, True)[1])
    return models


def predict(texts: list[str], models: LanguageModels | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language or und, score, rejected) of each text.

    score: the language's share of exp(-cross-entropy times at most 64 symbols) among all languages.
    """
    if models is None or not texts:
        return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
    entropy, letters, held = models.explained(texts)
    best = entropy.argmin(1)
    lowest = entropy[np.arange(len(texts)), best]
    weight = np.exp(-(entropy - lowest[:, None]) * np.minimum(letters, 64)[:, None])
    none = letters == 0
    rejected = none | (held > models.limit(best, letters))
    names = ["und" if z else models.languages[b] for b, z in zip(best, none)]
    return names, np.where(none, 0.0, 1 / weight.sum(1)), rejected


def identify(docs: DataFrame, models: LanguageModels | None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """`docs` with the columns lang_pred (a learned language; und without a letter), score and rejected.

    Null and empty texts are und, score 0, rejected.  Columns named like the new ones are replaced; rows
    are independent and an empty table gives no rows.
    """
    new = ["lang_pred", "score", "rejected"]
    keep = [f for f in docs.schema if f.name.lower() not in new]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    held = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col)
            for first, end, _, _ in tb.text_slices(texts, 1 << 19):
                part = batch.slice(first, end - first)
                names, score, rejected = predict([t or "" for t in part.column(text_col).to_pylist()], held.value)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                                                 [*(f.name for f in keep), *new])

    return docs.select(*[F.col(f"`{f.name}`") for f in keep]).mapInArrow(run, f"{shape}, lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id"):
    """Rows kept from learning: crc32 of the id as text is 1 modulo 3 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row; learned from rows that are not held out."""
    models = fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return identify(rows, models).select("doc_id", "held_out", "lang_pred", "score", "rejected")
