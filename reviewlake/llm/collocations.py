"""Operator 13: phrase collocations by top-order marginalisation.

Only the longest windows are counted: every word with the words that lead it in its piece, padded at the
piece's end.  Spark's ROLLUP over the lead columns sums the windows of each shorter prefix, and a phrase's
count is that of the windows which begin with it.

Three things keep what is shuffled small without changing a result.  A window is padded from a word on that
a bitmap of the frequent words does not hold, since no phrase with that word can be a candidate.  The most
frequent words travel as short codes.  And the windows are dealt by language and first two words and sorted,
so that a window whose longer prefixes are too rare is padded in place before the ROLLUP; pairs of words so
frequent that their windows could outgrow a task are dealt by one word more.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, textbytes as tb

LONGEST, LEAST, TOP = 4, 30, 2000
SCORE, HELD, HELD_OF = 2_000_000, 80, 100
#: Hash positions of words (a bitmap of 16 MB, whatever the vocabulary).
POSITIONS = 1 << 27
#: Words and languages that travel as codes of one to three characters.  The others are spelled out after a mark,
#: those with a space or control character in hex after another: no token holds a character below "!".
CODED_WORDS, CODED_LANGS = 1 << 17, 1 << 10
_MARK, _HEX = "=", "~"
_SIGNS = [chr(c) for c in range(33, 127) if chr(c) not in (_MARK, _HEX)]
#: Rows that are padded together.
_CHUNK = 200_000
_SLICE = 1 << 21
_SEPARATOR = tb.byte_class((0x0A, 0x0D), *[(ord(c), ord(c)) for c in ".,;:!?"])
_WORD = ~(_SEPARATOR | tb.byte_class((0x20, 0x20), (0x09, 0x09)))


class _Slice:
    """The words of some texts: their codes in a dictionary of the slice, and their documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lowered = tb.LOWER[data]
        starts, ends, bounds = tb.word_spans(lowered, offsets, _WORD)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        at = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
        spelled = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(lowered[_WORD[lowered]])).dictionary_encode()
        self.words, self.code = spelled.dictionary, spelled.indices.to_numpy()
        before = np.concatenate(([0], np.cumsum(_SEPARATOR[lowered])))
        #: whether the next word is in the same piece
        self.led = np.zeros(len(starts), dtype=bool)
        self.led[:-1] = (before[starts[1:]] == before[ends[:-1]]) & (self.doc[1:] == self.doc[:-1])

    def positions(self, salts: np.ndarray) -> np.ndarray:
        """Hash position of each word, by the salts of the languages of the documents."""
        spans = np.frombuffer(self.words.buffers()[1], dtype=np.int32)[:len(self.words) + 1].astype(np.int64)
        hashes = tb.span_hashes(np.frombuffer(self.words.buffers()[2] or b"", dtype=np.uint8)[:spans[-1]], spans[:-1], spans[1:])
        with np.errstate(over="ignore"):
            return (tb.mix64(hashes[self.code] + salts[self.doc]) & np.uint64(POSITIONS - 1)).astype(np.int64)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, _Slice]]:
    """(languages, their salts, words) of the texts of a (lang, text) batch, about 2 MB each."""
    for first, end, data, offsets in tb.text_slices(batch.column(1), _SLICE):
        langs = batch.column(0).slice(first, end - first)
        coded = langs.dictionary_encode()
        names = b"".join(x.encode() for x in coded.dictionary.to_pylist())
        at = np.concatenate(([0], np.cumsum([len(x.encode()) for x in coded.dictionary.to_pylist()]))).astype(np.int64)
        salts = tb.span_hashes(np.frombuffer(names, dtype=np.uint8), at[:-1], at[1:])
        found = _Slice(data, offsets)
        if len(found.code):
            yield langs, salts[coded.indices.to_numpy()], found


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, word, n)."""
    for batch in batches:
        for langs, _, found in _slices(batch):
            words = pa.table({"lang": langs.take(pa.array(found.doc)), "word": found.words.take(pa.array(found.code))})
            yield from words.group_by(["lang", "word"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["lang", "word", "n"]).combine_chunks().to_batches()


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word) -> position."""
    for batch in batches:
        for _, salts, found in _slices(batch):
            yield pa.RecordBatch.from_arrays([pa.array(found.positions(salts))], ["position"])


def frequent_bits(words: DataFrame) -> np.ndarray:
    """Bitmap (POSITIONS / 8 bytes) of the hash positions of a (lang, word) table."""
    place = F.col("position") + 1
    rows = words.select("lang", "word").mapInArrow(_positions, "position long").groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(POSITIONS // 8, dtype=np.uint8)
    for r in rows.toLocalIterator():
        out[(r["b"] - 1) * 4096:r["b"] * 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def word_codes(n: int) -> list[str]:
    """The n shortest codes."""
    codes: list[str] = []
    longer = [""]
    while len(codes) < n:
        longer = [c + s for c in longer for s in _SIGNS]
        codes += longer
    return codes[:n]


def _tokens(words: pa.Array, known: pa.Array, codes: pa.Array) -> pa.Array:
    """The code of each word, or its spelling after a mark."""
    spelled = pc.binary_join_element_wise(_MARK, words, "")
    odd = pc.match_substring_regex(words, r"[\x00-\x20]")
    if pc.any(odd).as_py():
        spelled = pa.array([_HEX + w.encode().hex() if o else t for w, o, t in zip(words.to_pylist(), odd.to_pylist(), spelled.to_pylist())], pa.string())
    return pc.coalesce(codes.take(pc.index_in(words, value_set=known)), spelled)


def _spelling(token: str, words: dict[str, str]) -> str:
    return token[1:] if token.startswith(_MARK) else bytes.fromhex(token[1:]).decode() if token.startswith(_HEX) else words[token]


def _ahead(x: np.ndarray, k: int) -> np.ndarray:
    """What stands k places on; zero at the end."""
    out = np.zeros_like(x)
    out[:max(0, len(x) - k)] = x[k:]
    return out


def _windows(frequent, coded, longest: int):
    """(lang, text) -> (key, n): the longest windows, as the tokens of language and words joined by spaces; a padded
    window has fewer."""

    def leads(found: _Slice, salts: np.ndarray, tokens: pa.Array) -> list[pa.Array]:
        """The lead columns: null where the window is padded."""
        bits, position = frequent.value, found.positions(salts)
        common = (bits[position >> 3] >> (position & 7).astype(np.uint8)) & 1 == 1
        columns, alive = [], common
        for k in range(longest):
            if k:  # the word k places on, in the same piece and frequent
                alive = alive & _ahead(found.led, k - 1) & _ahead(common, k)
            columns.append(tokens.take(pa.array(_ahead(found.code, k), mask=~alive)))
        return columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs_known, words_known = (pa.array(x, pa.string()) for x in coded.value)
        lang_codes, codes = (pa.array(word_codes(len(x)), pa.string()) for x in (langs_known, words_known))
        for batch in batches:
            for langs, salts, found in _slices(batch):
                columns = leads(found, salts, _tokens(found.words, words_known, codes))
                lang = _tokens(langs, langs_known, lang_codes).take(pa.array(found.doc))
                key = pc.binary_join_element_wise(lang, *columns, " ", null_handling="skip")
                counted = pa.table({"key": key}).group_by("key", use_threads=False).aggregate([([], "count_all")])
                yield from counted.rename_columns(["key", "n"]).combine_chunks().to_batches(max_chunksize=50_000)

    return run


def _prefix_ends(data: np.ndarray, at: np.ndarray, levels: int) -> np.ndarray:
    """(levels, rows): where the first 1, 2, ... tokens of each row end; a row of fewer tokens ends with itself."""
    spaces = np.flatnonzero(data == 32)
    first = np.searchsorted(spaces, at[:-1])
    count = np.searchsorted(spaces, at[1:]) - first
    spaces = np.append(spaces, 0)
    return np.stack([np.where(count >= k, spaces[np.minimum(first + k - 1, len(spaces) - 1)], at[1:]) for k in range(1, levels + 1)])


def _common_prefix(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bytes each row has in common with the row before it; 0 for the first."""
    size = np.diff(at)
    out = np.zeros(len(size), dtype=np.int64)
    most = np.minimum(size[1:], size[:-1])
    left = np.arange(1, len(size))
    k = 0
    while len(left):
        left = left[most[left - 1] > k]
        left = left[data[at[left] + k] == data[at[left - 1] + k]]
        out[left] += 1
        k += 1
    return out


def padded(keys: pa.Array, n: np.ndarray, hot: np.ndarray, longest: int, least: int) -> tuple[list[pa.Array], list[np.ndarray]]:
    """Sorted windows -> (windows, counts): each cut to its longest prefix of two words or more that occurs `least` times
    in all rows, else (of a hot pair) to two words or to one; what is cut alike is one row."""
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    at = np.frombuffer(keys.buffers()[1], dtype=np.int32)[keys.offset:keys.offset + len(keys) + 1].astype(np.int64)
    data = np.frombuffer(keys.buffers()[2], dtype=np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    ends, same = _prefix_ends(data, at, longest + 1), _common_prefix(data, at)
    left, out_keys, out_n = n.astype(np.int64), [], []
    for words in range(longest, 0, -1):
        size = ends[words] - at[:-1]
        starts = np.flatnonzero(np.concatenate(([True], ~((size[1:] == size[:-1]) & (same[1:] >= size[1:])))))
        rest = np.add.reduceat(left, starts)
        enough = np.add.reduceat(n, starts) >= least if words > 1 else np.ones(len(starts), dtype=bool)
        if words == 2:
            enough |= hot[starts]
        chosen = np.flatnonzero(enough & (rest > 0))
        if len(chosen):
            row = starts[chosen]
            lengths = size[row]
            offsets = np.concatenate(([0], np.cumsum(lengths)))
            source = np.repeat(at[row] - offsets[:-1], lengths) + np.arange(offsets[-1])
            out_keys.append(pa.StringArray.from_buffers(len(row), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[source])))
            out_n.append(rest[chosen])
        left = left * ~np.repeat(enough, np.diff(np.append(starts, len(n))))
    return out_keys, out_n


def _pads(longest: int, least: int):
    """(key, n, hot) sorted by key, whole first pairs in a task -> (key, n) padded."""

    def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for keys, n in zip(*padded(table.column("key"), table.column("n").to_numpy(), table.column("hot").to_numpy(), longest, least)):
            yield pa.RecordBatch.from_arrays([keys, pa.array(n)], ["key", "n"])

    def pair(key: str) -> list[str]:
        return key.split(" ", 3)[:3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < _CHUNK:
                continue
            # the last pair may go on in the next batch
            table = pa.Table.from_batches(held).combine_chunks()
            keys, last = table.column("key"), pair(table.column("key")[-1].as_py())
            low, high = 0, table.num_rows - 1
            while low < high:
                mid = (low + high) // 2
                low, high = (low, mid) if pair(keys[mid].as_py()) == last else (mid + 1, high)
            if low:
                yield from made(table.slice(0, low))
            held = table.slice(low).to_batches()
        held = [b for b in held if b.num_rows]
        if held:
            yield from made(pa.Table.from_batches(held).combine_chunks())

    return run


def _spelled(coded):
    """(lang, size, phrase, f) with codes -> with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, words = (dict(zip(word_codes(len(x)), x)) for x in coded.value)
        for batch in batches:
            phrases = [" ".join(_spelling(t, words) for t in p.split(" ")) if p else "" for p in batch.column("phrase").to_pylist()]
            lang = [_spelling(t, langs) for t in batch.column("lang").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), batch.column("size"), pa.array(phrases, pa.string()), batch.column("f")], ["lang", "size", "phrase", "f"])

    return run


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, coded_words: int = CODED_WORDS,
                  hot_share: float | None = None) -> DataFrame:
    """(lang, size, phrase, f) of every phrase of 1 to `longest` words that occurs at least `least` times in
    its language, and one row (lang, 0, '', all its word occurrences) for each language.

    Words that make up `hot_share` of all (by default what a task holds on average) are hot: pairs of them are
    dealt by their next word too."""
    spark = docs.sparkSession
    width = shared.shuffle_width(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = rows.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = shared.stored(shared.gathered(words), "frequent-words")
    frequent = spark.sparkContext.broadcast(frequent_bits(words))
    top = lambda c, most: words.groupBy(c).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), c).limit(most).collect()
    langs, first = top("lang", CODED_LANGS), top("word", coded_words)
    coded = spark.sparkContext.broadcast(([r["lang"] for r in langs], [r["word"] for r in first]))
    total = words.agg(F.sum("n")).first()[0] or 0
    limit = total * (1 / width if hot_share is None else hot_share)
    hot = [c for c, r in zip(word_codes(len(first)), first) if r["n"] >= limit]
    made = rows.mapInArrow(_windows(frequent, coded, longest), "key string, n long")
    prefix = lambda k: F.substring_index("key", " ", k + 1)
    token = lambda k: F.substring_index(prefix(k), " ", -1)
    is_hot = token(1).isin(hot) & token(2).isin(hot) if hot else F.lit(False)
    deal = F.when(is_hot, prefix(max(2, longest - 1))).otherwise(prefix(2)) if hot else prefix(2)
    dealt = made.repartition(width, deal).sortWithinPartitions("key").withColumn("hot", is_hot)
    windows = dealt.mapInArrow(_pads(longest, least), "key string, n long")
    names = [f"w{k}" for k in range(1, longest + 1)]
    split = windows.select(F.split("key", " ", -1).alias("w"), "n")
    leads = split.select(F.get("w", F.lit(0)).alias("lang"), "n", *[F.coalesce(F.get("w", F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(names, 1)])
    listed = ", ".join(names)
    rolled = spark.sql(f"SELECT lang, {listed}, grouping_id() AS level, sum(n) AS f FROM {{t}} GROUP BY lang, ROLLUP({listed})", t=leads)
    size = F.expr(f"{longest} - bit_count(level)").cast("int")
    for c in names:  # grouped-away columns are null
        rolled = rolled.where(F.col(c).isNull() | (F.col(c) != ""))
    found = rolled.where((F.col("f") >= least) | (size == 0))
    found = found.select("lang", size.alias("size"), F.concat_ws(" ", *names).alias("phrase"), "f")
    return shared.gathered(found).mapInArrow(_spelled(coded), "lang string, size int, phrase string, f long")


def _exact(c):
    return F.col(c).cast("decimal(20,0)")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language by score descending, a
    descending, phrase ascending (bytes).

    Texts are lower-cased (A-Z), cut into pieces at `.,;:!?` and line ends, and into words at spaces and
    tabs.  n is all word occurrences of the language, a phrase's count all its occurrences within pieces.
    Candidates are phrases of 2 to `longest` words with a >= `least`; of the cuts in two parts with counts l
    and r the one of the lowest score floor(2000000 a / (l + r)) counts (ties: the shortest first part).  A
    candidate inside a longer one that occurs at least 0.8 times as often is left out.

    A null language is 'und'; null and empty texts have no words; repeated rows count each; an empty table
    gives no rows.  Other columns are not read.
    """
    counts = shared.stored(phrase_counts(docs, lang_col, text_col, longest, least), "collocations")
    phrases = counts.where("size > 0").select("lang", "phrase", "f")
    words = F.split("phrase", " ", -1)
    found = counts.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), "size")
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    side = lambda part, f: phrases.select(F.col("lang").alias(f"{f}_lang"), F.col("phrase").alias(f"{f}_phrase"), F.col("f").alias(f))
    both = cuts
    for part, f in (("first", "l"), ("rest", "r")):
        both = both.join(side(part, f), (F.col("lang") == F.col(f"{f}_lang")) & (F.col(part) == F.col(f"{f}_phrase")))
    score = F.expr(f"cast({SCORE} as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = both.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("c")).groupBy("lang", "phrase", "a").agg(F.min("c").alias("c"))
    parts = found.where("size > 2").select("lang", F.col("a").alias("longer"), "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    parts = parts.select("lang", "longer", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i"))
    parts = parts.groupBy(F.col("lang").alias("in_lang"), F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("inner")).agg(F.max("longer").alias("longer"))
    left = best.join(parts, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("inner")) & (HELD_OF * _exact("longer") >= HELD * _exact("a")), "left_anti")
    ranked = left.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = ranked.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    total = counts.where("size = 0").select(F.col("lang").alias("of"), F.col("f").alias("n"))
    return ranked.join(total, F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

