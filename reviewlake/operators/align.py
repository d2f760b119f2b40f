"""Which added line of a hunk replaced which removed one.

A change block is what stands between two context lines of a hunk.  Lines that only moved (the same text is removed
and added in the hunk) are set aside; of the others, removed and added lines of a block are aligned in order so that the
total similarity of the pairs is greatest, by dynamic programming.  The similarity of two lines is that of their token
sequences, 2 * longest common subsequence / both lengths; pairs below the least similarity are none.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Least similarity of a pair, and lines of a side that are aligned at once: a longer block is aligned part by part, its
#: sides cut at the same shares of their lengths.
SIMILAR, SPAN = 0.5, 400
_TOKEN = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]")


def common_subsequence(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            left, row[j + 1] = row[j + 1], left + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def similarity(a: list[str], b: list[str], least: float = SIMILAR) -> float:
    """Similarity of two token lists, 0 below `least`."""
    size = len(a) + len(b)
    if not size or 2 * min(len(a), len(b)) < least * size or 2 * sum((Counter(a) & Counter(b)).values()) < least * size:
        return 0.0
    value = 2 * common_subsequence(a, b) / size
    return value if value >= least else 0.0


def aligned(removed: list[str], added: list[str], least: float = SIMILAR) -> list[tuple[int, int]]:
    """Pairs (removed, added) in order with the greatest total similarity; of equal totals the earliest removed lines are paired."""
    a, b = ([_TOKEN.findall(x) for x in side] for side in (removed, added))
    value = [[similarity(x, y, least) for y in b] for x in a]
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + value[i][j] if value[i][j] else 0.0)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if value[i][j] and best[i][j] == best[i + 1][j + 1] + value[i][j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i][j + 1]:
            j += 1
        else:
            i += 1
    return out


def _parts(n: int, m: int, span: int) -> Iterator[tuple[slice, slice]]:
    count = max(1, -(-max(n, m) // span))
    for k in range(count):
        yield slice(k * n // count, (k + 1) * n // count), slice(k * m // count, (k + 1) * m // count)


_PAIRS = "pr {pr}, file_idx long, hunk_idx long, line_number long, new_line_number long, content string, new_content string"


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the blocks of a partition that is sorted by block and line; what is held is one block and one batch's pairs."""
    key, old, new, rows = None, [], [], []

    def close() -> None:
        for a, b in _parts(len(old), len(new), SPAN):
            x, y = old[a], new[b]
            rows.extend((*key[:3], x[i][0], y[j][0], x[i][1], y[j][1]) for i, j in aligned([t for _, t in x], [t for _, t in y]))

    def emitted() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    names = ["pr", "file_idx", "hunk_idx", "line_number", "new_line_number", "content", "new_content"]
    types: list[pa.DataType] = []
    for batch in batches:
        types = [batch.schema.field("pr").type, *[pa.int64()] * 4, pa.string(), pa.string()]
        for *at, kind, number, content in zip(*[batch[c].to_pylist() for c in (*names[:3], "block", "type", "line_number", "content")]):
            if key != at:
                if key is not None:
                    close()
                key, old, new = at, [], []
            (old if kind == "removed" else new).append((number, content))
        if rows:
            yield emitted()
    if key is not None:
        close()
        if rows:
            yield emitted()


def replaced_lines(diff_lines: DataFrame) -> DataFrame:
    """(pr, file_idx, hunk_idx, line_number, new_line_number, content, new_content): removed lines and what replaced
    them.  Lines that moved within the hunk, pure additions and pure removals give no row."""
    hunk = ["pr", "file_idx", "hunk_idx"]
    text = F.btrim("content", F.lit(" \t\n\x0b\f\r"))
    changed = diff_lines.withColumn("block", F.sum((F.col("type") == "context").cast("long")).over(Window.partitionBy(*hunk).orderBy("ln"))).filter("type <> 'context'")
    # of equal texts as many have moved as are both removed and added
    same = Window.partitionBy(*hunk, "_text")
    numbered = changed.withColumn("_text", text).withColumn("_nth", F.row_number().over(Window.partitionBy(*hunk, "_text", "type").orderBy("ln")))
    both = F.least(F.count_if(F.col("type") == "removed").over(same), F.count_if(F.col("type") == "added").over(same))
    left = numbered.withColumn("_moved", F.col("_nth") <= both).filter(~F.col("_moved") & (F.col("_text") != ""))
    block = Window.partitionBy(*hunk, "block")
    left = left.withColumns({"_old": F.count_if(F.col("type") == "removed").over(block), "_new": F.count_if(F.col("type") == "added").over(block)}).filter("_old > 0 and _new > 0")
    rows = left.select(*hunk, "block", "ln", "type", F.col("line_number").cast("long").alias("line_number"), "content")
    # a hunk is a few lines: its blocks are met in the order of a sorted partition, not each by a call of its own
    rows = rows.repartition(*hunk, "block").sortWithinPartitions(*hunk, "block", "ln")
    return rows.mapInArrow(_pairs_of, _PAIRS.format(pr=diff_lines.schema["pr"].dataType.simpleString()))


def replaced_keywords(diff_lines: DataFrame, keywords: list[str]) -> DataFrame:
    """Keywords that a removed line has more often than the line that replaced it: (pr, file_idx, hunk_idx, line_number,
    new_line_number, keyword, lost).  Tokens are runs of ASCII word characters."""
    times = lambda c, k: F.size(F.filter(F.split(c, r"[^A-Za-z0-9_]+"), lambda t: t == k))
    pairs = replaced_lines(diff_lines).select("*", F.explode(F.array(*[F.lit(k) for k in keywords])).alias("keyword"))
    lost = pairs.withColumn("lost", (times("content", F.col("keyword")) - times("new_content", F.col("keyword"))).cast("long")).filter("lost > 0")
    return lost.select("pr", "file_idx", "hunk_idx", "line_number", "new_line_number", "keyword", "lost")
