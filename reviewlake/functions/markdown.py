"""Block state of markdown lines: what stands in a fenced code block is text, whatever it looks like."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE_RE = r"^ {0,3}(`{3,}|~{3,})(.*)$"


def fenced_spans(lines: Column) -> Column:
    """Array of lines -> array of (a, b): the first and last line (0-based) of each fenced code block, fences included.

    A fence is three or more backticks or tildes after at most three spaces; it is closed by one of the same sign, at
    least as long and without a text after it, else by the end of the document.  The text after opening backticks
    has none itself.  The state is folded over the fence lines alone."""
    marks = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.regexp_extract(x, FENCE_RE, 1).alias("sign"), F.btrim(F.regexp_extract(x, FENCE_RE, 2)).alias("rest"))), lambda m: m["sign"] != "")
    state = lambda at, sign, spans: F.struct(at.cast("int").alias("at"), sign.alias("sign"), spans.alias("spans"))
    span = lambda a, b: F.array(F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))
    none = F.array().cast("array<struct<a:int,b:int>>")

    def step(s: Column, m: Column) -> Column:
        opens = (s["at"] < 0) & ~(m["sign"].startswith("`") & m["rest"].contains("`"))
        closes = (s["at"] >= 0) & (m["sign"].substr(1, 1) == s["sign"].substr(1, 1)) & (F.length(m["sign"]) >= F.length(s["sign"])) & (m["rest"] == "")
        return (F.when(opens, state(m["i"], m["sign"], s["spans"]))
                .when(closes, state(F.lit(-1), F.lit(""), F.concat(s["spans"], span(s["at"], m["i"])))).otherwise(s))

    return F.aggregate(marks, state(F.lit(-1), F.lit(""), none), step,
                       lambda s: F.when(s["at"] >= 0, F.concat(s["spans"], span(s["at"], F.size(lines) - 1))).otherwise(s["spans"]))


def in_spans(i: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (i >= s["a"]) & (i <= s["b"]))
