"""Fenced code in rule documents: headings and tables inside are text."""
from pyspark.sql import functions as F

from reviewlake.functions.markdown import fenced_spans
from reviewlake.operators import rules as R
from reviewlake.operators import scan as S


def test_fences(spark):
    cases = [
        (["a", "```", "## x", "```", "b"], [(1, 3)]),
        (["```py", "~~~", "``", "```` ", "c"], [(0, 3)]),        # closed by a longer one, not by tildes
        (["~~~~", "~~~", "```", "~~~~", "```"], [(0, 3), (4, 4)]),  # shorter does not close; an open one runs to the end
        (["``` a`b", "x"], []),                                   # an info string holds no backtick
        (["    ```", "x"], []),                                   # four spaces are no fence
        (["   ```", "```x", "```"], [(0, 2)]),                    # a closing fence has no text
        ([], []), ([""], []),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, l array<string>")
    got = {r.i: [(s.a, s.b) for s in r.s] for r in df.select("i", fenced_spans(F.col("l")).alias("s")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_sections_with_headings_in_fences(spark):
    text = "# A01\n\n## Overview\n\nfirst CWE-79\n\n```md\n## Not a heading\n```\nlast\n\n## Next\nother"
    open_end = "# A02\n\nbody\n```\n## Description\nin code"
    rows = R.owasp_sections(spark.createDataFrame([(1, text), (2, open_end), (3, None)], "doc_id long, raw_md string")).collect()
    got = {r.doc_id: r.description for r in rows}
    assert got == {1: "first CWE-79\n\n```md\n## Not a heading\n```\nlast", 2: "body\n```\n## Description\nin code", 3: ""}


def test_guidelines_with_tables_in_fences(spark):
    text = "## Severity Guidelines\n\n| Issue | Severity |\n|---|---|\n| one | HIGH |\n```\n| two | LOW |\n## End\n```\n| three | **Low** |\n## End\n| four | HIGH |"
    rows = S.severity_guidelines(spark.createDataFrame([("d", text)], "document string, content string")).collect()
    assert sorted((r.issue, r.severity) for r in rows) == [("one", "high"), ("three", "low")]
