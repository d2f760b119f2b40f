"""Alignment of replaced lines without a call per block."""


def test_blocks_are_aligned_without_a_call_each(spark):
    """Blocks over the edges of Arrow batches, and more of them than one partition has, give their pairs once."""
    from reviewlake.operators import align

    rows = []
    for pr in range(60):
        ln = 0
        for block in range(3):
            for k in range(1 + (pr + block) % 4):
                rows.append((pr, 1, 1, ln, "removed", 10 + ln, f"let r{k} = await load({pr}, x);", "p")); ln += 1
            for k in range(1 + (pr + block) % 4):
                rows.append((pr, 1, 1, ln, "added", 10 + ln, f"let r{k} = load({pr}, x, 1);", "p")); ln += 1
            rows.append((pr, 1, 1, ln, "context", 10 + ln, "ctx", "p")); ln += 1
    df = spark.createDataFrame(rows, "pr long, file_idx long, hunk_idx long, ln int, type string, line_number long, content string, path string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        pairs = align.replaced_lines(df)
        got = pairs.collect()
        assert "FlatMapGroupsInPandas" not in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len({(r.pr, r.line_number) for r in got}) == sum(1 + (pr + b) % 4 for pr in range(60) for b in range(3))
    assert all(r.content.split()[1] == r.new_content.split()[1] for r in got)
