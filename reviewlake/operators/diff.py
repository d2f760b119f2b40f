"""Unified-diff corpus as a set-based job: a segmented scan of the parser's state, no per-diff parser.

Each PR's diff is cut into sections at ``diff --git`` lines (no line of a hunk can start so) and each section
into runs of lines, so a section of any size is many tasks.  The state before a line is the open hunk and how
many source and target lines it has had.  A run is a map of states: its last hunk header (if any) replaces the
hunk, its lines add to the counts.  The maps of a section's runs are composed over one row per run; every line
is then classified in its run, once.  Files and hunks are numbered, and errors found, over *pieces*: one row
for the lines of a run between two headers.

Line classification (public unified-diff conventions):
* ``@@ -s[,l] +s[,l] @@`` at column 0 opens a hunk (omitted length = 1); ``hunk_idx`` is the running
  count of such headers.
* inside a hunk a line counts toward the source (`` ``/``-``/empty) and/or target (`` ``/``+``/empty);
  it belongs to the hunk while the source *or* target count before it is still below the stated
  length.  So ``--- x`` inside a hunk is a removed line, and a trailing ``\\ No newline`` marker or
  the next file's headers fall outside.
* a file starts at a ``--- `` line outside every hunk; ``+++ `` gives the target.  Paths drop ``a/`` /
  ``b/``; a ``/dev/null`` source is a new file, a ``/dev/null`` target a deleted one; a renamed file goes
  by its target.  A ``diff --git`` section without a ``--- `` line (mode change, binary, pure rename) is a file
  without hunks, by the names of that line; ``new file mode`` and ``deleted file mode`` tell new and deleted ones.

A diff that does not parse has an error, no files and no lines, and counts as zero; so does an empty one,
without the error.  No text can make the job fail.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

HUNK_RE = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
GIT_RE = r"^diff --git (\S.*) (b/.*|\S+)$"
SECTION_RE = r"(?m)(?=^diff --git )"
DEV_NULL = "/dev/null"
#: Lines of one run (about 1 MB).
RUN_LINES = 20_000


def _filename(header_text: Column) -> Column:
    """Text after ``--- ``/``+++ `` up to a tab."""
    return F.regexp_extract(header_text, r"^(?:---|\+\+\+) ([^\t]+)", 1)


def _path(src: Column, tgt: Column) -> Column:
    bare = lambda c: F.when(c.startswith("a/") | c.startswith("b/"), c.substr(3, 1 << 30)).otherwise(c)
    renamed = (tgt != DEV_NULL) & (bare(src) != bare(tgt))
    return F.when((src == DEV_NULL) | renamed, bare(tgt)).otherwise(bare(src))


def _numbers(header: Column) -> list[Column]:
    """Source and target start and length of a hunk header; null where a number has no 64 bits."""
    def number(i: int, name: str, omitted: int | None = None) -> Column:
        digits = F.regexp_extract(header, HUNK_RE, i)
        value = digits.try_cast("bigint")
        return (value if omitted is None else F.when(digits == "", F.lit(omitted).cast("bigint")).otherwise(value)).alias(name)

    return [number(1, "src_start"), number(2, "src_len", 1), number(3, "tgt_start"), number(4, "tgt_len", 1)]


def _counts(text: Column, sign: str) -> Column:
    """Whether a line of a hunk counts toward the side of removed (-) or added (+) lines."""
    return (text == "") | text.startswith(" ") | text.startswith(sign)


def _runs(prs: DataFrame, pr: str, diff: str, run_lines: int) -> DataFrame:
    """(pr, sec, start, parts, l): runs of a section's lines, each with the line that follows it."""
    def cut(section: Column, sec: Column) -> Column:
        lines = F.split(section, "\n")
        starts = F.sequence(F.lit(0), F.size(lines) - 1, F.lit(run_lines))
        return F.transform(starts, lambda s: F.struct(sec.alias("sec"), s.alias("start"), F.size(starts).alias("parts"), F.slice(lines, s + 1, run_lines + 1).alias("l")))

    sections = F.split(F.coalesce(F.col(diff), F.lit("")), SECTION_RE)
    return prs.select(F.col(pr).alias("pr"), F.explode(F.flatten(F.transform(sections, cut))).alias("r")).select("pr", "r.*").repartition("pr", "sec", "start")


def _states_before(runs: DataFrame, run_lines: int) -> DataFrame:
    """(pr, sec, start, before): the hunk open before each run of the sections of several runs, with the counts it
    has had, from the composed maps of the runs before."""
    own = F.slice("l", 1, run_lines)
    last = F.array_max(F.transform(own, lambda x, i: F.when(x.rlike(HUNK_RE), i)))
    rest = F.when(F.col("last").isNull(), own).otherwise(F.slice(own, F.col("last") + 2, run_lines))
    n = lambda sign: F.size(F.filter("rest", lambda x: _counts(x, sign))).cast("bigint")
    maps = runs.where("parts > 1").withColumn("last", last).withColumn("rest", rest).select(
        "pr", "sec", "start", F.when(F.col("last").isNotNull(), F.get("l", F.col("last"))).alias("hdr"), n("-").alias("src"), n("+").alias("tgt"))
    before = Window.partitionBy("pr", "sec").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    maps = maps.withColumns({"src_all": total("src"), "tgt_all": total("tgt")})
    opened = F.when(F.col("hdr").isNotNull(), F.struct("hdr", "src_all", "tgt_all"))
    states = maps.select("pr", "sec", "start", "src_all", "tgt_all", F.last(opened, ignorenulls=True).over(before).alias("o")).where("o is not null")
    # counts as offsets of the running counts inside the run
    state = F.struct(*_numbers(F.col("o.hdr")), (F.col("o.src_all") - F.col("src_all")).alias("src_at"), (F.col("o.tgt_all") - F.col("tgt_all")).alias("tgt_at"))
    return states.select("pr", "sec", "start", state.alias("before"))


def diff_lines_all(prs: DataFrame, pr: str = "pr", diff: str = "diff", run_lines: int = RUN_LINES) -> DataFrame:
    """Every physical line of every diff, classified in its run.

    Columns: pr, sec, start (the run's first line), ln (0-based in the section), text, is_hunk_header, in_hunk, the
    open hunk's src_start, src_len, tgt_start, tgt_len, src_before and tgt_before; hunk and file (running counts of
    hunk headers and of ``--- `` headers in the run), named (on a ``--- `` header: path and kinds), path (the last
    such path in the run), git (names of a section's ``diff --git`` line), new_mode, deleted_mode.
    """
    runs = _runs(prs, pr, diff, run_lines)
    runs = runs.join(_states_before(runs, run_lines), ["pr", "sec", "start"], "left")
    pairs = F.transform("l", lambda x, i: F.struct(x.alias("text"), F.get("l", i + 1).alias("next")))
    df = runs.select("pr", "sec", "start", "before", F.posexplode(pairs).alias("i", "t")).where(F.col("i") < run_lines)
    df = df.select("pr", "sec", "start", "before", (F.col("start") + F.col("i")).alias("ln"), "t.text", "t.next")
    so_far = Window.partitionBy("pr", "sec", "start").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    text, nxt = F.col("text"), F.col("next")
    # the empty element after a final newline is not a line of the diff
    line = ~((text == "") & nxt.isNull())
    side = lambda sign: (line & _counts(text, sign)).cast("bigint")
    is_header = text.startswith("@@") & text.rlike(HUNK_RE)
    df = df.withColumn("is_hunk_header", is_header).withColumns({
        "src_at": F.sum(side("-")).over(so_far) - side("-"), "tgt_at": F.sum(side("+")).over(so_far) - side("+"), "hunk": F.sum(F.col("is_hunk_header").cast("int")).over(so_far)})
    opened = F.when(F.col("is_hunk_header"), F.struct(*_numbers(text), "src_at", "tgt_at"))
    df = df.withColumn("o", F.coalesce(F.last(opened, ignorenulls=True).over(so_far), F.col("before")))
    src_before, tgt_before = F.col("src_at") - F.col("o.src_at"), F.col("tgt_at") - F.col("o.tgt_at")
    inside = ~F.col("is_hunk_header") & line & ((src_before < F.col("o.src_len")) | (tgt_before < F.col("o.tgt_len"))) & (_counts(text, "-") | _counts(text, "+"))
    df = df.select("pr", "sec", "start", "ln", "text", "next", "is_hunk_header", "hunk", F.coalesce(inside, F.lit(False)).alias("in_hunk"), "o.src_start", "o.src_len", "o.tgt_start", "o.tgt_len",
                   src_before.alias("src_before"), tgt_before.alias("tgt_before"))
    out = ~F.col("in_hunk")
    dash = out & ~F.col("is_hunk_header") & text.startswith("--- ") & F.coalesce(nxt.startswith("+++ "), F.lit(False))
    df = df.withColumn("named", F.when(dash, _named(_filename(text), _filename(nxt))))
    git = F.when((F.col("ln") == 0) & text.startswith("diff --git ") & text.rlike(GIT_RE), F.struct(F.regexp_extract("text", GIT_RE, 1).alias("src"), F.regexp_extract("text", GIT_RE, 2).alias("tgt")))
    return df.withColumns({"file": F.sum(F.col("named").isNotNull().cast("int")).over(so_far), "path": F.last("named.path", ignorenulls=True).over(so_far),
                           "git": git, "new_mode": out & text.startswith("new file mode"), "deleted_mode": out & text.startswith("deleted file mode")}).drop("next")


def _named(src: Column, tgt: Column) -> Column:
    return F.struct(_path(src, tgt).alias("path"), (src == DEV_NULL).alias("is_new"), (tgt == DEV_NULL).alias("is_deleted"))


def _pieces(classified: DataFrame) -> DataFrame:
    """One row for the lines of a run between two headers: counts, the hunk or file it opens, and per PR hunk_idx,
    file_idx, header (of its file) and orphan (no file header before it in the section)."""
    text = F.col("text")
    n = lambda c: F.count_if(F.col("in_hunk") & c)
    p = classified.groupBy("pr", "sec", "start", "hunk", "file").agg(
        F.max("is_hunk_header").alias("opens"), F.max(F.when(F.col("is_hunk_header"), F.struct("src_start", "src_len", "tgt_start", "tgt_len"))).alias("k"),
        F.max("named").alias("named"), F.max("git").alias("git"), F.max("new_mode").alias("new_mode"), F.max("deleted_mode").alias("deleted_mode"),
        n(text.startswith("+")).alias("additions"), n(text.startswith("-")).alias("deletions"), n(_counts(text, "-")).alias("src_seen"), n(_counts(text, "+")).alias("tgt_seen"))
    p = p.repartition("pr").sortWithinPartitions("pr", "sec", "start", "hunk", "file")
    order = ["sec", "start", "hunk", "file"]
    section = Window.partitionBy("pr", "sec").orderBy(*order[1:])
    whole, so_far = section.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), section.rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumns({"s_named": F.max("named").over(whole), "s_git": F.max("git").over(whole), "s_new": F.max("new_mode").over(whole), "s_deleted": F.max("deleted_mode").over(whole),
                       "header": F.last("named", ignorenulls=True).over(so_far)})
    side = lambda gone, name: F.when(F.col(gone), F.lit(DEV_NULL)).otherwise(F.col(f"s_git.{name}"))
    by_git = F.when(F.col("s_named").isNull() & F.col("s_git").isNotNull(), _named(side("s_new", "src"), side("s_deleted", "tgt")))
    starts = F.col("named").isNotNull() | (F.col("s_named").isNull() & F.col("git").isNotNull())
    p = p.withColumn("header", F.coalesce("header", by_git)).withColumn("starts", starts)
    per_pr = Window.partitionBy("pr").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumns({"hunk_idx": F.sum(F.col("opens").cast("int")).over(per_pr), "file_idx": F.sum(F.col("starts").cast("int")).over(per_pr)})
    return p.withColumn("orphan", F.col("header").isNull()).drop("s_named", "s_git", "s_new", "s_deleted", "new_mode", "deleted_mode")


def _hunks(pieces: DataFrame) -> DataFrame:
    """Per (pr, file_idx, hunk_idx): counts, the hunk's numbers, its first error; header of a file that starts there."""
    h = pieces.groupBy("pr", "file_idx", "hunk_idx").agg(
        F.max(F.when(F.col("starts"), F.col("header"))).alias("header"), F.max("opens").alias("opens"), F.max(F.when(F.col("opens"), F.struct("k.*", "orphan"))).alias("k"),
        *[F.sum(c).alias(c) for c in ("additions", "deletions", "src_seen", "tgt_seen")])
    src, tgt = F.col("k.src_len"), F.col("k.tgt_len")
    error = (F.when(F.col("k.orphan"), "hunk_without_file_header")
             .when(src.isNull() | tgt.isNull() | F.col("k.src_start").isNull() | F.col("k.tgt_start").isNull(), "bad_hunk_header")
             .when((F.col("src_seen") < src) | (F.col("tgt_seen") < tgt), "hunk_too_short")
             .when((F.col("src_seen") > src) | (F.col("tgt_seen") > tgt), "hunk_too_long"))
    return h.withColumn("error", F.when(F.col("opens"), error))


def _parsed(rows: DataFrame) -> DataFrame:
    """Rows (with `error`) of the PRs without any error."""
    return rows.withColumn("_bad", F.min("error").over(Window.partitionBy("pr"))).filter(F.col("_bad").isNull()).drop("_bad")


def diff_files(prs: DataFrame | None, pr: str = "pr", diff: str = "diff", classified: DataFrame | None = None) -> DataFrame:
    """Per (pr, file_idx): path, additions, deletions, is_new, is_deleted, hunks; none of a diff with an error."""
    hunks = _hunks(_pieces(diff_lines_all(prs, pr, diff) if classified is None else classified))
    f = hunks.groupBy("pr", "file_idx").agg(F.max("header").alias("header"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"),
                                            F.count_if("opens").alias("hunks"), F.min("error").alias("error"))
    f = _parsed(f).filter(F.col("header").isNotNull())
    return f.select("pr", "file_idx", "header.path", "additions", "deletions", "header.is_new", "header.is_deleted", "hunks")


def diff_hunks(classified: DataFrame) -> DataFrame:
    """Per hunk: source/target start and length (of diffs without an error)."""
    return _parsed(_hunks(_pieces(classified))).filter("opens").select("pr", "file_idx", "hunk_idx", "k.src_start", "k.src_len", "k.tgt_start", "k.tgt_len")


def diff_lines(classified: DataFrame) -> DataFrame:
    """One row per in-hunk line: type, line number (target for added, else source), content and path (of diffs
    without an error).

    The classified lines are checkpointed in the shared folder while the frame is built: the pieces read them, and
    the lines join the numbers of their run without a further shuffle.
    """
    ensure_checkpoint_dir(classified.sparkSession)
    kept = F.col("in_hunk") | F.col("is_hunk_header") | F.col("named").isNotNull() | F.col("git").isNotNull() | F.col("new_mode") | F.col("deleted_mode")
    held = classified.filter(kept).checkpoint()
    pieces = _pieces(held)
    bad = _hunks(pieces).filter(F.col("error").isNotNull()).select("pr").distinct()
    runs = pieces.groupBy("pr", "sec", "start").agg(
        F.min(F.col("hunk_idx") - F.col("hunk")).alias("hunks_before"), F.min(F.col("file_idx") - F.col("file")).alias("files_before"),
        F.max(F.when(F.col("file") == 0, F.col("header.path"))).alias("path_before")).join(bad, "pr", "left_anti")
    text = F.col("text")
    typ = F.when(text.startswith("+"), "added").when(text.startswith("-"), "removed").otherwise("context")
    number = F.when(text.startswith("+"), F.col("tgt_start") + F.col("tgt_before")).otherwise(F.col("src_start") + F.col("src_before"))
    return held.filter("in_hunk").join(runs, ["pr", "sec", "start"]).select(
        "pr", (F.col("file") + F.col("files_before")).alias("file_idx"), (F.col("hunk") + F.col("hunks_before")).alias("hunk_idx"), "ln", typ.alias("type"), number.alias("line_number"),
        text.substr(2, 1 << 30).alias("content"), F.coalesce("path", "path_before").alias("path"))


def diff_summary(files: DataFrame, prs: DataFrame | None = None) -> DataFrame:
    """Counts per PR; with ``prs`` also zero rows of PRs without a file (empty diffs, diffs with an error)."""
    s = files.groupBy("pr").agg(
        F.count(F.lit(1)).alias("files_count"),
        F.sum("additions").cast("bigint").alias("total_additions"),
        F.sum("deletions").cast("bigint").alias("total_deletions"))
    return s if prs is None else prs.select("pr").distinct().join(s, "pr", "left").fillna(0, ["files_count", "total_additions", "total_deletions"])


def changed_paths(files: DataFrame, prs: DataFrame | None = None) -> DataFrame:
    """Ordered path list per PR (bounded by its diff); with ``prs`` also empty lists."""
    p = files.groupBy("pr").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("file_idx", "path"))), lambda x: x["path"]).alias("paths"))
    if prs is None:
        return p
    return prs.select("pr").distinct().join(p, "pr", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))


def net_change(files: DataFrame, prs: DataFrame | None = None) -> DataFrame:
    """Summary, net change and path list per PR in one aggregation."""
    s = files.groupBy("pr").agg(
        F.count(F.lit(1)).alias("files_count"), F.sum("additions").cast("bigint").alias("total_additions"), F.sum("deletions").cast("bigint").alias("total_deletions"),
        F.transform(F.array_sort(F.collect_list(F.struct("file_idx", "path"))), lambda x: x["path"]).alias("paths"))
    if prs is not None:
        s = prs.select("pr").distinct().join(s, "pr", "left").fillna(0, ["files_count", "total_additions", "total_deletions"]) \
            .withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))
    return s.withColumn("net_change", F.col("total_additions") - F.col("total_deletions"))


def extension_of(path: Column) -> Column:
    """Text after the last '.' of the whole path (so ``a.b/c`` gives ``b/c``), else ``no_extension``."""
    return F.when(path.contains("."), F.substring_index(path, ".", -1)).otherwise(F.lit("no_extension"))


def extension_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("pr", extension_of(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("count"))


IS_DIFF_RE = r"^\s*(diff --git|--- a/|\+\+\+ b/|@@)"


def is_diff(text: Column) -> Column:
    """Diff vs plain code, by prefix after left-trimming whitespace."""
    return F.coalesce(text.rlike(IS_DIFF_RE), F.lit(False))


def assemble_diff(file_patches: DataFrame, pr: str = "pr") -> DataFrame:
    """Rebuild one diff text per PR from per-file patches (headers + patch; empty patches skipped).

    Input: pr, file_idx, filename, patch."""
    part = F.concat(F.lit("--- a/"), F.col("filename"), F.lit("\n+++ b/"), F.col("filename"), F.lit("\n"), F.col("patch"))
    return (file_patches.filter(F.col("patch").isNotNull() & (F.col("patch") != ""))
            .groupBy(pr).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_idx", part.alias("p")))),
                                                      lambda x: x["p"]), "\n").alias("diff")))


def diff_errors(classified: DataFrame) -> DataFrame:
    """Diffs that do not parse, with an error code and zero counts: a hunk before any file header, with numbers out
    of range, or whose lines are fewer or more than it states."""
    bad = _hunks(_pieces(classified)).filter(F.col("error").isNotNull())
    return (bad.groupBy("pr").agg(F.min("error").alias("error"))
            .withColumn("files_count", F.lit(0)).withColumn("total_additions", F.lit(0))
            .withColumn("total_deletions", F.lit(0)))
