"""Sources and sinks: webhook events, review tables, source trees, rule documents, ignore files,
run events and the project report.  Everything is a Spark reader/writer with a declared schema;
nothing passes through the driver."""
from __future__ import annotations

import errno
import os
import re
import uuid
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import py_strip
from ..session import scratch_path

WEBHOOK_SCHEMA = "event_id string, headers map<string,string>, body string"
REVIEWS_SCHEMA = ("review_id string, repo string, pr_id string, platform string, author string, score int, "
                  "security_score int, block_merge boolean, approval boolean, ai_slop bigint, created_at timestamp_ntz, "
                  "target_branch string")
ISSUES_SCHEMA = ("issue_id string, review_id string, pos int, severity string, category string, title string, "
                 "description string, file_path string, line_number bigint, line_end bigint, code_snippet string, suggestion string, "
                 "owasp_id string, cwe_id string, threat_type string")
EVENTS_SCHEMA = ("run_id string, event_id bigint, seq bigint, ts timestamp_ntz, level string, step string, message string, "
                 "meta map<string,string>")


def read_webhooks(spark: SparkSession, path: str, streaming: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """Raw webhook events (one JSON object per line: event_id, headers, body text).  A stream may bound the new files
    of one micro-batch."""
    if streaming:
        reader = spark.readStream.schema(WEBHOOK_SCHEMA)
        return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).json(path)
    return spark.read.schema(WEBHOOK_SCHEMA).json(path)


def write_webhooks(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_reviews(reviews: DataFrame, issues: DataFrame, path: str, mode: str = "append") -> None:
    """Reviews and issues as Parquet, range-partitioned by repo and time, so that repo filters skip files and a repo
    that holds a third of all reviews is many files.  Issue fields of the schema that are not given are NULL.

    Ids are deterministic, so a replayed batch written with ``mode='overwrite'`` into its own
    folder (see ``streaming.write_reviews_stream``) is idempotent."""
    (reviews.repartitionByRange("repo", "created_at", "review_id").sortWithinPartitions("repo", "created_at")
     .write.mode(mode).parquet(f"{path}/reviews"))
    shape = StructType.fromDDL(ISSUES_SCHEMA)
    full = issues.select(*[(F.col(f.name) if f.name in issues.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape])
    full.sortWithinPartitions("review_id", "pos").write.mode(mode).parquet(f"{path}/issues")


def read_reviews(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What ``write_reviews`` wrote: one folder, or all ``batch=<id>`` folders of the streaming sink (``path/batch=*``)."""
    return (spark.read.schema(REVIEWS_SCHEMA).parquet(f"{path}/reviews"),
            spark.read.schema(ISSUES_SCHEMA).parquet(f"{path}/issues"))


# what a folder name may not hold, as Spark's partitioned writers escape it
_ESCAPED = re.compile("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _is_local(spark: SparkSession, path: str) -> bool:
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return (path if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else default).startswith("file:")


def write_tree(df: DataFrame, root: str, folders: list[str], text: str = "text") -> None:
    """A source tree: each text and a line feed in a file of the folder ``<root>/<column>=<value>/...``, as
    ``partitionBy(*folders).text(root)`` lays it out; texts of one task that share a folder share its file.

    Under a local path (shared storage that is mounted) the tasks write the files themselves: Hadoop's local file system
    starts two ``chmod`` processes for each file, and the committer moves the folders one by one in the driver.  A file
    appears under its name when it is whole, so a task that is run again replaces its own files."""
    if not _is_local(df.sparkSession, root):
        df.select(*folders, text).write.partitionBy(*folders).text(root)
        return
    top = re.sub("^file:(//)?", "", root)

    def folder(values: tuple) -> str:
        return os.path.join(top, *[f"{c}=" + (_ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", v) if v else _NO_VALUE) for c, v in zip(folders, values)])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, open_key, out, files = f"part-{task.partitionId():05d}.txt", None, None, 0
        unfinished = f".{name}.{task.taskAttemptId()}"

        def close() -> None:
            if out is not None:
                out.close()
                os.replace(out.name, os.path.join(os.path.dirname(out.name), name))

        for batch in batches:
            *keys, texts = [column.to_pylist() for column in batch.columns]
            for key, content in zip(zip(*keys), texts):
                if key != open_key or out is None:
                    close()
                    where = folder(key)
                    os.makedirs(where, exist_ok=True)
                    open_key, out, files = key, open(os.path.join(where, unfinished), "wb"), files + 1
                out.write(content or b"")
                out.write(b"\n")
        close()
        yield pa.RecordBatch.from_pydict({"files": [files]}, schema=pa.schema([("files", pa.int64())]))

    os.makedirs(top, exist_ok=True)
    # null and the empty text share a folder
    rows = df.select(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in folders], F.col(text).cast("binary").alias(text))
    # each task takes the topmost folders in an order of its own: tasks that make folders inside the same one wait for each other
    turn = F.xxhash64(F.col(folders[0]), F.spark_partition_id())
    rows.sortWithinPartitions(turn, *folders).mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()


def lenient_text(content: Column) -> Column:
    """Bytes as text; invalid UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


_LISTED = 10_000  # entries: how far a task of the listing goes on by itself, and the files that a reading task gets
_READ_BYTES = 128 << 20  # or so many bytes of them
_BATCH_BYTES = 4 << 20  # contents handed over at once


def _list_tree(spark: SparkSession, top: str) -> tuple[DataFrame, int, int]:
    """The files under a local folder (``path`` as bytes, ``size``) with their number and bytes.  Names and empty files that
    Spark's readers leave out are left out.

    The folders are listed in rounds: a task lists those dealt to it and goes on to the folders inside while these are few;
    the others are dealt anew.  The lists are stored, so the driver holds counts only; there are as many rounds as the tree is
    deep at most."""

    def hidden(name: bytes, folder: bool) -> bool:
        under = name.startswith(b"_") and b"=" not in name
        summary = name.startswith((b"_metadata", b"_common_metadata"))
        return (under or name.startswith(b".") or name.endswith(b"._COPYING_")) and not summary or under and not folder

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: deque[bytes] = deque()
        rows: list[tuple[bytes, int | None]] = []  # without a size: a folder for the next round
        seen = 0

        def folders() -> Iterator[bytes]:
            for batch in batches:
                yield from batch.column(0).to_pylist()
            while found and seen < _LISTED:
                yield found.popleft()

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], ["path", "size"])
            rows.clear()
            return out

        for folder in folders():
            try:
                inside = os.scandir(folder)
            except FileNotFoundError:  # deleted meanwhile
                continue
            with inside:
                for e in inside:
                    seen += 1
                    try:
                        size = None if e.is_dir() else e.stat().st_size
                    except OSError as x:  # a link to nothing, or one inside itself beyond what the system follows
                        if x.errno not in (errno.ENOENT, errno.ELOOP):
                            raise
                        continue
                    if size == 0 or hidden(e.name, size is None):
                        continue
                    if size is None and seen < _LISTED:
                        found.append(e.path)
                    else:
                        rows.append((e.path, size))
                    if len(rows) >= _LISTED:
                        yield batch()
        rows.extend((p, None) for p in found)
        yield batch()

    base, cores = scratch_path(spark, f"listing/{uuid.uuid4().hex}"), spark.sparkContext.defaultParallelism
    todo, n_todo, rounds, n_files, n_bytes = spark.range(1, numPartitions=1).select(F.lit(os.fsencode(top)).alias("path")), 1, [], 0, 0
    while n_todo:
        rounds.append(f"{base}/{len(rounds)}")
        dealt = todo if n_todo == 1 else todo.repartition(max(min(n_todo, 4 * cores), n_todo // _LISTED))
        dealt.mapInArrow(entries, "path binary, size long").write.parquet(rounds[-1])
        listed = spark.read.schema("path binary, size long").parquet(rounds[-1])
        todo = listed.filter(F.col("size").isNull()).select("path")
        n_all, files, size = listed.agg(F.count(F.lit(1)), F.count("size"), F.coalesce(F.sum("size"), F.lit(0))).first()
        n_todo, n_files, n_bytes = n_all - files, n_files + files, n_bytes + size
    return spark.read.schema("path binary, size long").parquet(*rounds).filter(F.col("size").isNotNull()), n_files, n_bytes


def _read_local(spark: SparkSession, top: str, max_bytes: int | None) -> DataFrame:
    """``path``, ``length`` and ``content`` of the files under a local folder, listed and read by the tasks."""

    def contents(paths: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in paths:
            read, size = [], 0
            for path in some.to_pylist():
                with open(path, "rb") as f:
                    read.append(f.read())
                size += len(read[-1])
                if size >= _BATCH_BYTES:
                    yield pa.array(read, pa.binary())
                    read, size = [], 0
            if read:
                yield pa.array(read, pa.binary())

    files, n, size = _list_tree(spark, top)
    tasks = max(min(n, spark.sparkContext.defaultParallelism), n // _LISTED, size // _READ_BYTES, 1)
    if max_bytes is not None:
        files = files.filter(F.col("size") <= max_bytes)
    return files.repartition(tasks).select(F.concat(F.lit("file:"), F.make_valid_utf8(F.col("path").cast("string"))).alias("path"), F.col("size").alias("length"),
                                           F.arrow_udf(contents, "binary").asNondeterministic()("path").alias("content"))


def read_files(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """Recursive scan of a source tree: path, size, text.  ``max_bytes`` leaves out larger files by their metadata,
    before any content is read (none by default); invalid UTF-8 becomes the replacement character.

    Under a local path (shared storage that is mounted) the tasks list and read the files.  Spark's own reader, which takes all other
    paths, keeps the whole listing in the driver and counts 4 MB for opening a file, which makes a task of each 31 small files."""
    top = os.path.abspath(re.sub("^file:(//)?", "", root))
    if _is_local(spark, root) and os.path.isdir(top) and not re.search(r"[][{}*?\\]", top):
        df = _read_local(spark, top, max_bytes)
    else:
        listing, cores = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext.defaultParallelism
        before = spark.conf.get(listing)
        # the folders of a level are listed in a few tasks for each core; Spark starts one for each folder, up to 10 000 a level
        spark.conf.set(listing, str(min(int(before), 4 * cores)))
        try:
            df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        finally:
            spark.conf.set(listing, before)
        if max_bytes is not None:
            df = df.filter(F.col("length") <= max_bytes)
    return df.select("path", F.col("length").alias("size_bytes"), lenient_text(F.col("content")).alias("text"))


def read_rules(spark: SparkSession, directory: str) -> DataFrame:
    """One row per rule document (whole text) with its name: that of its file, or of its ``filename=<name>`` folder."""
    df = spark.read.option("wholetext", "true").text(directory)
    name = F.col("filename") if "filename" in df.columns else F.col("_metadata.file_name")
    return df.select(name.alias("filename"), F.col("value").alias("content"))


def parse_ignore(lines: DataFrame, text: str = "value") -> DataFrame:
    """Ignore-file lines -> patterns: stripped, blanks and ``#`` comments dropped."""
    s = py_strip(F.col(text))
    return lines.select("*", s.alias("pattern")).filter((F.col("pattern") != "") & ~F.col("pattern").startswith("#"))


def read_ignore(spark: SparkSession, path: str) -> DataFrame:
    """Patterns of an ignore file, or of one per ``project=<name>`` folder with their project."""
    lines = spark.read.text(path)
    return parse_ignore(lines).select(*(["project"] if "project" in lines.columns else []), "pattern")


def effective_ignore(project_patterns: DataFrame, default_patterns: DataFrame, projects: DataFrame) -> DataFrame:
    """A project's own ignore file replaces the default: default rows only for projects without one."""
    has_own = project_patterns.select("project").distinct()
    fallback = projects.select("project").distinct().join(has_own, "project", "left_anti")
    # the default file is a handful of rows: broadcast it on a constant key
    defaults = F.broadcast(default_patterns.select("pattern").withColumn("_k", F.lit(1)))
    inherited = fallback.withColumn("_k", F.lit(1)).join(defaults, "_k").select("project", "pattern")
    return project_patterns.select("project", "pattern").unionByName(inherited)


# event times keep their microseconds
EVENT_TIME = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_events(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").options(**EVENT_TIME).json(path)


def read_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(EVENTS_SCHEMA).options(**EVENT_TIME).json(path)


def write_report(summary: DataFrame, results: DataFrame, path: str, key: str = "project") -> None:
    """Project report as JSON lines: ``summary`` has one line per project, ``results`` one per file in path order,
    so that no project has to fit one row."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    results.repartitionByRange(key, "pos").sortWithinPartitions(key, "pos").write.mode("overwrite").json(f"{path}/results")


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.json(f"{path}/summary"), spark.read.json(f"{path}/results")
