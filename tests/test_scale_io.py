"""Source trees: the layout of Spark's partitioned writer, few tasks for many folders."""
import os

from pyspark.sql import functions as F

from reviewlake.sources import io as IO


def tree(root):
    """Folder -> sorted contents of its files."""
    found = {}
    for where, _, names in os.walk(root):
        files = [n for n in names if not n.startswith((".", "_"))]
        if files:
            found[os.path.relpath(where, root)] = sorted(open(os.path.join(where, n), "rb").read() for n in files)
    return found


def test_tree_as_partitioned_writer(spark, tmp_path):
    """Null, empty and odd folder names, repeated folders, empty, null and multi-line texts; nothing unfinished is left."""
    names = ["a", "", None, "x/y", "a:b=c", "é ü", "100%", "{[^]}", "q?#*'\"\\", "tab\tend", "z.z"]
    rows = [(n, k, t) for n in names for k, t in [(1, "one\ntwo"), (2, ""), (3, None), (4, "é\r\n🚨"), (4, "é\r\n🚨")]]
    df = spark.createDataFrame(rows, "source string, doc_id long, text string").coalesce(1)
    IO.write_tree(df, str(tmp_path / "new"), ["source", "doc_id"])
    df.write.partitionBy("source", "doc_id").text(str(tmp_path / "old"))
    got = tree(tmp_path / "new")
    assert got == tree(tmp_path / "old") and len(got) == 4 * (len(names) - 1)  # null and empty share a folder
    assert not [n for _, _, names in os.walk(tmp_path / "new") for n in names if n.startswith(".")]
    IO.write_tree(df.limit(0), f"file://{tmp_path}/none", ["source", "doc_id"])
    assert IO.read_files(spark, str(tmp_path / "none")).count() == 0


def test_folders_are_listed_in_few_tasks(spark, tmp_path):
    folders = 5 * 4 * spark.sparkContext.defaultParallelism
    df = spark.range(folders).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    IO.write_tree(df, str(tmp_path / "tree"), ["doc_id"])
    sc, listing = spark.sparkContext, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(listing)
    sc.setJobGroup("listing", "listing")
    try:
        found = IO.read_files(spark, str(tmp_path / "tree"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 4 * sc.defaultParallelism and spark.conf.get(listing) == before
    assert sorted(int(r.text) for r in found.collect()) == list(range(folders))


def test_small_files_are_read_in_few_tasks(spark, tmp_path):
    """As many tasks as cores, not one for each 31 files; the driver holds no listing."""
    cores = spark.sparkContext.defaultParallelism
    files = 40 * cores
    df = spark.range(files).select(F.lit("s").alias("source"), F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    IO.write_tree(df, str(tmp_path / "tree"), ["source", "doc_id"])
    found = IO.read_files(spark, f"file://{tmp_path}/tree")
    assert found.rdd.getNumPartitions() <= cores
    assert not [f for f in found.inputFiles() if "doc_id=" in f]
    assert sorted(int(r.text) for r in found.collect()) == list(range(files))


def test_files_as_spark_reads_them(spark, tmp_path, monkeypatch):
    """Hidden, empty, odd and linked names, whatever the rounds of the listing and the batches of contents."""
    top = tmp_path / "tree"
    for name in ["a.py", "sp ace", "p%20x", "é", "_hid", "_x=1", ".dot", "x._COPYING_", "_metadata", "_metadata_d/f", ".d/h", "_u/i", "_u=2/j", "nl\nx", "deep/a/b/c",
                 "q?*[]{}", "d._COPYING_/x", "e:f/x", "_metadata._COPYING_", "_metadata3._COPYING_/y", "_metadata=4", *[f"many/{i}/{k}" for i in range(9) for k in range(3)]]:
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(name.encode() * 3 + b"\xff")
    (top / "empty").touch()
    for link, to in [("nothing", "none"), ("file", "a.py"), ("folder", "deep")]:
        (top / link).symlink_to(to)

    def spark_reads(at, most=10**9):
        df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at).filter(F.col("length") <= most)
        return sorted(map(tuple, df.select("path", "length", IO.lenient_text(F.col("content"))).collect()))

    def reads(at, most=None):
        return sorted(map(tuple, IO.read_files(spark, at, most).collect()))

    want = spark_reads(str(top))
    assert len(want) > 40 and reads(str(top)) == want
    monkeypatch.setattr(IO, "_LISTED", 7)
    monkeypatch.setattr(IO, "_BATCH_BYTES", 40)
    assert reads(str(top)) == want
    monkeypatch.undo()
    (top / "deep/a/loop").symlink_to(".")
    assert reads(f"file:{top}/deep/", 13) == [] and len(reads(f"{top}/deep")) > 20
    for at, most in [(f"{top}/deep", None), (f"{top}/_u=2", 21), (f"{top}/deep/a/b/c", None), (f"{top}/deep/*", None)]:  # the last two: a file, a pattern
        assert reads(at, most) == spark_reads(at, most or 10**9)
    assert "ArrowEvalPython" not in IO.read_files(spark, f"{top}/deep").select("path", "size_bytes")._jdf.queryExecution().executedPlan().toString()
