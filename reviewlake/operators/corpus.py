"""Source-file inventories: language, classification, ignore rules and the review plan.

Dimension lookups are literal maps (fixed size, no join).  Ignore patterns come from data (an
ignore file per project or a default set) and are indexed by shape: names, suffixes and literal
paths become keys, which the paths' own parts and prefixes meet in an equi-join; only patterns
with other wildcards reach a regex, compiled once per list of patterns and Python worker.
"""
from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import py_strip


# ------------------------------------------------------------------------------------------ paths

def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_parts(path: Column) -> Column:
    return F.split(path, "/")


def suffix(path: Column) -> Column:
    """Python ``Path.suffix``: last ``.xxx`` of the file name; dot-files and a trailing dot give ''."""
    name = basename(path)
    from_end = F.locate(".", F.reverse(name))            # 1 = last char is '.'
    pos = F.length(name) - from_end + 1                  # 1-based position of the last '.'
    ok = (from_end > 1) & (pos > 1)
    return F.when(ok, F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise(F.lit(""))


# ------------------------------------------------------------------------------------------ language

def language_of(path: Column) -> Column:
    """Large extension map on the lower-cased last suffix; NULL if unmapped."""
    ext = F.lower(F.substring(suffix(path), 2, 1 << 30))
    return dims.lookup(dims.EXTENSION_LANGUAGE, ext)


def with_language(files: DataFrame, path: str = "rel_path") -> DataFrame:
    return files.withColumn("language", language_of(F.col(path)))


def language_auto_of(path: Column) -> Column:
    """Project map on the lower-cased suffix, default ``auto``."""
    return F.coalesce(dims.lookup(dims.PROJECT_EXTENSION_LANGUAGE, F.lower(suffix(path))), F.lit("auto"))


def with_language_auto(files: DataFrame, path: str = "rel_path") -> DataFrame:
    return files.withColumn("language", language_auto_of(F.col(path)))


def is_config_name(path: Column) -> Column:
    return F.lower(basename(path)).isin(*dims.CONFIG_FILE_NAMES)


def dominant_language(files: DataFrame, group: str = "project", path: str = "rel_path", order: str = "pos") -> DataFrame:
    """Majority language per group, config files excluded; ties go to the language seen first.

    Partial aggregation per (group, language) happens map-side, so a huge project only sends one
    row per language to the ranking window."""
    votes = (files.filter(~is_config_name(F.col(path)))
             .withColumn("language", language_of(F.col(path))).filter(F.col("language").isNotNull())
             .groupBy(group, "language").agg(F.count(F.lit(1)).alias("files"), F.min(order).alias("first_pos")))
    w = Window.partitionBy(group).orderBy(F.col("files").desc(), F.col("first_pos").asc())
    return votes.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "first_pos")


def resolve_language(explicit: Column, detected: Column) -> Column:
    """explicit (not ``auto``/empty) > detected > ``auto``."""
    return F.coalesce(F.nullif(F.nullif(explicit, F.lit("auto")), F.lit("")), detected, F.lit("auto"))


def py_capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def language_name(lang: Column) -> Column:
    return F.coalesce(dims.lookup(dims.LANGUAGE_DISPLAY, lang), py_capitalize(lang))


def supported_languages(spark) -> DataFrame:
    """Sorted distinct languages of the extension map (a fixed dimension)."""
    langs = sorted(set(dims.EXTENSION_LANGUAGE.values()))
    return spark.createDataFrame([(x,) for x in langs], "language string")


# ------------------------------------------------------------------------------------------ classification

def _any_part_in(parts: Column, values: list[str]) -> Column:
    return F.arrays_overlap(parts, F.array(*[F.lit(v) for v in values]))


def classify_col(path: Column) -> Column:
    """auto_generated > test > boilerplate > config > source (substring tests on the lower-cased path;
    directory names are compared against every part, the file name included)."""
    low = F.lower(path)
    parts = path_parts(low)
    auto = _any_part_in(parts, dims.AUTO_GENERATED_DIRS)
    for s in dims.AUTO_GENERATED_SUBSTRINGS:
        auto = auto | low.contains(s)
    test = _any_part_in(parts, dims.TEST_PARTS)
    for s in dims.TEST_SUFFIXES:
        test = test | low.endswith(s)
    boiler = F.lower(basename(path)).isin(*dims.BOILERPLATE_NAMES)
    config = F.lower(suffix(path)).isin(*dims.CONFIG_EXTENSIONS)
    return (F.when(auto, "auto_generated").when(test, "test").when(boiler, "boilerplate")
            .when(config, "config").otherwise("source"))


def classify(files: DataFrame, path: str = "rel_path") -> DataFrame:
    return files.withColumn("category", classify_col(F.col(path)))


# ------------------------------------------------------------------------------------------ ignore rules

_WILD = r"[*?\[]"
#: Kinds of keys: a directory part, the file name, their ends from a dot on, the whole path, a directory above it, and
#: a directory part or file name that is not the first part.
_DIR, _NAME, _DIR_END, _NAME_END, _PATH, _ABOVE, _LATER_DIR, _LATER_NAME = range(8)


def _key(kind: int, key: Column, starts: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"), (F.lit(None).cast("string") if starts is None else starts).alias("starts"))


def pattern_index(patterns: DataFrame, col: str = "pattern") -> DataFrame:
    """``patterns`` with ``keys`` (kind, key, starts: a text the path must start with besides) and ``wild``: whether the
    pattern has no keys and must be matched as a whole.

    A pattern without ``/`` holds for directory parts and, unless it ends in ``/``, the file name; one with a ``/`` for
    the whole path, everything below it and, if it ends in ``/``, any path that starts with it."""
    p = F.regexp_replace(F.col(col), "/+$", "")
    is_dir, inner = F.col(col).endswith("/"), p.contains("/")
    plain = lambda c: ~c.rlike(_WILD)
    unless_dir = lambda k: F.when(~is_dir, k)
    end, stem, later = p.substr(2, 1 << 30), F.regexp_replace(p, r"/\*\*?$", ""), p.substr(4, 1 << 30)
    parent = F.regexp_replace(p, "/[^/]*$", "")
    keys = (F.when(~inner & plain(p), F.array(_key(_DIR, p), unless_dir(_key(_NAME, p))))
            .when(~inner & p.startswith("*.") & plain(end), F.array(_key(_DIR_END, end), unless_dir(_key(_NAME_END, end))))
            .when(inner & plain(p), F.array(_key(_PATH, p), _key(_ABOVE, p), F.when(is_dir, _key(_ABOVE, parent, p))))
            .when((stem != p) & (stem != "") & plain(stem), F.array(_key(_ABOVE, stem)))
            .when(p.startswith("**/") & ~is_dir & plain(later) & (later != "") & ~later.contains("/"), F.array(_key(_LATER_DIR, later), _key(_LATER_NAME, later))))
    return patterns.where(p != "").withColumn("keys", F.array_compact(keys)).withColumn("wild", F.col("keys").isNull())


def path_keys(path: Column) -> Column:
    """Array of (kind, key): everything of a path that a pattern's key can equal."""
    parts = path_parts(path)
    n = F.size(parts)
    dirs, name = F.slice(parts, 1, n - 1), F.element_at(parts, -1)
    numbered = lambda kind, texts: F.transform(texts, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))

    def ends(text: Column) -> Column:
        """'.b.c' and '.c' of 'a.b.c'."""
        cut = F.split(text, r"\.")
        return F.transform(F.slice(cut, 2, F.size(cut)), lambda _, i: F.concat(F.lit("."), F.array_join(F.slice(cut, i + 2, F.size(cut)), ".")))

    above = F.transform(dirs, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/"))
    kinds = [numbered(_DIR, dirs), numbered(_NAME, F.array(name)), numbered(_DIR_END, F.flatten(F.transform(dirs, ends))), numbered(_NAME_END, ends(name)), numbered(_PATH, F.array(path)),
             numbered(_ABOVE, above), numbered(_LATER_DIR, F.slice(dirs, 2, n)), numbered(_LATER_NAME, F.when(n > 1, F.array(name)).otherwise(F.array().cast("array<string>")))]
    return F.array_distinct(F.concat(*kinds))


def _compiled(globs: list[str]):
    """One regex for a list of globs (``*`` and ``?`` cross ``/``, ``[!x]`` negates, an unclosed ``[`` is literal); none
    for no globs.  A glob that is no valid class matches nothing."""
    good = []
    for g in globs:
        try:
            good.append(re.compile(fnmatch.translate(g)).pattern)
        except re.error:
            pass
    return re.compile("|".join(f"(?:{g})" for g in good)) if good else None


def _matches_wild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, path, globs) -> (group, path) of the paths that a glob holds for."""
    lists: dict[tuple, tuple] = {}
    for batch in batches:
        hit = []
        for path, globs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            key = tuple(globs)
            if key not in lists:
                bare = [(g.rstrip("/"), g.endswith("/")) for g in globs]
                parts = [(g, d) for g, d in bare if "/" not in g]
                whole = [(g, d) for g, d in bare if "/" in g]
                lists[key] = (_compiled([g for g, _ in parts]), _compiled([g for g, d in parts if not d]),
                              _compiled([x for g, d in whole for x in (g, g + "/**", *[g + "*"] * d)]))
            in_dir, in_name, in_path = lists[key]
            *dirs, name = path.split("/")
            hit.append(bool((in_dir and any(map(in_dir.match, dirs))) or (in_name and in_name.match(name)) or (in_path and in_path.match(path))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["_g", "_rel"]).filter(pa.array(hit, pa.bool_()))


def flag_ignored(files: DataFrame, patterns: DataFrame, path: str = "rel_path", group: str | None = None,
                 default: DataFrame | None = None) -> DataFrame:
    """``files`` with ``ignored``.

    ``patterns`` may carry ``group`` (per-project ignore files).  ``default`` patterns hold for groups without a
    pattern of their own.  A file without a path is not ignored.  The keys of the paths meet those of the patterns in
    an equi-join by (group, kind, key); the paths of groups with other wildcards are matched in Arrow batches."""
    own = F.concat(F.lit("="), F.col(group).cast("string")) if group else F.lit("")
    rules = patterns.select(own.alias("_g"), F.col("pattern"))
    f = files.withColumn("_g", own).withColumn("_rel", F.regexp_replace(F.col(path), r"\\", "/"))
    if group and default is not None:
        owners = pattern_index(rules).select(F.col("_g").alias("_own")).distinct()
        f = f.join(owners, F.col("_g") == F.col("_own"), "left").withColumn("_g", F.coalesce("_own", F.lit(""))).drop("_own")
        rules = rules.unionByName(default.select(F.lit("").alias("_g"), "pattern"))
    index = pattern_index(rules.distinct())
    keys = index.select(F.col("_g").alias("_kg"), F.explode("keys").alias("k")).select("_kg", "k.*").distinct()
    paths = f.select("_g", "_rel").where(F.col("_rel").isNotNull())
    held = paths.select("_g", "_rel", F.explode(path_keys(F.col("_rel"))).alias("p")).join(
        keys, (F.col("_g") == F.col("_kg")) & (F.col("p.kind") == F.col("kind")) & (F.col("p.key") == F.col("key")))
    held = held.where(F.col("starts").isNull() | F.col("_rel").startswith(F.col("starts"))).select("_g", "_rel")
    globs = index.where("wild").groupBy(F.col("_g").alias("_kg")).agg(F.array_sort(F.collect_set("pattern")).alias("globs"))
    wild = paths.join(globs, F.col("_g") == F.col("_kg")).select("_g", "_rel", "globs").mapInArrow(_matches_wild, "_g string, _rel string")
    hits = held.unionByName(wild).distinct().select(F.col("_g").alias("_hg"), F.col("_rel").alias("_hrel"))
    f = f.join(hits, (F.col("_g") == F.col("_hg")) & (F.col("_rel") == F.col("_hrel")), "left")
    return f.withColumn("ignored", F.col("_hrel").isNotNull()).drop("_g", "_rel", "_hg", "_hrel")


def split_ignored(files: DataFrame, patterns: DataFrame, path: str = "rel_path", group: str | None = None,
                  default: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, ignored) files."""
    flagged = flag_ignored(files, patterns, path, group, default)
    return flagged.filter(~F.col("ignored")).drop("ignored"), flagged.filter("ignored").drop("ignored")


def drop_skip_dirs(files: DataFrame, path: str = "rel_path") -> DataFrame:
    return files.filter(~_any_part_in(path_parts(F.col(path)), dims.SKIP_DIRS))


def eligible(files: DataFrame, path: str = "rel_path", size: str = "size_bytes",
             extensions: list[str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """Files with a review extension; ``max_bytes`` leaves out larger ones (none by default)."""
    exts = dims.REVIEW_EXTENSIONS if extensions is None else extensions
    out = files.filter(F.lower(suffix(F.col(path))).isin(*exts))
    return out if max_bytes is None else out.filter(F.col(size) <= max_bytes)


# ------------------------------------------------------------------------------------------ plan

def review_plan(files: DataFrame, patterns: DataFrame, path: str = "rel_path") -> tuple[DataFrame, DataFrame]:
    """(plan rows: project, file, language, size, category; ignored count per project).

    Ignore rules are applied before the extension filter, so the ignored count includes
    non-source files."""
    kept, ignored = split_ignored(files, patterns, path)
    plan = eligible(kept, path).select(
        "project", F.col(path).alias("file"), language_auto_of(F.col(path)).alias("language"),
        F.col("size_bytes").alias("size"), classify_col(F.col(path)).alias("category"))
    counts = ignored.groupBy("project").agg(F.count(F.lit(1)).alias("ignored_by_reviewignore"))
    return plan, counts


def plan_counts(plan: DataFrame, exclude: list[str], seconds_per_file: int = 10) -> DataFrame:
    """One pass with grouping sets: files per category (all), files per language (after the
    category exclusions), and the project total with size and estimated seconds."""
    excluded = F.col("category").isin(*exclude) if exclude else F.lit(False)
    df = plan.withColumn("_kept", ~excluded)
    g = df.groupingSets(
        [["project", "category"], ["project", "language"], ["project"]], "project", "category", "language"
    ).agg(F.count(F.lit(1)).alias("_all"), F.count_if("_kept").alias("_k"),
          F.sum("size").alias("_size"), F.sum(F.when(F.col("_kept"), F.col("size"))).alias("_ksize"),
          F.grouping_id().alias("_gid"))
    kind = F.when(F.col("category").isNotNull(), "category").when(F.col("language").isNotNull(), "language").otherwise("total")
    out = g.select(
        "project", kind.alias("kind"), F.coalesce("category", "language").alias("key"),
        F.when(kind == "language", F.col("_k")).otherwise(F.col("_all")).alias("files"),
        F.when(kind == "total", F.col("_size").cast("bigint")).alias("size_bytes"),
        F.when(kind == "total", F.col("_k") * seconds_per_file).alias("est_seconds"))
    # a language whose files are all excluded does not appear in the filtered counts
    return out.filter((F.col("kind") != "language") | (F.col("files") > 0))


def exclude_categories(plan: DataFrame, cats: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept plan, skipped count per project and category)."""
    hit = F.col("category").isin(*cats)
    return plan.filter(~hit), plan.filter(hit).groupBy("project", "category").agg(F.count(F.lit(1)).alias("skipped"))


def cap_files(files: DataFrame, n: int, path: str = "rel_path") -> DataFrame:
    """First ``n`` files per project in path order (a per-group limit: WindowGroupLimit)."""
    w = Window.partitionBy("project").orderBy(F.col(path))
    return files.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def prepare_text(files: DataFrame, text: str = "text", max_chars: int | None = None, min_chars: int = 1) -> DataFrame:
    """status ``empty`` if the stripped text has fewer than ``min_chars`` characters; else the code, whole or cut to
    ``max_chars`` with a ``truncated`` flag; lines = newlines + 1 of the code."""
    t = F.coalesce(F.col(text), F.lit(""))
    empty = F.length(py_strip(t)) < min_chars
    code = t if max_chars is None else F.substring(t, 1, max_chars)
    return (files
            .withColumn("status", F.when(empty, "empty").otherwise("ready"))
            .withColumn("truncated", F.when(~empty, F.length(code) < F.length(t)))
            .withColumn("code", F.when(~empty, code))
            .withColumn("lines", F.when(~empty, F.length(code) - F.length(F.replace(code, F.lit("\n"), F.lit(""))) + 1)))
