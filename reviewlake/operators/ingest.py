"""Multi-platform pull-request webhooks -> one unified PR table (+ quarantine side output).

Input rows: ``event_id``, ``headers MAP<STRING,STRING>``, ``body STRING`` (raw JSON).  The body is
parsed once with ``from_json`` into one struct whose schema is the union of the four platforms'
payloads (scalars read as text, so ``str(number)`` is the raw token); every field is then a plain
struct access.  Platform detection, PR-event filtering and the four parsers are a single
projection (one scan, no union, no join).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import truthy

UNIFIED_COLS = ["event_id", "platform", "pr_url", "pr_id", "repo_full_name", "source_branch", "target_branch",
                "title", "description", "author", "diff", "additions", "deletions", "sha", "files_changed", "metadata"]


WEBHOOK_SCHEMA = (
    "action STRING, number STRING, object_kind STRING, eventType STRING, "
    "pull_request STRUCT<number: STRING, html_url: STRING, title: STRING, body: STRING, diff_url: STRING, "
    "user: STRUCT<login: STRING>, head: STRUCT<ref: STRING, sha: STRING>, base: STRUCT<ref: STRING>, "
    "additions: STRING, deletions: STRING>, "
    "repository STRUCT<id: STRING, full_name: STRING, html_url: STRING, uuid: STRING, workspace: STRUCT<slug: STRING>>, "
    "object_attributes STRUCT<iid: STRING, id: STRING, url: STRING, source_branch: STRING, target_branch: STRING, "
    "title: STRING, description: STRING, action: STRING, author: STRUCT<username: STRING>, "
    "last_commit: STRUCT<id: STRING>>, "
    "project STRUCT<id: STRING, path_with_namespace: STRING>, "
    "pullrequest STRUCT<id: STRING, title: STRING, description: STRING, links: STRUCT<html: STRUCT<href: STRING>>, "
    "source: STRUCT<branch: STRUCT<name: STRING>>, destination: STRUCT<branch: STRUCT<name: STRING>>, "
    "author: STRUCT<username: STRING, display_name: STRING, nickname: STRING, uuid: STRING>>, "
    "resource STRUCT<pullRequestId: STRING, url: STRING, title: STRING, description: STRING, sourceRefName: STRING, "
    "targetRefName: STRING, createdBy: STRUCT<uniqueName: STRING>, "
    "repository: STRUCT<id: STRING, name: STRING, project: STRUCT<id: STRING, name: STRING>>>"
)


def _v(path: str, typ: str = "string") -> Column:
    c = F.col("_body." + path[2:])
    return c if typ == "string" else c.try_cast(typ)


def _has(path: str) -> Column:
    return F.col("_body." + path[2:]).isNotNull()


def _hdr(name: str) -> Column:
    return F.try_element_at(F.col("_h"), F.lit(name))


def parse_body(df: DataFrame) -> DataFrame:
    """Lower-cased header keys and the body parsed once (all fields NULL when not JSON)."""
    return (df.withColumn("_h", F.transform_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")),
                                                 lambda k, v: F.lower(k)))
            .withColumn("_body", F.from_json(F.col("body"), WEBHOOK_SCHEMA)))


def platform_col() -> Column:
    """Headers in fixed precedence github > gitlab > bitbucket > azure, else body shape, else unknown."""
    by_header = None
    for h, p in dims.PLATFORM_HEADERS:
        cond = F.map_contains_key(F.col("_h"), h)
        by_header = F.when(cond, F.lit(p)) if by_header is None else by_header.when(cond, F.lit(p))
    gh_body = _has("$.pull_request") & _has("$.repository") & \
        F.coalesce(_v("$.repository.html_url").contains("github.com"), F.lit(False))
    gl_body = F.coalesce(_v("$.object_kind") == "merge_request", F.lit(False))
    bb_body = _has("$.pullrequest") & F.lower(F.col("body")).contains("bitbucket")
    az_body = _has("$.resource.pullRequestId")
    return (by_header.when(gh_body, "github").when(gl_body, "gitlab").when(bb_body, "bitbucket")
            .when(az_body, "azure").otherwise("unknown"))


def _settled(df: DataFrame) -> DataFrame:
    """``df`` behind an exploded one-element array: a filter above it stays above it, so that the parse
    below is neither repeated inside the filter nor evaluated twice."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_r")).select("_r.*")


def detect_platform(df: DataFrame) -> DataFrame:
    return parse_body(df).withColumn("platform", platform_col())


def is_pr_event() -> Column:
    p = F.col("platform")
    gh = (F.coalesce(_hdr("x-github-event"), F.lit("")) == "pull_request") & \
        F.coalesce(_v("$.action").isin(*dims.GITHUB_PR_ACTIONS), F.lit(False))
    gl = F.coalesce(_v("$.object_kind") == "merge_request", F.lit(False)) & \
        F.coalesce(_v("$.object_attributes.action").isin(*dims.GITLAB_MR_ACTIONS), F.lit(False))
    bb = F.coalesce(_hdr("x-event-key"), F.lit("")).isin(*dims.BITBUCKET_EVENT_KEYS)
    az = F.coalesce(_v("$.eventType").isin(*dims.AZURE_EVENT_TYPES), F.lit(False))
    return (F.when(p == "github", gh).when(p == "gitlab", gl).when(p == "bitbucket", bb)
            .when(p == "azure", az).otherwise(F.lit(False)))


def filter_pr_events(df: DataFrame) -> DataFrame:
    d = df if "platform" in df.columns else detect_platform(df)
    return _settled(d.withColumn("_pr", is_pr_event())).filter("_pr").drop("_pr")


# required JSON paths per platform (a missing or null value means the event is ignored)
REQUIRED = {
    "github": ["$.pull_request.html_url", "$.pull_request.number", "$.repository.full_name", "$.pull_request.head.ref",
               "$.pull_request.base.ref", "$.pull_request.title", "$.pull_request.user.login",
               "$.pull_request.diff_url", "$.pull_request.head.sha", "$.repository.id"],
    "gitlab": ["$.object_attributes.url", "$.object_attributes.iid", "$.project.path_with_namespace",
               "$.object_attributes.source_branch", "$.object_attributes.target_branch", "$.object_attributes.title",
               "$.object_attributes.author.username", "$.object_attributes.id", "$.project.id"],
    "bitbucket": ["$.pullrequest.links.html.href", "$.pullrequest.id", "$.repository.full_name",
                  "$.pullrequest.source.branch.name", "$.pullrequest.destination.branch.name", "$.pullrequest.title",
                  "$.repository.uuid", "$.repository.workspace.slug"],
    "azure": ["$.resource.pullRequestId", "$.resource.repository.project.name", "$.resource.repository.name",
              "$.resource.sourceRefName", "$.resource.targetRefName", "$.resource.title",
              "$.resource.createdBy.uniqueName", "$.resource.repository.id", "$.resource.repository.project.id"],
}


def missing_required() -> Column:
    p = F.col("platform")
    out = F.lit(False)
    for plat, paths in REQUIRED.items():
        miss = F.lit(False)
        for path in paths:
            miss = miss | ~_has(path)
        out = F.when(p == plat, miss).otherwise(out)
    return out


def _first_truthy(*cols: Column) -> Column:
    return F.coalesce(*[F.when(truthy(c), c) for c in cols])


def _num_text(path: str) -> Column:
    """``str(x)`` of a JSON number or string."""
    return _v(path)


def _metadata(**fields: Column) -> Column:
    """Platform-specific fields as a map of texts (absent ones NULL)."""
    return F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))])


def unify_github() -> dict[str, Column]:
    return {
        "pr_url": _v("$.pull_request.html_url"), "pr_id": _num_text("$.pull_request.number"),
        "repo_full_name": _v("$.repository.full_name"), "source_branch": _v("$.pull_request.head.ref"),
        "target_branch": _v("$.pull_request.base.ref"), "title": _v("$.pull_request.title"),
        "description": F.coalesce(_v("$.pull_request.body"), F.lit("")), "author": _v("$.pull_request.user.login"),
        "diff": _v("$.pull_request.diff_url"),
        "additions": F.coalesce(_v("$.pull_request.additions", "int"), F.lit(0)),
        "deletions": F.coalesce(_v("$.pull_request.deletions", "int"), F.lit(0)),
        "sha": _v("$.pull_request.head.sha"),
        "metadata": _metadata(pr_number=_num_text("$.pull_request.number"), sha=_v("$.pull_request.head.sha"),
                              repo_id=_v("$.repository.id"), action=_v("$.action")),
    }


def unify_gitlab() -> dict[str, Column]:
    return {
        "pr_url": _v("$.object_attributes.url"), "pr_id": _num_text("$.object_attributes.iid"),
        "repo_full_name": _v("$.project.path_with_namespace"), "source_branch": _v("$.object_attributes.source_branch"),
        "target_branch": _v("$.object_attributes.target_branch"), "title": _v("$.object_attributes.title"),
        "description": F.coalesce(_v("$.object_attributes.description"), F.lit("")),
        "author": _v("$.object_attributes.author.username"), "diff": F.lit(""),
        "additions": F.lit(0), "deletions": F.lit(0), "sha": _v("$.object_attributes.last_commit.id"),
        "metadata": _metadata(merge_request_id=_v("$.object_attributes.id"), iid=_num_text("$.object_attributes.iid"),
                              project_id=_v("$.project.id"), action=_v("$.object_attributes.action"),
                              sha=_v("$.object_attributes.last_commit.id")),
    }


def unify_bitbucket() -> dict[str, Column]:
    a = "$.pullrequest.author"
    return {
        "pr_url": _v("$.pullrequest.links.html.href"), "pr_id": _num_text("$.pullrequest.id"),
        "repo_full_name": _v("$.repository.full_name"), "source_branch": _v("$.pullrequest.source.branch.name"),
        "target_branch": _v("$.pullrequest.destination.branch.name"), "title": _v("$.pullrequest.title"),
        "description": F.coalesce(_v("$.pullrequest.description"), F.lit("")),
        "author": F.coalesce(_first_truthy(_v(f"{a}.username"), _v(f"{a}.display_name"), _v(f"{a}.nickname"),
                                           _v(f"{a}.uuid")), F.lit("unknown")),
        "diff": F.lit(""), "additions": F.lit(0), "deletions": F.lit(0), "sha": F.lit(None).cast("string"),
        "metadata": _metadata(pr_id=_num_text("$.pullrequest.id"), repo_uuid=_v("$.repository.uuid"),
                              workspace=_v("$.repository.workspace.slug"), event_key=_hdr("x-event-key")),
    }


def unify_azure() -> dict[str, Column]:
    r = "$.resource"
    return {
        "pr_url": F.coalesce(_v(f"{r}.url"), F.lit("")), "pr_id": _num_text(f"{r}.pullRequestId"),
        "repo_full_name": F.concat(_v(f"{r}.repository.project.name"), F.lit("/"), _v(f"{r}.repository.name")),
        "source_branch": F.replace(_v(f"{r}.sourceRefName"), F.lit("refs/heads/"), F.lit("")),
        "target_branch": F.replace(_v(f"{r}.targetRefName"), F.lit("refs/heads/"), F.lit("")),
        "title": _v(f"{r}.title"), "description": F.coalesce(_v(f"{r}.description"), F.lit("")),
        "author": _v(f"{r}.createdBy.uniqueName"), "diff": F.lit(""),
        "additions": F.lit(0), "deletions": F.lit(0), "sha": F.lit(None).cast("string"),
        "metadata": _metadata(pull_request_id=_num_text(f"{r}.pullRequestId"), repository_id=_v(f"{r}.repository.id"),
                              project_id=_v(f"{r}.repository.project.id"), event_type=_v("$.eventType")),
    }


PARSERS = {"github": unify_github, "gitlab": unify_gitlab, "bitbucket": unify_bitbucket, "azure": unify_azure}


def quarantine_reason() -> Column:
    return (F.when(F.col("platform") == "unknown", "unknown_platform")
            .when(~is_pr_event(), "not_pr_event")
            .when(missing_required(), "missing_required_field"))


def classify_events(raw: DataFrame) -> DataFrame:
    """Every event with platform and quarantine reason (NULL = accepted)."""
    return _settled(detect_platform(raw).withColumn("reason", quarantine_reason()))


def unify(classified: DataFrame, platforms: list[str] | None = None) -> DataFrame:
    """Accepted events -> unified PR rows (one projection with ``CASE platform`` per field)."""
    plats = platforms or list(PARSERS)
    maps = {p: PARSERS[p]() for p in plats}
    fields = [c for c in UNIFIED_COLS if c not in ("event_id", "platform", "files_changed")]
    cols = []
    for f in fields:
        expr = None
        for p in plats:
            expr = F.when(F.col("platform") == p, maps[p][f]) if expr is None else expr.when(F.col("platform") == p, maps[p][f])
        cols.append(expr.alias(f))
    ok = classified.filter(F.col("reason").isNull() & F.col("platform").isin(*plats))
    # a webhook names no files: with_files_changed fills them from the fetched diffs
    return ok.select("event_id", "platform", *cols, F.array().cast("array<string>").alias("files_changed")).select(*UNIFIED_COLS)


def with_files_changed(prs: DataFrame, paths: DataFrame) -> DataFrame:
    """``files_changed`` from diff.changed_paths rows (pr = event_id, paths); without a diff it stays empty."""
    found = paths.select(F.col("pr").alias("_pr"), F.col("paths").alias("_paths"))
    joined = prs.join(found, F.col("event_id") == F.col("_pr"), "left")
    return joined.withColumn("files_changed", F.coalesce("_paths", "files_changed")).drop("_pr", "_paths")


def unified_prs(raw: DataFrame) -> DataFrame:
    return unify(classify_events(raw))


def quarantine(raw: DataFrame) -> DataFrame:
    return classify_events(raw).filter(F.col("reason").isNotNull()).select("event_id", "platform", "reason")


def flag_detailed(prs: DataFrame, branches: list[str] | None = None) -> DataFrame:
    b = dims.DETAILED_BRANCHES if branches is None else branches
    return prs.withColumn("detailed", F.coalesce(F.col("target_branch").isin(*b), F.lit(False)))
