"""ingest.*: raw webhook events built from fx_reviews (Spark writes the JSON; the oracle reads the
surviving columns straight from fx_reviews under the same predicates).

Per review: the PR action is rejected when review_id % 5 = 0, one required key is removed when
% 37 = 0, headers are left empty when % 11 = 0 (payload-shape fallback), the body is broken JSON when
% 31 = 0, and no platform can be told when % 29 = 0 (no headers, foreign body)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as I
from .fixtures import fixture, oracle_with
from .registry import register


def webhooks(spark, sf):
    """fx_webhooks: event_id, headers MAP<STRING,STRING>, body STRING."""
    r = fixture(spark, sf, "fx_reviews")
    rid = F.col("review_id").cast("bigint")
    pr = F.col("pr_id").cast("bigint")
    reject, drop, nohdr = rid % 5 == 0, rid % 37 == 0, rid % 11 == 0
    title = F.concat(F.lit("PR "), F.col("review_id"))
    desc = F.concat(F.lit("desc "), F.col("review_id"))
    src = F.concat(F.lit("feature/"), F.col("review_id"))
    sha = F.concat(F.lit("sha"), F.col("review_id"))
    org = F.substring_index("repo", "/", 1)
    name = F.substring_index("repo", "/", -1)

    def s(**kw):
        return F.struct(*[v.alias(k) for k, v in kw.items()])

    def unless(cond, col):
        return F.when(~cond, col)

    gh_url = F.concat(F.lit("https://github.com/"), F.col("repo"), F.lit("/pull/"), F.col("pr_id"))
    github = s(action=F.when(reject, F.lit("closed")).otherwise(F.lit("opened")), number=pr,
               pull_request=s(number=pr, html_url=gh_url, title=title, body=desc,
                              diff_url=F.concat(gh_url, F.lit(".diff")), user=unless(drop, s(login=F.col("author"))),
                              head=s(ref=src, sha=sha), base=s(ref=F.col("target_branch")),
                              additions=(rid % 50).cast("int"), deletions=(rid % 20).cast("int")),
               repository=s(id=rid % 1000, full_name=F.col("repo"),
                            html_url=F.concat(F.lit("https://github.com/"), F.col("repo"))))
    gitlab = s(object_kind=F.lit("merge_request"),
               object_attributes=s(iid=pr, id=rid, title=title, description=desc,
                                   url=F.concat(F.lit("https://gitlab.com/"), F.col("repo"), F.lit("/-/merge_requests/"),
                                                F.col("pr_id")),
                                   source_branch=src, target_branch=F.col("target_branch"),
                                   action=F.when(reject, F.lit("close")).otherwise(F.lit("open")),
                                   author=unless(drop, s(username=F.col("author"))), last_commit=s(id=sha)),
               project=s(id=rid % 1000, path_with_namespace=F.col("repo")))
    bb_author = F.when(rid % 2 == 0, F.to_json(s(username=F.col("author")))).otherwise(
        F.to_json(s(display_name=F.col("author"))))
    bb_href = F.concat(F.lit("https://bitbucket.org/"), F.col("repo"), F.lit("/pull-requests/"), F.col("pr_id"))
    bb_pr = s(id=pr, title=title, description=desc, links=s(html=s(href=bb_href)),
              source=s(branch=s(name=src)),
              destination=unless(drop, s(branch=s(name=F.col("target_branch")))),
              author=F.from_json(bb_author, "username string, display_name string"))
    bitbucket = s(pullrequest=bb_pr,
                  repository=s(full_name=F.col("repo"), uuid=F.concat(F.lit("{"), F.col("review_id"), F.lit("}")),
                               workspace=s(slug=org)))
    azure = s(eventType=F.when(reject, F.lit("git.pullrequest.merged")).otherwise(F.lit("git.pullrequest.created")),
              resource=s(pullRequestId=pr, title=title, description=desc,
                         url=F.concat(F.lit("https://dev.azure.com/"), F.col("repo"), F.lit("/pullrequest/"), F.col("pr_id")),
                         sourceRefName=F.concat(F.lit("refs/heads/"), src),
                         targetRefName=F.concat(F.lit("refs/heads/"), F.col("target_branch")),
                         createdBy=unless(drop, s(uniqueName=F.col("author"))),
                         repository=s(id=F.concat(F.lit("r"), (rid % 1000).cast("string")), name=name,
                                      project=s(id=F.concat(F.lit("p"), org), name=org))))
    p = F.col("platform")
    body = (F.when(p == "github", F.to_json(github)).when(p == "gitlab", F.to_json(gitlab))
            .when(p == "bitbucket", F.to_json(bitbucket)).otherwise(F.to_json(azure)))
    hdr = (F.when(p == "github", F.create_map(F.lit("X-GitHub-Event"), F.lit("pull_request")))
           .when(p == "gitlab", F.create_map(F.lit("X-Gitlab-Event"), F.lit("Merge Request Hook")))
           .when(p == "bitbucket", F.create_map(F.lit("X-Event-Key"),
                                                F.when(reject, F.lit("pullrequest:fulfilled")).otherwise(F.lit("pullrequest:created"))))
           .otherwise(F.create_map(F.lit("X-VSS-ActivityId"), F.concat(F.lit("act-"), F.col("review_id")))))
    headers = F.when(nohdr | (rid % 29 == 0), F.create_map().cast("map<string,string>")).otherwise(hdr)
    body = F.when(rid % 29 == 0, F.lit('{"zen": "hello"}')).when(rid % 31 == 0, F.lit('{"pull_request": {"number": 1,')).otherwise(body)
    return r.select(F.col("review_id").alias("event_id"), headers.alias("headers"), body.alias("body"))


EV = """
ev0 AS (SELECT *, CAST(review_id AS BIGINT) AS rid FROM fx_reviews),
ev AS (SELECT * REPLACE (CASE WHEN rid % 29 = 0 OR (rid % 31 = 0 AND rid % 11 = 0) THEN 'unknown' ELSE platform END AS platform) FROM ev0),
cls AS (SELECT *, CASE WHEN platform = 'unknown' THEN 'unknown_platform'
                       WHEN rid % 31 = 0 THEN CASE WHEN platform = 'bitbucket' AND rid % 5 <> 0 THEN 'missing_required_field' ELSE 'not_pr_event' END
                       WHEN (platform IN ('github', 'bitbucket') AND rid % 11 = 0) OR rid % 5 = 0 THEN 'not_pr_event'
                       WHEN rid % 37 = 0 THEN 'missing_required_field' END AS reason FROM ev),
uni AS (
  SELECT review_id AS event_id, platform,
         CASE platform WHEN 'github' THEN 'https://github.com/' || repo || '/pull/' || pr_id
                       WHEN 'gitlab' THEN 'https://gitlab.com/' || repo || '/-/merge_requests/' || pr_id
                       WHEN 'bitbucket' THEN 'https://bitbucket.org/' || repo || '/pull-requests/' || pr_id
                       ELSE 'https://dev.azure.com/' || repo || '/pullrequest/' || pr_id END AS pr_url,
         pr_id, repo AS repo_full_name, 'feature/' || review_id AS source_branch, target_branch,
         'PR ' || review_id AS title, 'desc ' || review_id AS description,
         CASE WHEN platform = 'bitbucket' AND author = '' THEN 'unknown' ELSE author END AS author,
         CASE WHEN platform = 'github' THEN 'https://github.com/' || repo || '/pull/' || pr_id || '.diff' ELSE '' END AS diff,
         CAST(CASE WHEN platform = 'github' THEN rid % 50 ELSE 0 END AS INT) AS additions,
         CAST(CASE WHEN platform = 'github' THEN rid % 20 ELSE 0 END AS INT) AS deletions,
         CASE WHEN platform IN ('github', 'gitlab') THEN 'sha' || review_id END AS sha,
         CASE platform
           WHEN 'github' THEN 'action=opened;pr_number=' || pr_id || ';repo_id=' || CAST(rid % 1000 AS VARCHAR) || ';sha=sha' || review_id
           WHEN 'gitlab' THEN 'action=open;iid=' || pr_id || ';merge_request_id=' || review_id || ';project_id=' || CAST(rid % 1000 AS VARCHAR)
                              || ';sha=sha' || review_id
           WHEN 'bitbucket' THEN 'event_key=pullrequest:created;pr_id=' || pr_id || ';repo_uuid={' || review_id || '};workspace='
                                 || split_part(repo, '/', 1)
           ELSE 'event_type=git.pullrequest.created;project_id=p' || split_part(repo, '/', 1) || ';pull_request_id=' || pr_id
                || ';repository_id=r' || CAST(rid % 1000 AS VARCHAR) END AS metadata,
         '' AS files_changed
  FROM cls WHERE reason IS NULL)"""


def ev_oracle(body: str) -> str:
    return oracle_with("WITH " + EV.strip() + "\n" + body, "fx_reviews")


def _classified(spark, sf):
    return I.classify_events(webhooks(spark, sf))


def _flat(prs):
    """Maps and lists leave as sorted text."""
    meta = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return prs.withColumn("metadata", F.array_join(meta, ";")).withColumn("files_changed", F.array_join("files_changed", ","))


@register("ingest.detect_platform", ev_oracle("SELECT review_id AS event_id, platform FROM ev"))
def _detect(spark, sf):
    return I.detect_platform(webhooks(spark, sf)).select("event_id", "platform")


@register("ingest.pr_events", ev_oracle("""
SELECT review_id AS event_id, platform FROM cls WHERE reason IS NULL OR reason = 'missing_required_field'"""))
def _pr_events(spark, sf):
    return I.filter_pr_events(webhooks(spark, sf)).select("event_id", "platform")


for _p in ["github", "gitlab", "bitbucket", "azure"]:
    def _mk(p):
        def build(spark, sf):
            return _flat(I.unify(_classified(spark, sf), [p]))
        return build
    register(f"ingest.unify_{_p}", ev_oracle(f"SELECT * FROM uni WHERE platform = '{_p}'"))(_mk(_p))


@register("ingest.unified_prs", ev_oracle("SELECT * FROM uni"))
def _unified(spark, sf):
    return _flat(I.unify(_classified(spark, sf)))


@register("ingest.quarantine", ev_oracle("SELECT review_id AS event_id, platform, reason FROM cls WHERE reason IS NOT NULL"))
def _quarantine(spark, sf):
    return I.quarantine(webhooks(spark, sf))


@register("ingest.target_is_detailed", ev_oracle("""
SELECT event_id, target_branch, target_branch IN ('master', 'main', 'preprod', 'production') AS detailed FROM uni"""))
def _detailed(spark, sf):
    return I.flag_detailed(I.unify(_classified(spark, sf))).select("event_id", "target_branch", "detailed")
