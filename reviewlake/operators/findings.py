"""Model responses -> validated, normalised reviews and issues.

A response is parsed once into a variant; its issues stay one array per review, on which synonyms, caps,
prefixes, the short circuit, validation, counters and the summary are array functions.  There is no join
and no shuffle before the issues are exploded, and no text can make the job fail: wrong types and
shapes become a ``failure_reason``.  The row-level functions give the same steps on exploded issues.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import falsy, truthy

# The 12 issue fields the model may return (anything else is dropped by the schema).
ISSUE_FIELDS = ["severity", "title", "description", "file_path", "line_number", "line_end",
                "code_snippet", "suggestion", "category", "owasp_id", "cwe_id", "threat_type"]
INTEGER_FIELDS = ["line_number", "line_end"]
# an explicit null is as wrong as a number in these; the other texts may be null
REQUIRED_TEXT = ["severity", "title", "description", "category"]
NUMBER_KINDS = ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"]
# texts that count as a boolean, lower-cased
TRUE_TEXT, FALSE_TEXT = ["true", "t", "yes", "y", "on", "1"], ["false", "f", "no", "n", "off", "0"]

# FIXED VALUES: fallback reviews when the response has no JSON span / the span is not JSON
NO_JSON_SCORE, NO_JSON_APPROVE = 7, True
BAD_JSON_SUMMARY, BAD_JSON_SCORE, BAD_JSON_APPROVE = "Failed to parse AI response", 5, False
DEFAULT_SUMMARY = {"pr": "AI review completed", "file": "File review completed"}
DEFAULT_SCORE = 7
CRITICAL_DESC_PREFIXES = ["CRITICAL", "🚨", "❌", "critical"]
CRITICAL_TITLE_PREFIXES = ["CRITICAL", "🚨", "❌"]
CRITICAL_DESC_MARK = "🚨 CRITICAL: "
CRITICAL_TITLE_MARK = "CRITICAL: "
SHORT_CIRCUIT_CATEGORIES = ["compilation", "syntax"]
FAILED_SUMMARY = "🚨 Review failed: validation error"


# ------------------------------------------------------------------------------------------
# parsing
# ------------------------------------------------------------------------------------------

def _with_variant(responses: DataFrame, text_col: str) -> DataFrame:
    """Adds ``json_span``, its variant ``_v`` (each text is parsed once) and ``parse_status``."""
    text = F.col(text_col)
    # what stands before the first { and after the last }: the whole text where there is none
    before, after = F.length(F.substring_index(text, "{", 1)), F.length(F.substring_index(text, "}", -1))
    inside = F.length(text) - before - after
    return (responses
            .withColumn("json_span", F.when(inside > 1, text.substr(before + 1, inside)))
            .withColumn("_v", F.expr("try_parse_json(json_span)"))
            .withColumn("parse_status",
                        F.when(F.col("json_span").isNull(), F.lit("no_json"))
                        .when(F.col("_v").isNull(), F.lit("malformed"))
                        .otherwise(F.lit("ok"))))


def extract_json(responses: DataFrame, text_col: str = "response") -> DataFrame:
    """Adds ``json_span`` (first ``{`` .. last ``}``) and ``parse_status`` ok / no_json / malformed.

    The same as greedy ``\\{.*\\}`` in dot-all mode, without a regex.  ``try_parse_json`` is the
    malformed test (it is NULL for invalid text; stricter than Python on duplicate keys and NaN).
    """
    return _with_variant(responses, text_col).drop("_v")


def _kind(v: Column) -> Column:
    """JSON kind of a variant (OBJECT, ARRAY, STRING, BOOLEAN, VOID, a number kind); NULL if there is none."""
    return F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _integer(text: Column) -> Column:
    """A whole number (also of JSON true / false or of a numeric text) as bigint, else NULL."""
    d = F.trim(text).try_cast("double")
    plain = F.trim(text).try_cast("bigint")
    whole = F.when(plain.between(-10**18, 10**18), plain).when((d == F.floor(d)) & (F.abs(d) < 9.0e18), F.coalesce(plain, d.cast("bigint")))
    return F.when(text == "true", F.lit(1).cast("bigint")).when(text == "false", F.lit(0).cast("bigint")).otherwise(whole)


def _integer_ok(text: Column, kind: Column) -> Column:
    return kind.isin(*NUMBER_KINDS, "STRING", "BOOLEAN") & _integer(text).isNotNull()


def _boolean(text: Column, kind: Column) -> Column:
    """true / false of a JSON boolean, of 0 or 1, or of one of the usual words, else NULL."""
    number = text.try_cast("double")
    word = dims.lookup({**dict.fromkeys(TRUE_TEXT, True), **dict.fromkeys(FALSE_TEXT, False)}, F.lower(text))
    return F.when(kind.isin(*NUMBER_KINDS), F.when(number == 1, True).when(number == 0, False)).when(kind.isin("STRING", "BOOLEAN"), word)


def _fields(names: list[str], kind: str) -> str:
    return f"struct<{', '.join(f'{f} {kind}' for f in names)}>"


def _surely_text(text: Column) -> Column:
    """Whether a member's text can only be that of a JSON string: numbers, booleans, lists and objects begin or read otherwise."""
    return ~F.substring(text, 1, 1).isin(*"-0123456789[{") & ~text.isin("true", "false", "Infinity")


def _regular_response() -> str:
    """Schemas of responses whose other members are plain values and whose issues are a list of objects that have only known
    fields, none of a wrong type: most responses."""
    texts, numbers = "|".join(f for f in ISSUE_FIELDS if f not in REQUIRED_TEXT + INTEGER_FIELDS), "|".join(INTEGER_FIELDS)
    field = f"(?:(?:{'|'.join(REQUIRED_TEXT)}): STRING|(?:{texts}): (?:STRING|VOID)|(?:{numbers}): (?:BIGINT|VOID))"
    member = r"\w++: (?:STRING|BOOLEAN|VOID|BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))"
    return f"^OBJECT<(?:{member}, )*+issues: ARRAY<OBJECT<{field}(?:, {field})*+>>(?:, {member})*+>$"


def _all_plain(issues: Column) -> Column:
    """Whether a list whose schema is regular holds no null that the schema hides behind the type of other issues (a null
    issue, a required text) and no number of more than 15 digits, which may be out of range."""
    odd = lambda x: (x.isNull() | F.greatest(*[x[f].isNull() for f in REQUIRED_TEXT])
                     | F.greatest(*[F.coalesce(F.length(x[f]) > 15, F.lit(False)) for f in INTEGER_FIELDS]))
    return ~F.exists(issues, odd)


def _plain_issues(issues: Column) -> Column:
    """The issues of a regular response in the shape of ``_raw_issues``."""
    return F.transform(issues, lambda x: F.struct(*[x[f].alias(f) for f in ISSUE_FIELDS], F.array().cast("array<string>").alias("wrong"), F.lit(True).alias("is_object")))


def _raw_issues(items: Column) -> Column:
    """Returned issues -> their fields as text, the names of fields of a wrong type, and whether each is an object.

    Every field is looked at on its own.  Lambda functions do not share repeated expressions."""
    walked = F.transform(items, lambda x: F.struct(x.alias("v"), F.try_variant_get(x, "$", _fields(ISSUE_FIELDS, "string")).alias("s")))

    def one(x: Column) -> Column:
        wrong = []
        for f in ISSUE_FIELDS:
            k = _kind(F.try_variant_get(x["v"], f"$.{f}", "variant"))
            ok = (k == "VOID") | _integer_ok(x["s"][f], k) if f in INTEGER_FIELDS else \
                k == "STRING" if f in REQUIRED_TEXT else k.isin("STRING", "VOID")
            wrong.append(F.when(~ok, F.lit(f)))
        return F.struct(*[x["s"][f].alias(f) for f in ISSUE_FIELDS], F.array_compact(F.array(*wrong)).alias("wrong"), x["s"].isNotNull().alias("is_object"))

    return F.transform(walked, one)


def parse_response(responses: DataFrame, text_col: str = "response", mode: str = "pr", summary_chars: int | None = None) -> DataFrame:
    """Review-level fields with the fallbacks and defaults applied (``findings.defaults``).

    Output adds: parse_status, summary, score_text, approval_recommended, stated_block, raw_issues and
    response_failure (why the response itself is invalid, NULL if it is not).  A missing field takes its
    default; an explicit null or a wrong type is a failure.  ``summary_chars`` cuts the summary taken
    from a response without JSON (whole by default).
    """
    df = _with_variant(responses, text_col)
    v = F.col("_v")
    ok = F.col("parse_status") == "ok"
    no_json = F.col("parse_status") == "no_json"
    # with no JSON object, or a malformed one, the variant is not used; one walk gives the texts of the members.  Kinds are asked for,
    # and the issues as a whole, which are as long as the response, made only where a text does not tell enough
    scalars = ["summary", "score", "approval_recommended", "block_merge"]
    member = lambda f, kind="variant": F.try_variant_get(v, f"$.{f}", kind)
    df = df.withColumns({"_top": F.when(ok, F.try_variant_get(v, "$", _fields(scalars, "string"))),
                         "_listed": ok & (member("issues[0].severity", "string").isNotNull() | member("issues[0]").isNotNull())})
    top = lambda f: F.col(f"_top.{f}")
    told = {"summary": F.when(_surely_text(top("summary")), F.lit("STRING")), "score": F.when(top("score").isin(*[str(n) for n in range(11)]), F.lit("BIGINT")),
            **{f: F.when(top(f).isin("true", "false"), F.lit("BOOLEAN")) for f in ("approval_recommended", "block_merge")}}
    df = df.withColumns({f"_{f}": F.struct(top(f).alias("t"), F.coalesce(told[f], _kind(F.when(ok, member(f)))).alias("k")) for f in scalars})
    issues = F.when(ok & ~F.col("_listed"), member("issues"))
    df = df.withColumn("_issues", F.struct(_text(issues).alias("t"), _kind(issues).alias("k")))
    # one schema and one walk give the issues of a regular response; only the others' are looked at field by field
    df = df.withColumn("_fast", F.when(F.col("_listed") & F.schema_of_variant(v).rlike(_regular_response()), member("issues", f"array<{_fields(ISSUE_FIELDS, 'string')}>")))
    plain = F.coalesce(_all_plain(F.col("_fast")), F.lit(False))
    df = df.withColumn("_items", F.when(ok & ~plain, member("issues", "array<variant>")))
    t = lambda f: F.col(f"_{f}.t")
    k = lambda f: F.col(f"_{f}.k")
    given = lambda f: k(f).isNotNull()
    # steps of their own: a long expression that stands in several places makes code too long for the JVM to compile
    df = df.withColumns({"_score_n": _integer(t("score")), **{f"_{f}_b": _boolean(t(f), k(f)) for f in ("approval_recommended", "block_merge")}})
    score_ok = k("score").isin(*NUMBER_KINDS, "STRING", "BOOLEAN") & F.col("_score_n").between(0, 10)
    # a block flag that is falsy counts as false, whatever its type
    empty = (k("block_merge") == "VOID") | (t("block_merge") == "") | ((k("block_merge").isin("ARRAY", "OBJECT")) & t("block_merge").isin("[]", "{}"))
    failure = (F.when(given("issues") & (k("issues") != "ARRAY") & ~((k("issues") == "STRING") & (t("issues") == ""))
                      & ~((k("issues") == "OBJECT") & (t("issues") == "{}")), "issues_not_list")
               .when(given("summary") & (k("summary") != "STRING"), "bad_summary")
               .when(given("score") & ~F.coalesce(score_ok, F.lit(False)), "bad_score")
               .when(given("approval_recommended") & F.col("_approval_recommended_b").isNull(), "bad_approval")
               .when(given("block_merge") & ~F.coalesce(empty, F.lit(False)) & F.col("_block_merge_b").isNull(), "bad_block"))
    cut = F.col(text_col) if summary_chars is None else F.substring(F.col(text_col), 1, summary_chars)
    return (df
            .withColumn("response_failure", F.when(ok, failure))
            .withColumn("summary", F.when(no_json, cut).when(~ok, F.lit(BAD_JSON_SUMMARY)).otherwise(F.coalesce(t("summary"), F.lit(DEFAULT_SUMMARY[mode]))))
            .withColumn("score_text", F.when(no_json, F.lit(str(NO_JSON_SCORE))).when(~ok, F.lit(str(BAD_JSON_SCORE)))
                        .otherwise(F.coalesce(t("score"), F.lit(str(DEFAULT_SCORE)))))
            .withColumn("approval_recommended", F.when(no_json, F.lit(NO_JSON_APPROVE)).when(~ok, F.lit(BAD_JSON_APPROVE))
                        .otherwise(F.coalesce("_approval_recommended_b", F.lit(True))))
            .withColumn("stated_block", F.when(ok, F.coalesce("_block_merge_b", F.lit(False))).otherwise(F.lit(False)))
            .withColumn("raw_issues", F.when(F.col("_items").isNull(), _plain_issues(F.col("_fast"))).otherwise(_raw_issues(F.col("_items"))))
            .drop("_v", "_top", "_listed", "_fast", "_items", "_score_n", "_approval_recommended_b", "_block_merge_b", *[f"_{f}" for f in [*scalars, "issues"]]))


def explode_issues(parsed: DataFrame, key: str = "review_id") -> DataFrame:
    """One row per returned issue object with its 1-based position; unknown fields are already dropped."""
    return (parsed
            .select(key, F.posexplode_outer("raw_issues").alias("pos0", "i"))
            .where("i.is_object")
            .select(key, (F.col("pos0") + 1).cast("int").alias("pos"),
                    *[F.col(f"i.{f}").alias(f) for f in ISSUE_FIELDS]))


# ------------------------------------------------------------------------------------------
# issue normalisation (order: synonyms -> slop cap -> critical prefix -> short-circuit)
# ------------------------------------------------------------------------------------------

def severity_normalized(raw: Column) -> Column:
    low = F.lower(raw)
    return F.coalesce(dims.lookup(dims.SEVERITY_SYNONYMS, low), low)


def normalize_severity(issues: DataFrame, src: str = "severity") -> DataFrame:
    """Lower-case + synonym map into ``severity``."""
    return issues.withColumn("severity", severity_normalized(F.col(src)))


def slop_capped(severity: Column, category: Column) -> Column:
    return F.when((category == "ai_slop") & severity.isin("critical", "high"), F.lit("medium")).otherwise(severity)


def cap_slop(issues: DataFrame) -> DataFrame:
    """``ai_slop`` issues never exceed medium (exact-case category test)."""
    return issues.withColumn("severity", slop_capped(F.col("severity"), F.col("category")))


def _starts_with_any(c: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def marked_critical(severity: Column, text: Column, prefixes: list[str], mark: str) -> Column:
    return F.when((severity == "critical") & ~_starts_with_any(F.coalesce(text, F.lit("")), prefixes),
                  F.concat(F.lit(mark), F.coalesce(text, F.lit("")))).otherwise(text)


def mark_critical(issues: DataFrame) -> DataFrame:
    """PR mode: prefix description and title of critical issues unless already prefixed."""
    sev = F.col("severity")
    return (issues.withColumn("description", marked_critical(sev, F.col("description"), CRITICAL_DESC_PREFIXES, CRITICAL_DESC_MARK))
            .withColumn("title", marked_critical(sev, F.col("title"), CRITICAL_TITLE_PREFIXES, CRITICAL_TITLE_MARK)))


def default_path(issues: DataFrame, file_col: str = "file") -> DataFrame:
    """File mode: an issue without a path gets the reviewed file's path."""
    return issues.withColumn("file_path", F.when(falsy(F.col("file_path")), F.col(file_col))
                             .otherwise(F.col("file_path")))


def is_compilation_critical(severity: Column, category: Column) -> Column:
    return (severity == "critical") & F.lower(F.coalesce(category, F.lit(""))).isin(*SHORT_CIRCUIT_CATEGORIES)


def short_circuit(issues: DataFrame, key: str = "review_id") -> DataFrame:
    """If a review has any critical compilation/syntax issue, keep only those (positions kept)."""
    flag = is_compilation_critical(F.col("severity"), F.col("category"))
    w = Window.partitionBy(key)
    return (issues
            .withColumn("_sc", F.max(flag.cast("int")).over(w) == 1)
            .filter(~F.col("_sc") | flag)
            .drop("_sc"))


# ------------------------------------------------------------------------------------------
# validation: one bad issue fails the whole review
# ------------------------------------------------------------------------------------------

def issue_failure(x: Column | dict[str, Column]) -> Column:
    """Reason code of an invalid normalised issue (severity, title, description, wrong), NULL when valid."""
    wrong = lambda f: F.array_contains(x["wrong"], f)
    out = (F.when(~F.coalesce(x["severity"].isin(*dims.SEVERITIES), F.lit(False)), F.lit("bad_severity"))
           .when(wrong("title"), F.lit("bad_title")).when(x["title"].isNull(), F.lit("missing_title"))
           .when(wrong("description"), F.lit("bad_description")).when(x["description"].isNull(), F.lit("missing_description")))
    others = [f for f in ISSUE_FIELDS if f not in ("severity", "title", "description")]
    return out.when(F.size(x["wrong"]) > 0, F.coalesce(*[F.when(wrong(f), F.lit(f"bad_{f}")) for f in others]))


def _fatal(x: Column, severity: Column) -> Column:
    """Faults that fail the review even where the short circuit would drop the issue."""
    wrong = lambda f: F.array_contains(x["wrong"], f)
    crit = severity == "critical"
    return (F.when(~x["is_object"], F.lit("issue_not_object"))
            .when(crit & wrong("description"), F.lit("bad_description")).when(crit & wrong("title"), F.lit("bad_title"))
            .when(crit & wrong("category"), F.lit("bad_category")))


def _with_severity(raw: Column) -> Column:
    """Raw issues -> (x: the issue, s: its severity after synonyms and the slop cap)."""
    # by steps of their own: a lambda function computes an expression wherever it stands in it
    normal = F.transform(raw, lambda x: F.struct(x.alias("x"), F.lower(x["severity"]).alias("s")))
    normal = F.transform(normal, lambda y: F.struct(y["x"].alias("x"), F.coalesce(dims.lookup(dims.SEVERITY_SYNONYMS, y["s"]), y["s"]).alias("s")))
    return F.transform(normal, lambda y: F.struct(y["x"].alias("x"), slop_capped(y["s"], y["x"]["category"]).alias("s")))


def _graded(raw: Column, mode: str) -> Column:
    """What counters and validation need of the normalised issues, without their texts."""

    def one(y: Column) -> Column:
        x, sev = y["x"], y["s"]
        # the mark of a critical issue stands for a text that is missing
        text = lambda f: F.when(sev == "critical", F.coalesce(x[f], F.lit(""))).otherwise(x[f]) if mode == "pr" else x[f]
        failure = issue_failure({"severity": sev, "title": text("title"), "description": text("description"), "wrong": x["wrong"]})
        return F.struct(sev.alias("severity"), F.coalesce(x["category"], F.lit("general")).alias("category"), x["owasp_id"].alias("owasp_id"), x["threat_type"].alias("threat_type"),
                        failure.alias("failure"), _fatal(x, sev).alias("fatal"), is_compilation_critical(sev, x["category"]).alias("circuit"))

    return F.transform(_with_severity(raw), one)


def normalized_issues(raw: Column, mode: str = "pr", file: Column | None = None) -> Column:
    """Array of raw issues -> array of normalised issues (synonyms, slop cap, critical marks, default path)."""

    def one(y: Column, i: Column) -> Column:
        x, sev = y["x"], y["s"]
        pr = mode == "pr"
        desc = marked_critical(sev, x["description"], CRITICAL_DESC_PREFIXES, CRITICAL_DESC_MARK) if pr else x["description"]
        title = marked_critical(sev, x["title"], CRITICAL_TITLE_PREFIXES, CRITICAL_TITLE_MARK) if pr else x["title"]
        path = F.when(falsy(x["file_path"]), file).otherwise(x["file_path"]) if not pr else x["file_path"]
        made = {"severity": sev, "title": title, "description": desc, "file_path": path,
                "category": F.coalesce(x["category"], F.lit("general")),
                **{f: _integer(x[f]) for f in INTEGER_FIELDS}}
        return F.struct((i + 1).cast("int").alias("pos"), *[made.get(f, x[f]).alias(f) for f in ISSUE_FIELDS],
                        is_compilation_critical(sev, x["category"]).alias("circuit"))

    return F.transform(_with_severity(raw), one)


# ------------------------------------------------------------------------------------------
# per-review rollup (derived counters always win)
# ------------------------------------------------------------------------------------------

def security_penalty(severity: Column) -> Column:
    return F.coalesce(dims.lookup(dims.SECURITY_PENALTY, severity), F.lit(0))


def rollup_aggs() -> list[Column]:
    sev = F.col("severity")
    sec = F.col("category") == "security"
    return [
        F.count(F.lit(1)).alias("total_issues"),
        *[F.count_if(sev == s).alias(f"{s}_count") for s in dims.SEVERITIES],
        F.count_if(F.col("category") == "ai_slop").alias("ai_slop_count"),
        F.count_if(sec).alias("security_issues_count"),
        F.sum(F.when(sec, security_penalty(sev)).otherwise(0)).alias("security_penalty"),
        F.max(F.coalesce(F.col("threat_type") == "secret_leak", F.lit(False))).alias("secret_leak_detected"),
        F.array_sort(F.collect_set(F.when(truthy(F.col("owasp_id")), F.col("owasp_id")))).alias("owasp_hits"),
    ]


ROLLUP_ZERO = {
    "total_issues": 0, **{f"{s}_count": 0 for s in dims.SEVERITIES}, "ai_slop_count": 0,
    "security_issues_count": 0, "security_penalty": 0, "secret_leak_detected": False,
}


def review_rollup(reviews: DataFrame, issues: DataFrame, key: str = "review_id", extra: list[Column] | None = None) -> DataFrame:
    """Per-review counters (and ``extra`` aggregates) left-joined to reviews (reviews without issues get zeros).

    The issues side is pre-aggregated to one row per review before the join, so the join is
    1:1 and no issue rows are shuffled twice.
    """
    agg = issues.groupBy(key).agg(*rollup_aggs(), *(extra or []))
    out = reviews.join(agg, key, "left")
    for c, z in ROLLUP_ZERO.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(z)))
    out = out.withColumn("owasp_hits", F.coalesce(F.col("owasp_hits"), F.array().cast("array<string>")))
    out = out.withColumn("ai_slop_detected", F.col("ai_slop_count") > 0)
    return out.withColumn("security_score", security_score_col())


def security_score_col() -> Column:
    """10 when there is no security issue, else max(0, 10 - penalty)."""
    return F.when(F.col("security_issues_count") == 0, F.lit(10)) \
        .otherwise(F.greatest(F.lit(0), F.lit(10) - F.col("security_penalty"))).cast("int")


def block_merge(stated: Column, critical_count: Column, mode: str = "pr") -> Column:
    """PR mode: stated block OR any critical issue; file mode: only if stated."""
    if mode == "file":
        return F.coalesce(stated, F.lit(False))
    return F.coalesce(stated, F.lit(False)) | (critical_count > 0)


def critical_block(issues: Column, description_chars: int | None = None) -> Column:
    """Numbered critical titles and descriptions of an issue array as text, NULL without a critical one.

    ``description_chars`` cuts the descriptions (whole by default)."""
    crit = F.filter(issues, lambda x: x["severity"] == "critical")
    whole = lambda x: F.coalesce(x["description"], F.lit(""))
    desc = whole if description_chars is None else lambda x: F.substring(whole(x), 1, description_chars)
    lines = F.transform(crit, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(x["title"], F.lit("Unknown issue")),
                                                    F.lit(" - "), desc(x), F.lit("...\n")))
    return F.when(F.size(crit) > 0, F.concat(F.lit("🚨 CRITICAL ERRORS FOUND ("), F.size(crit).cast("string"), F.lit("):\n"),
                                             F.array_join(lines, "")))


# ------------------------------------------------------------------------------------------
# the whole review pipeline, both modes
# ------------------------------------------------------------------------------------------

def _counted(issues: Column) -> dict[str, Column]:
    """The counters of ``rollup_aggs`` on an issue array."""
    n = lambda test: F.size(F.filter(issues, test)).cast("bigint")
    of_severity = lambda s: lambda x: x["severity"] == s
    security = F.filter(issues, lambda x: x["category"] == "security")
    return {
        "total_issues": F.size(issues).cast("bigint"),
        **{f"{s}_count": n(of_severity(s)) for s in dims.SEVERITIES},
        "ai_slop_count": n(lambda x: x["category"] == "ai_slop"),
        "security_issues_count": F.size(security).cast("bigint"),
        "security_penalty": F.aggregate(security, F.lit(0), lambda a, x: a + security_penalty(x["severity"])).cast("bigint"),
        "secret_leak_detected": F.exists(issues, lambda x: F.coalesce(x["threat_type"] == "secret_leak", F.lit(False))),
        "owasp_hits": F.array_sort(F.array_distinct(F.transform(F.filter(issues, lambda x: truthy(x["owasp_id"])), lambda x: x["owasp_id"]))),
    }


def review_responses(responses: DataFrame, mode: str = "pr", key: str = "review_id", file_col: str = "file",
                     description_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """responses(key, response[, file]) -> (reviews, issues) exactly as a reviewer would persist them.

    A review whose response or any kept issue is invalid becomes the fixed failure row (score 0, approval
    false, block true) with ``failure_reason`` and no issues.
    """
    df = parse_response(responses, mode=mode)
    df = df.withColumn("_graded", _graded(F.col("raw_issues"), mode)).drop("json_span")
    df = df.withColumn("_fatal", F.array_min(F.transform("_graded", lambda x: x["fatal"])))
    # pr mode: any critical compilation or syntax issue: keep only those, positions kept
    df = df.withColumn("_short", F.exists("_graded", lambda x: F.coalesce(x["circuit"], F.lit(False))) if mode == "pr" else F.lit(False))
    kept = lambda issues: F.when(F.col("_short"), F.filter(issues, lambda x: x["circuit"])).otherwise(issues)
    df = df.withColumn("_graded", kept(F.col("_graded")))
    reason = F.coalesce(F.when(F.col("response_failure") == "issues_not_list", F.col("response_failure")), F.col("_fatal"), F.col("response_failure"),
                        F.array_min(F.transform("_graded", lambda x: x["failure"])))
    df = df.withColumn("failure_reason", reason).drop("_fatal", "response_failure")
    failed = F.col("failure_reason").isNotNull()
    # the whole issues are made only where they, or the summary that names them, are read
    df = df.withColumn("issues", kept(normalized_issues(F.col("raw_issues"), mode, F.col(file_col) if mode != "pr" else None))).drop("raw_issues")
    valid = lambda c: F.coalesce(F.when(~failed, F.col(c)), F.from_json(F.lit("[]"), df.schema[c].dataType))
    df = df.withColumns({"issues": valid("issues"), "_graded": valid("_graded")}).drop("_short")
    summary = F.col("summary")
    if mode == "pr":
        block = critical_block(F.col("issues"), description_chars)
        summary = F.when(block.isNotNull(), F.concat(block, F.lit("\n"), summary)).otherwise(summary)
    df = df.withColumns({
        "score": F.when(failed, F.lit(0)).otherwise(_integer(F.col("score_text")).cast("int")),
        "summary": F.when(failed, F.lit(FAILED_SUMMARY)).otherwise(summary),
        "approval_recommended": F.when(failed, F.lit(False)).otherwise(F.col("approval_recommended")),
        "stated_block": failed | F.col("stated_block"),
        **_counted(F.col("_graded")),
    }).drop("_graded")
    df = df.withColumn("ai_slop_detected", F.col("ai_slop_count") > 0).withColumn("security_score", security_score_col())
    df = df.withColumn("block_merge", block_merge(F.col("stated_block"), F.col("critical_count"), mode))
    # an outer explode adds no filter that would repeat the parse below it
    issues = df.select(key, *([file_col] if mode != "pr" else []), F.explode_outer("issues").alias("i")).where("i is not null") \
        .select(key, *([file_col] if mode != "pr" else []), "i.pos", *[f"i.{f}" for f in ISSUE_FIELDS])
    return df.drop("issues"), issues


# ------------------------------------------------------------------------------------------
# status and views
# ------------------------------------------------------------------------------------------

STATUS_FAILURE_MSG = "Critical issues found - merge blocked"


def status(df: DataFrame) -> DataFrame:
    """Commit state, message and verdict from block flag and score."""
    blocked = F.col("block_merge")
    hi = F.col("score") >= 8
    return (df
            .withColumn("state", F.when(blocked, F.lit("failure")).otherwise(F.lit("success")))
            .withColumn("status_message",
                        F.when(blocked, F.lit(STATUS_FAILURE_MSG))
                        .when(hi, F.concat(F.lit("Code quality: "), F.col("score").cast("string"), F.lit("/10")))
                        .otherwise(F.concat(F.lit("Review complete: "), F.col("score").cast("string"), F.lit("/10"))))
            .withColumn("verdict", F.when(blocked, F.lit("BLOCKED")).when(hi, F.lit("APPROVED"))
                        .otherwise(F.lit("REVIEW NEEDED"))))


def platform_status(df: DataFrame, platform_col: str = "platform", state_col: str = "state") -> DataFrame:
    """Platform-specific commit status name (platforms without a mapping pass the state through)."""
    m = {f"{p}|{s}": v for p, d in dims.PLATFORM_STATUS.items() for s, v in d.items()}
    key = F.concat_ws("|", F.col(platform_col), F.col(state_col))
    return df.withColumn("platform_state", F.coalesce(dims.lookup(m, key), F.col(state_col)))


def security_view(issues: DataFrame, key: str = "review_id") -> tuple[DataFrame, DataFrame]:
    """Security-category issues and their per-review counts."""
    sec = issues.filter(F.col("category") == "security")
    counts = sec.groupBy(key).agg(
        F.count(F.lit(1)).alias("vulnerabilities_found"),
        F.count_if(F.col("severity") == "critical").alias("critical_count"),
        F.count_if(F.col("severity") == "high").alias("high_count"))
    return sec, counts
