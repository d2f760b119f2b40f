"""Regular responses are typed by one schema; counters make no issue texts; what a schema of many issues hides is still found."""
import json

from reviewlake.operators import findings as Fd

GOOD = {"severity": "low", "title": "t", "description": "d", "category": "style", "file_path": None, "line_number": 7}


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "review_id long, response string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_less_is_made(spark):
    few = frame(spark, [json.dumps({"issues": [GOOD]})])
    assert "ArrayType(VariantType" not in plan(Fd.parse_response(few).select("summary", "response_failure"))
    reviews, issues = Fd.review_responses(few)
    assert "CRITICAL" not in plan(reviews.select("review_id", "critical_count", "failure_reason"))
    assert "CRITICAL" in plan(issues)


def test_what_the_schema_of_a_list_hides(spark):
    """Beside a good issue: a null issue, a null or missing required text, a number too long, another kind; odd members."""
    odd = [({"issues": [GOOD, None]}, [[], []], [True, False]),
           ({"issues": [GOOD, {**GOOD, "title": None}]}, [[], ["title"]], [True, True]),
           ({"issues": [GOOD, {"severity": "low", "title": "t"}]}, [[], []], [True, True]),
           ({"issues": [{**GOOD, "line_number": 10**17}, {**GOOD, "line_number": 10**19}]}, [[], ["line_number"]], [True, True]),
           ({"issues": [GOOD, {**GOOD, "cwe_id": 5}], "other": {"issues": [GOOD]}}, [[], ["cwe_id"]], [True, True]),
           ({"issues": [{**GOOD, "file_path": "x"}, {**GOOD, "line_number": None}]}, [[], []], [True, True]),
           ({"issues": []}, [], []), ({"issues": None}, None, None), ({"issues": {}}, None, None), ({}, None, None)]
    got = {r.review_id: r.raw_issues for r in Fd.parse_response(frame(spark, [json.dumps(o) for o, *_ in odd])).collect()}
    for i, (_, wrong, objects) in enumerate(odd):
        assert (got[i] is None) == (wrong is None), i
        assert wrong is None or ([x.wrong for x in got[i]] == wrong and [x.is_object for x in got[i]] == objects), (i, got[i])


def test_kinds_of_members(spark):
    """Texts that look like another kind, and other kinds that look like texts."""
    odd = [('{"summary":"5"}', None), ('{"summary":"true"}', None), ('{"summary":"[x"}', None), ('{"summary":""}', None), ('{"summary":5}', "bad_summary"), ('{"summary":true}', "bad_summary"),
           ('{"summary":null}', "bad_summary"), ('{"summary":["x"]}', "bad_summary"), ('{"summary":1e400}', "bad_summary"), ('{"score":"7"}', None), ('{"score":7.0}', None), ('{"score":11}', "bad_score"),
           ('{"score":true}', None), ('{"score":null}', "bad_score"), ('{"score":[7]}', "bad_score"), ('{"approval_recommended":"yes"}', None), ('{"approval_recommended":1}', None),
           ('{"approval_recommended":"1.0"}', "bad_approval"), ('{"approval_recommended":[true]}', "bad_approval"), ('{"block_merge":null}', None), ('{"block_merge":"maybe"}', "bad_block"),
           ('{"issues":"x"}', "issues_not_list"), ('{"issues":""}', None), ('{"issues":null}', "issues_not_list"), ('{"issues":{"a":1}}', "issues_not_list"), ('{"issues":[]}', None), ('{"issues":[null]}', None)]
    got = {r.review_id: r.response_failure for r in Fd.parse_response(frame(spark, [t for t, _ in odd])).collect()}
    assert [(odd[i][0], got[i]) for i in range(len(odd))] == odd
