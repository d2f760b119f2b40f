"""Responses are parsed once and typed by their schema; odd fields are still found one by one."""
import json

from reviewlake.operators import findings as Fd


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "review_id long, response string")


def test_spans(spark):
    texts = ["", "no", "{", "}", "}{", "a}b{c", "{}", "x {\"a\": 1} y", "é{\"a\":\n\"🚨\"}é}", "{{}", None]
    got = {r.review_id: (r.json_span, r.parse_status) for r in Fd.extract_json(frame(spark, texts)).collect()}
    none = (None, "no_json")
    assert [got[i] for i in range(len(texts))] == [none] * 6 + [("{}", "ok"), ('{"a": 1}', "ok"), ('{"a":\n"🚨"}é}', "ok"), ("{{}", "malformed"), none]


def test_kinds_of_odd_fields(spark):
    """A number where a text may be null, a text that is a number, a nested member with a regular look, unknown members."""
    good = {"severity": "low", "title": "t", "description": "d", "category": "style", "file_path": None, "line_number": 7}
    odd = [({}, []), ({"file_path": 5}, ["file_path"]), ({"title": None}, ["title"]), ({"line_number": "8"}, []), ({"line_number": 7.0}, []), ({"line_number": 7.5}, ["line_number"]),
           ({"line_number": 9223372036854775807}, ["line_number"]), ({"line_end": 10**16}, []), ({"line_end": []}, ["line_end"]), ({"other": {"title": 5}}, []), ({"title: STRING, cwe_id": 5}, []),
           ({"cwe_id": {"title": "x"}}, ["cwe_id"]), ({"category": True, "suggestion": 1}, ["category", "suggestion"])]
    texts = [json.dumps({"issues": [{**good, **o}, None, "x"]}) for o, _ in odd]
    parsed = Fd.parse_response(frame(spark, texts))
    got = {r.review_id: r.raw_issues for r in parsed.collect()}
    assert [sorted(got[i][0].wrong) for i in range(len(odd))] == [w for _, w in odd]
    assert all([x.is_object for x in got[i]] == [True, False, False] and got[i][1].wrong == [] for i in got)
    plan = Fd.review_responses(frame(spark, texts))[0].select("review_id", "owasp_hits")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") + plan.lower().count("parse_json(") == 1, plan
