"""Bare answers, broken ones among them, against json."""

import json

from loomstone.functions import parse
from loomstone.plans import catalog

SF = "/root/testdata/sf0.001"


def bare(raw):
    try:
        checks = json.loads(raw).get("checks")
    except (ValueError, AttributeError):
        return None
    return sorted({c for c in checks if isinstance(c, str)}) if isinstance(checks, list) else None


def test_all_answers(spark):
    got = {r.doc_id: r.checks for r in catalog.QUERIES["sc11_answer_bare"](spark, SF).collect()}
    assert got == {r.doc_id: bare(r.raw) for r in spark.table("answers").collect()} and None in got.values()


def test_no_whole_object(spark):
    texts = ['{"checks": ["a"]', 'so {"checks": ["a"]}', '{"checks": ["a"]} tail', '{"checks": ["a"]} {"b": 1}', '{"checks": ["a"]}, 1', '[1]', "", '{"checks": ["b", 3, "a"]}', ' {"checks": []} ']
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", parse.checks_bare("s").alias("c")).collect()
    assert {r.s: r.c for r in got} == {t: bare(t) for t in texts}
