"""Fenced blocks of many lines."""

import hashlib

from loomstone.plans import catalog

SF = "/root/testdata/sf0.001"


def test_fenced_blocks_of_whole_texts(spark):
    got = {r.doc_id: r.h for r in catalog.QUERIES["sc19_fenced_block"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert not any("```" in r.text for r in rows)
    raw = lambda r: (r.text, f"a {r.text}", f"```\n{r.text}\n```\n```\nb\n```", f"so ```\n{r.text}``` it is", f"```python\n{r.text}\n```")[r.doc_id % 5]
    assert got == {r.doc_id: hashlib.md5(raw(r).strip().encode()).hexdigest() for r in rows}
    assert any("\n" in r.text for r in rows if r.doc_id % 5 == 0)
