"""Shared prefixes of whole texts, against a plain comparison."""

import os

from loomstone.plans import catalog

SF = "/root/testdata/sf0.001"


def test_shared_prefix_of_whole_texts(spark):
    got = {r.doc_id: r.n for r in catalog.QUERIES["sc23_shared_prefix"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r.doc_id: len(os.path.commonprefix([r.text, r.text.replace("and", "end")])) for r in rows}
    assert max(got.values()) > 60
