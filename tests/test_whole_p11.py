"""The last head in every document, against rfind."""

from loomstone.plans import catalog

SF = "/root/testdata/sf0.001"


def test_last_head_of_all_documents(spark):
    got = {r.doc_id: r.head for r in catalog.QUERIES["p11_last_head"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    best = lambda t: max((t.rfind(h), h) for h in (" the ", " of "))
    assert got == {r.doc_id: best(r.text)[1] if best(r.text)[0] >= 0 else None for r in rows}
    assert any(" the the " in r.text or " of of " in r.text for r in rows)
