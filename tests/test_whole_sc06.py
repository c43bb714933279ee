"""Directives glued anywhere in a text, against re."""

import hashlib
import re

from loomstone.plans import catalog

SF = "/root/testdata/sf0.001"


def test_directives_of_whole_texts(spark):
    got = {r.doc_id: (r.h, r.changed) for r in catalog.QUERIES["sc06_unglue"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    glued, late = re.compile(r'([A-Za-z0-9_">)])(#[ \t]*(?:define|include|ifdef|ifndef|endif|pragma|undef)\b)', re.A), 0
    for r in rows:
        c = r.text.replace(". ", ">#include ").replace(", ", "#if ").replace("\r\n", "\n").strip()
        out = glued.sub("\\1\n\\2", c)
        assert got[r.doc_id] == (hashlib.md5(out.encode()).hexdigest(), out != c)
        late += glued.search(c, 400) is not None
    assert late and len(got) == len(rows)
