"""A corpus pipeline of five stages: quality, line deduplication, near duplicates, decontamination, packing.

Each stage takes all that its predecessor kept; run() writes a stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.best_fit import best_fit
from loomstone.llm.decontam import decontaminate
from loomstone.llm.line_winnow import winnow_lines
from loomstone.llm.mil_quality import quality_scores
from loomstone.llm.parity_join import row_components
from loomstone.llm.queries import tokenizer_path
from loomstone.llm.tables import dropped, free, read, written
from loomstone.session import shipped


def _with_text(docs: DataFrame, changed, text) -> list:
    """The columns of docs with another text, and its length, where it changed."""
    new = {"text": F.when(changed, text).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return [new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go (score below 0.3).

    Null and empty texts are scored like any other, as one passage of zeros; very long ones by all their passages. Repeated rows and
    rows that share an id each have their own score; there are no ties to break. An empty table gives an empty one. Columns keep
    their names, whatever they are.
    """
    out = quality_scores(docs, read(spark, sf_dir, "labels"), carry=True)
    return out.where(F.col(out.columns[-1])["predicted"] == 1).select(*(F.col(f"`{c}`") for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of three lines, or of over 50 words, go; a document of which nothing is left goes.

    A null text is one empty line and stays null; very long texts are split whole. Of equal runs the one of smallest id, then
    earliest start, stays; rows that share id and text lose the same lines, others of one id are ordered by a hash of the text. An
    empty table gives an empty one. Columns keep their names, whatever they are.
    """
    out = winnow_lines(docs, carry=True, words=50)
    verdict = F.col(out.columns[-1])
    return out.where((verdict["n_removed"] == 0) | (F.length(verdict["kept_text"]) > 0)).select(*_with_text(docs, verdict["n_removed"] > 0, verdict["kept_text"]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id in each group of near duplicates stays, once.

    Rows that share id and text are one document. Of rows that share an id only, those whose text an earlier id has too go and the others
    stay; where no earlier id has either text they are one document, and a near copy of one text is one of both. A row without an id
    is in no group and stays; so does one whose text is null or has no words, once for each id. Very long texts are compared
    whole. An empty table gives an empty one. Columns keep their names, whatever they are.
    """
    id_, th, own = free("_id", docs), free("_th", docs), free("_own", docs)
    stay = row_components(docs).where("key IS NOT NULL AND component_id = key").select(F.col("key").alias(id_), F.col("th").alias(th)).distinct()
    marked = docs.where(F.col("doc_id").isNotNull()).withColumn(own, F.xxhash64("text"))
    once = marked.join(stay, (F.col("doc_id") == F.col(id_)) & (F.col(own) == F.col(th)), "left_semi").dropDuplicates(["doc_id", own])
    return once.select(*(F.col(f"`{c}`") for c in docs.columns)).union(docs.where(F.col("doc_id").isNull()))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go; from the others such passages are cut.

    A null or empty text has no words and stays; very long texts are scanned whole. Documents are judged one by one, so repeated rows
    fare alike and there are no ties. An empty table, or an empty benchmark, changes nothing. Columns keep their names, whatever
    they are.
    """
    out = decontaminate(docs, read(spark, sf_dir, "benchmark"), carry=True)
    verdict = F.col(out.columns[-1])
    out = out.where(~((verdict["n_hit"] > 0) & (20 * verdict["n_hit"] >= verdict["n_words"])))
    return out.select(*_with_text(docs, verdict["clean_text"].isNotNull(), verdict["clean_text"]))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 4096 tokens: one row for each piece, with doc_id, sequence_id and offset.

    A null text is empty, one token long; longer documents than a sequence are cut, nothing is dropped. Repeated rows and rows of one
    id are packed each; ties in length go by id. An empty table gives none. Other columns are never read.
    """
    return best_fit(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: Training and tokenising can't be stated in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Each result is written to the shared folder and read again, and the one before it deleted."""
    docs = read(shipped(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
