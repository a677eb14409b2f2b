"""Documents to packed training sequences: quality, lines, near-duplicates, mixture, packing.

Every stage takes all that its predecessor kept and returns documents, the last one packed pieces. Defined
results for all stages: null texts count as empty; an empty table gives an empty table; columns beyond those of
documents are carried along by all stages but the last and clash with nothing; every stage says what it
does with null ids and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millgauge.llm.line_dedup import dedup_lines
from millgauge.llm.mixing import mixed_documents
from millgauge.llm.near_dup import near_duplicates
from millgauge.llm.packing import pack
from millgauge.llm.quality import keep_good
from millgauge.llm.queries import fold, tokenizer
from millgauge.sources.staged import cut_lineage

#: Lines that this many documents share stay in the first of them alone.
LINE_DOCS = 10

#: Training order and sampling have no SQL form.
ORACLE_SQL = None


def with_text(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The documents in the struct ``row`` with another text, and n_chars to match."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts; it learns from the same labels as its query.

    Rows are judged by their text alone, so a null id changes nothing and repeated rows share their fate.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.coalesce(fold(5) != 0, F.lit(False)))
    return keep_good(docs, labels)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that another one had first; one that loses all its words goes.

    Every row counts as a document, also repeated ones; of ten or more copies the first alone keeps its lines. A row
    that lost nothing stays, even an empty one.
    """
    kept = dedup_lines(docs, min_docs=LINE_DOCS, keep_first=True)
    kept = kept.where((F.col("n_dropped") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return with_text(kept, "kept_text", docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates: five-word shingles, similarity 0.8 or more.

    The smallest id of a group stays. Rows without an id go by a number made of their text, larger than
    any id, so they are compared like others. Of rows that share an id (or have none) and a text one stays; rows of
    one id with other texts stay together or go together. Texts without words are alike with nothing.
    """
    number = F.lit(1 << 62) + F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1))
    key = F.coalesce(F.col("doc_id").cast("long"), number)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"), "text")
    found = near_duplicates(keyed, "key", "text", shingle_words=5, percent=80)
    marks = found.groupBy("key").agg(F.bool_or(~F.col("kept")).alias("gone"), F.count("*").alias("n"))
    marks = cut_lineage(marks.where("gone or n > 1"), "marks")
    single = keyed.join(marks, "key", "left_anti").select("row")
    again = keyed.join(marks.where("not gone"), "key", "left_semi").withColumn("digest", F.sha2("text", 256))
    return single.unionByName(again.dropDuplicates(["key", "digest"]).select("row")).select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the target weights of their sources ask for.

    Null is a source like any other; null ids and repeated rows are documents of their own.
    """
    return mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids in windows of 2,048.

    Null ids are kept as they are; repeated rows are packed as often as they occur.
    """
    return pack(docs, tokenizer())


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
