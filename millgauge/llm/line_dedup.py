"""Lines that many documents share, found by levelled sorted runs of line hashes.

Documents come in batches. A batch counts, for each of its lines, the documents that hold it; anti-joins
the lines that a run already shows to be frequent; and adds the rest as a sorted run of its own. When a
level holds ``fanout`` runs, they are merged into one run of the next level. In the end a line is frequent
if its counts over all runs reach the limit.

Lines are known by two 64-bit hashes with different seeds, and so are texts: copies of a text share their
rows from the start, so a large group of copies is one text with a count. Only DataFrame operations are
used; a text's own lines are the largest array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millgauge.sources.staged import cut_lineage, scratch

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashes(c: Column, a: str, b: str) -> list[Column]:
    return [F.xxhash64(c).alias(a), F.xxhash64(F.lit(1), c).alias(b)]


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z as a-z."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def merged(runs: list[DataFrame]) -> DataFrame:
    """One run with the counts of several, and the earliest holder of each line."""
    both = reduce(DataFrame.unionByName, runs)
    return both.groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.min("first").alias("first"))


def frequent_lines(lines: DataFrame, batches: int, fanout: int, min_docs: int) -> DataFrame:
    """(a, b, first) of the lines that at least ``min_docs`` documents hold.

    ``lines`` has one row per text and line, with a batch number. ``first`` is the smallest document of the
    earliest batch with the line.
    """
    levels: list[list[DataFrame]] = [[]]
    for batch in range(batches):
        own = (
            lines.where(F.col("batch") == batch)
            .groupBy("a", "b")
            .agg(F.sum("docs").alias("docs"), F.min(F.struct("batch", "doc")).alias("first"))
        )
        held = [run for level in levels for run in level]
        if held:
            settled = reduce(DataFrame.unionByName, held).where(F.col("docs") >= min_docs).select("a", "b")
            own = own.join(settled.distinct(), ["a", "b"], "left_anti")
        levels[0].append(cut_lineage(own.sortWithinPartitions("a", "b"), "run"))
        for k, level in enumerate(levels):
            if len(level) == fanout:
                if k + 1 == len(levels):
                    levels.append([])
                levels[k + 1].append(cut_lineage(merged(level).sortWithinPartitions("a", "b"), "run"))
                level.clear()
    return merged([run for level in levels for run in level]).where(F.col("docs") >= min_docs)


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    keep_first: bool = False,
    batches: int = 4,
    fanout: int = 2,
) -> DataFrame:
    """The rows of ``docs`` as a struct ``row``, with ``kept_text``, ``n_lines`` and ``n_dropped``.

    A line whose key has at least ``min_chars`` code points and occurs in at least ``min_docs`` rows loses
    all its occurrences, or, with ``keep_first``, those outside the document that had it first (in the
    earliest batch, the smallest id). Defined results: null or empty text is one empty line and keeps its
    value; every row counts as a document, repeated rows too; a null id counts as a hash of its text; an
    empty table gives an empty table; other columns stay in ``row``, whatever their names.
    """
    text = F.col(text_col).cast("string")
    doc = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("doc")
    placed = docs.where(text.isNotNull()).select(
        doc, *hashes(text, "t1", "t2"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")
    )
    key = line_key(F.col("line"))
    lines = (
        placed.where(F.length(key) >= min_chars)
        .select("t1", "t2", "doc", "pos", *hashes(key, "a", "b"))
        .groupBy("t1", "t2", "a", "b")
        .agg(F.collect_set("pos").alias("places"), F.count("*").alias("found"), F.min("doc").alias("doc"))
        .select(
            "t1", "t2", "a", "b", "places", "doc",
            (F.col("found") / F.size("places")).cast("long").alias("docs"),
            F.pmod("t1", F.lit(batches)).cast("int").alias("batch"),
        )
    )
    path = scratch(docs.sparkSession, "lines")
    lines.write.partitionBy("batch").parquet(path)
    lines = docs.sparkSession.read.schema(lines.schema).parquet(path)
    frequent = cut_lineage(frequent_lines(lines, batches, fanout, min_docs), "frequent")
    gone = (
        lines.join(frequent.select("a", "b", F.col("first.doc").alias("first")), ["a", "b"])
        .groupBy("t1", "t2")
        .agg(F.collect_list(F.struct("places", "first")).alias("gone"))
    )
    # Written, so that the join below has a shuffle of its own, which Spark can split at a text with many copies.
    gone = cut_lineage(gone, "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc, *hashes(text, "t1", "t2"), F.split(text, "\n", -1).alias("lines"))
    met = rows.join(gone, ["t1", "t2"], "left")
    lost = F.col("gone")
    if keep_first:
        lost = F.filter(lost, lambda g: g["first"] != F.col("doc"))
    lost = F.flatten(F.transform(lost, lambda g: g["places"]))
    met = met.select("row", "lines", F.coalesce(lost, F.array().cast("array<int>")).alias("lost"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    return met.select(
        "row",
        F.array_join(F.transform(left, lambda k: F.col("lines")[k]), "\n").alias("kept_text"),
        F.coalesce(F.size("lines"), F.lit(1)).cast("long").alias("n_lines"),
        F.size("lost").cast("long").alias("n_dropped"),
    )
