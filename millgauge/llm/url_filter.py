"""Verdicts on web addresses: fixed rules, and a path-template tree with labelled purity.

Each host has a tree of path segments. From the top down, a segment is a branch if enough addresses share
it; all other siblings are one wildcard branch. Branches in the order of their share of good labels are
merged into groups: one joins the group before it unless it differs by more than chance (a two-proportion
test) from the group as a whole, its first or its largest branch. A branch
merged with the wildcard is part of it, others are named by their first and last segment. An address belongs to the
template that its segments lead to. The purity of a template is the share of good labels, smoothed towards its host and that
towards the whole; templates under the limit are rejected.

Addresses are counted once per host and path before the tree is built. A level takes one aggregation and
joins with the named segments and with the nodes that can have any, of which no list is held anywhere, so a
host with a third of all pages is no special case. Levels go on until no path has a further segment below a
node with enough addresses and a label.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millgauge.sources.staged import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Addresses that a branch needs, and the test's limit in deviations.
SUPPORT, DEVIATIONS = 20, 1.96
#: Labels that the purity of the next larger set counts for, and the least accepted purity.
STRENGTH, PURITY = 10.0, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z as a-z) and path; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls. A rule is (verdict, ``host/path``)."""
    name = verdict = F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: len(r[1])):
        own, slash, start = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + start))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def like(good: int, bad: int, other_good: int, other_bad: int) -> bool:
    """Do two shares of good labels differ by no more than chance?"""
    n, m = good + bad, other_good + other_bad
    pooled, gap = (good + other_good) / (n + m), good / n - other_good / m
    return gap * gap <= DEVIATIONS**2 * pooled * (1 - pooled) * (1 / n + 1 / m)


def groups(counts: DataFrame) -> DataFrame:
    """(host, template, good, bad, group) of (host, template, good, bad, k): k branches of a node with these labels.

    From the lowest share upwards, a branch joins the group if it is like all that the group has so far, like
    its first and like its largest branch; else it begins the next group. Branches with equal labels are one
    row, so a node with L labels has fewer than (3 L) ** (2 / 3) rows, which are read one after the other.
    """

    def fold(batches):
        node = group = first = largest = pool = None
        for batch in batches:
            found = []
            for host, template, good, bad, k in zip(*(c.to_pylist() for c in batch.columns)):
                own, fresh = (good, bad), (host, template) != node
                if not fresh and all(like(*own, *other) for other in (pool, first, largest)):
                    pool = (pool[0] + k * good, pool[1] + k * bad)
                    largest = max(largest, own, key=sum)
                else:
                    group = 0 if fresh else group + 1
                    node, first, largest, pool = (host, template), own, own, (k * good, k * bad)
                found.append(group)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.int64())], names=["host", "template", "good", "bad", "group"])

    total = F.col("good") + F.col("bad")
    line = counts.select("host", "template", "good", "bad", "k").repartition("host", "template")
    line = line.sortWithinPartitions("host", "template", F.col("good") / total, total)
    return line.mapInArrow(fold, "host string, template string, good long, bad long, group long")


def branches(children: DataFrame, support: int) -> DataFrame:
    """(host, template, segment, name) of the segments that are not in the wildcard branch of their node."""
    node, labelled = ["host", "template"], F.col("good") + F.col("bad") > 0
    named = children.withColumn("branch", F.when((F.col("n") >= support) & labelled, F.col("segment")))
    merged = named.groupBy(*node, "branch").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).where(labelled)
    counts = merged.groupBy(*node, "good", "bad").agg(F.count("*").alias("k"))
    members = cut_lineage(merged.join(groups(counts), [*node, "good", "bad"]).select(*node, "group", "branch"), "members")
    least, most, size = F.min("branch"), F.max("branch"), F.count("*")
    between = F.when(size > 2, F.concat(F.lit("|.."), size - 2, F.lit(".."))).otherwise("")
    name = F.when(size == 1, least).otherwise(F.concat(F.lit("{"), least, between, F.lit("|"), most, F.lit("}")))
    names = members.groupBy(*node, "group").agg(name.alias("name"), F.count_if(F.col("branch").isNull()).alias("wild"))
    found = members.join(names.where("wild = 0"), [*node, "group"])
    return found.select(*node, F.col("branch").alias("segment"), "name")


def templates(paths: DataFrame, depth: int | None = None, support: int = SUPPORT) -> DataFrame:
    """(host, path, n, good, bad) with the template of each path.

    With ``depth`` what lies below that many segments is one last wildcard; else every segment counts.
    """
    state = paths.withColumn("segments", F.slice(F.split("path", "/"), 2, 1 << 30)).withColumn("template", F.lit(""))
    size = F.size("segments")
    last = size if depth is None else F.least(size, F.lit(depth))
    tail = F.lit("") if depth is None else F.when(size > depth, "/**").otherwise("")
    columns = ["host", "path", "n", "good", "bad"]
    done, level = [state.where(last == 0).select(*columns, tail.alias("template"))], 0
    active = state.where(last > 0)
    while not active.isEmpty():
        active = active.withColumn("segment", F.get("segments", F.lit(level)))
        children = cut_lineage(
            active.groupBy("host", "template", "segment").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")),
            "children",
        )
        # Below other nodes no segment can be a branch, at any depth, so the rest of their paths is known.
        nodes = children.groupBy("host", "template").agg(F.sum("n").alias("all"), F.sum(F.col("good") + F.col("bad")).alias("labels"))
        nodes = nodes.where((F.col("all") >= support) & (F.col("labels") > 0)).select("host", "template", F.lit(True).alias("open"))
        joined = active.join(branches(children, support), ["host", "template", "segment"], "left").join(nodes, ["host", "template"], "left")
        step = F.when(F.col("open"), F.concat(F.lit("/"), F.coalesce("name", F.lit("*")))).otherwise(F.repeat(F.lit("/*"), last - level))
        ends = F.col("open").isNull() | (last == level + 1)
        stepped = joined.select(*columns, "segments", F.concat("template", step).alias("template"), ends.alias("ends"))
        state = cut_lineage(stepped, "level")
        done.append(state.where("ends").select(*columns, F.concat("template", tail).alias("template")))
        active, level = state.where("not ends").drop("ends"), level + 1
    return reduce(DataFrame.unionByName, done)


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    key: Column | None = None,
    label_key: str = "doc_id",
    label_col: str = "quality",
    purity: float = PURITY,
    strength: float = STRENGTH,
) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) of every row of ``pages``.

    ``key`` is what links a page to its label, over the columns host and path; else the page's id. Defined
    results: a null url or one without ``://`` has an empty host and path and the verdict of their template;
    without labels every template has purity 0.5 (or that of all labels) and is judged by that; a label
    above 0.5 is good, several of one key count with their mean; null keys and labels count as none;
    repeated rows are judged alike; an empty table gives an empty table; other columns are ignored.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rows = cut_lineage(rows.withColumn("key", F.col("id") if key is None else key), "pages")
    marks = labels.select(F.col(label_key).alias("key"), F.col(label_col).cast("double").alias("y"))
    marks = marks.where("key is not null and y is not null").groupBy("key").agg((F.avg("y") > 0.5).alias("good"))
    known = rows.where("key is not null").join(marks, "key").groupBy("host", "path").agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    )
    counts = rows.groupBy("host", "path").agg(F.count("*").alias("n")).join(known, ["host", "path"], "left")
    counts = cut_lineage(counts.na.fill(0, ["good", "bad"]), "paths")
    placed = templates(counts)
    good, bad = counts.agg(F.sum("good"), F.sum("bad")).first()
    base = good / (good + bad) if good or bad else 0.5

    def smoothed(prior: Column) -> Column:
        return (F.col("good") + strength * prior) / (F.col("good") + F.col("bad") + strength)

    sums = [F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    of_host = counts.groupBy("host").agg(*sums).select("host", smoothed(F.lit(base)).alias("prior"))
    of_template = placed.groupBy("host", "template").agg(*sums).join(of_host, "host").select("host", "template", smoothed(F.col("prior")).alias("purity"))
    found = placed.select("host", "path", "template").join(of_template, ["host", "template"])
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(said, F.when(F.col("purity") < purity, "block").otherwise("allow"))
    return rows.join(found, ["host", "path"]).select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"), "template", "purity"
    )
