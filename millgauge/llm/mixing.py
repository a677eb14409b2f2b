"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources get token targets by weight, held under a multiple of their size. The targets, counted in blocks
of equal tokens, go to the sources by the highest quotients target / (2 k + 1), and a source's blocks to
its shards in the same way by the blocks they hold. A shard is cut into equal blocks of at most ``block``
tokens. It takes whole passes over its blocks for as often as its quota
holds them all, and for the rest a run of blocks from a seeded place on; its documents lie in an order
seeded by hash, so the run is a random choice that cuts at most two documents.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from millgauge.sources.staged import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: Share of the whole corpus that is taken, and how often one document may be.
SHARE, REPEATS = 1.5, 2
#: Most tokens in a block, rows in a shard (speed only).
BLOCK, SHARD_ROWS = 16, 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sainte_lague(weights: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients weight / (2 k + 1), at most ``most`` each; ties to the earlier."""
    weights, most = np.asarray(weights, float), np.asarray(most, np.int64)
    seats = min(int(seats), int(most[weights > 0].sum()))

    def given(quotient: float) -> np.ndarray:
        """How many quotients of each exceed this one."""
        return np.minimum(np.ceil((weights / quotient - 1) / 2).astype(np.int64), most)

    if seats <= 0:
        return np.zeros(len(weights), np.int64)
    low, high = weights[weights > 0].min() / (4.0 * seats + 4), weights.max() * 2
    while given(low).sum() < seats:
        low /= 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (low, middle) if given(middle).sum() <= seats else (middle, high)
    out = given(high)
    heap = [(-w / (2 * k + 1), i) for i, (w, k, m) in enumerate(zip(weights, out, most)) if w > 0 and k < m]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


def targets(sources: DataFrame, weights: Sequence[float], share: float, repeats: float) -> DataFrame:
    """``sources`` (source, source_size) with the target of each.

    Sources by code point, null last, weigh the given weights in turn. What a source cannot take is
    shared by weight among those that still can, until none is over its limit.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = cut_lineage(sources.withColumn("weight", turn[F.pmod(place, F.lit(len(weights)))]), "weighed")
    limit = F.col("source_size") * float(repeats)
    total, weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level, full = share * (total or 0), None, -1
    while True:
        over = F.lit(False) if level is None else limit <= F.lit(level) * F.col("weight")
        row = weighed.agg(
            F.count_if(over), F.sum(F.when(over, limit).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))
        ).first()
        if row[0] == full or not row[2]:
            level = math.inf if row[0] and not row[2] else level
            break
        full, level = row[0], (budget - row[1]) / row[2]
    share_of = limit if level is None or level == math.inf else F.least(limit, F.lit(level) * F.col("weight"))
    return weighed.withColumn("target", share_of)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = SHARE,
    repeats: int = REPEATS,
    block: int = BLOCK,
    shard_rows: int = SHARD_ROWS,
    seed: int = 7,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` as a struct ``row`` (the columns ``carry``, else all) with what the mix takes.

    size, source, source_size, target; passes (whole copies taken); from_1, to_1, from_2, to_2 (words
    of one further partial copy, as two ranges); taken (words in all). Defined results: null text has no
    words and is not taken; null is a source like any other, the last; repeated rows are separate
    documents; equal rows may change places; an empty table gives an empty table; other columns stay in
    ``row``.
    """
    carry = docs.columns if carry is None else carry
    text = F.col(text_col).cast("string")
    order = F.xxhash64(F.lit(seed), F.col(id_col), text)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text).alias("size"),
        order.alias("order"),
    )
    if list(carry) == [id_col]:
        rows = cut_lineage(rows, "sized")
        sizes = rows
    else:
        sizes = cut_lineage(rows.select("source", "size", "order"), "sized")
    shards = max(1, math.ceil(sizes.count() / shard_rows))
    shard = F.pmod("order", F.lit(shards)).alias("shard")
    cells = cut_lineage(
        sizes.groupBy("source", shard).agg(F.sum("size").alias("cell_size")).withColumn("held", F.ceil(F.col("cell_size") / block)), "cells"
    )
    of_source = cells.groupBy("source").agg(F.sum("cell_size").alias("source_size"), F.sum("held").alias("held"))
    sources = targets(of_source, weights, share, repeats)

    def to_sources(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("source", na_position="last", kind="stable")
        held = group["held"].to_numpy(np.int64)
        want = group["target"].to_numpy(float) / np.maximum(group["source_size"], 1).to_numpy(float) * held
        group["blocks"] = sainte_lague(want, int(want.sum() + 0.5), repeats * held)
        return group[["source", "source_size", "target", "blocks"]]

    def to_shards(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        held = group["held"].to_numpy(np.int64)
        group["quota"] = sainte_lague(held.astype(float), int(group["blocks"].iloc[0]), repeats * held)
        return group[["source", "shard", "cell_size", "source_size", "target", "held", "quota"]]

    shared = sources.groupBy(F.lit("all").alias("all")).applyInPandas(
        lambda g: to_sources(g), "source string, source_size long, target double, blocks long"
    )
    same = cells["source"].eqNullSafe(shared["source"])
    given = cells.join(shared, same).drop(shared["source"]).groupBy("source").applyInPandas(
        lambda g: to_shards(g),
        "source string, shard long, cell_size long, source_size long, target double, held long, quota long",
    )
    given = cut_lineage(given, "quotas")
    line = Window.partitionBy("source", "shard").orderBy("order", "size")
    placed = rows.withColumn("shard", shard).withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    both = placed.alias("p").join(
        given.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source")) & (F.col("p.shard") == F.col("g.shard"))
    )
    blocks = F.greatest("held", F.lit(1))
    begin = F.col("end") - F.col("size")
    spans = both.select(
        "row", "p.source", "size", "source_size", "target", "end", begin.alias("begin"), "cell_size",
        blocks.alias("blocks"), "quota", F.col("p.shard").alias("shard"),
    ).select(
        "row", "source", "size", "source_size", "target", "begin",
        (F.floor(F.col("quota") / F.col("blocks"))).cast("long").alias("passes"),
        (F.col("quota") % F.col("blocks")).alias("rest"),
        F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.col("blocks")).alias("first"), "blocks", "cell_size",
    )

    def within(number: Column) -> Column:
        """The word of this document at which a block begins, held between its ends."""
        words = number * F.col("cell_size")
        place = ((words - words % F.col("blocks")) / F.col("blocks")).cast("long")
        return F.least(F.greatest(place - F.col("begin"), F.lit(0)), F.col("size")).cast("long")

    run = F.col("first") + F.col("rest")
    out = spans.select(
        "row", "source", "size", "source_size", "target", "passes",
        within(F.col("first")).alias("from_1"), within(F.least(run, F.col("blocks"))).alias("to_1"),
        within(F.lit(0)).alias("from_2"), within(F.greatest(run - F.col("blocks"), F.lit(0))).alias("to_2"),
    )
    taken = F.col("passes") * F.col("size") + F.col("to_1") - F.col("from_1") + F.col("to_2") - F.col("from_2")
    return out.withColumn("taken", taken)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents of the mix: every row of ``docs`` as often as it is taken, a cut one with its words alone.

    White space inside a cut text stays as it is. The columns are those of ``docs``.
    """
    spans = mix(docs, id_col, text_col, **options)
    words = F.regexp_extract_all(F.col("row")[text_col], F.lit(rf"[\x20\x09-\x0D]*{WORD}"), 0)
    part = F.concat(
        F.slice("words", F.col("from_2") + 1, F.greatest(F.col("to_2") - F.col("from_2"), F.lit(0))),
        F.slice("words", F.col("from_1") + 1, F.greatest(F.col("to_1") - F.col("from_1"), F.lit(0))),
    )
    extra = F.col("taken") - F.col("passes") * F.col("size")
    cut = spans.where(extra > 0).withColumn("words", words).select("row", F.array_join(part, "").alias("text"))
    whole = spans.where("passes > 0 and size > 0").select(
        F.explode(F.array_repeat("row", F.col("passes").cast("int"))).alias("row"), F.col(f"row.{text_col}").alias("text")
    )
    both = whole.unionByName(cut)
    return both.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
