"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) are taken from large to small; each enters the bin with the least room that still
holds it. The bins lie in a balanced tree by their room. Only the few groups above a thousandth of a bin
are packed in one task, at most a thousand per bin; all others are packed in parallel parts of bounded
size, each into its share of the room that the large ones leave. A group above the capacity is the one
thing that is split, by rows.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from millgauge.llm.packing import running
from millgauge.sources.staged import cut_lineage

#: A group above this part of a bin is packed with the other large ones.
LARGE = 1_000
#: Groups in a parallel part, rows in a numbering range (speed only).
PART_GROUPS, RANGE_ROWS = 50_000, 50_000


class RoomTree:
    """Bins by their room: a two-level balanced tree, whose leaves are split when they fill."""

    LEAF = 64

    def __init__(self) -> None:
        self.leaves: list[list[tuple]] = [[]]
        self.lasts: list[tuple] = []

    def add(self, room, number: int) -> None:
        item = (room, number)
        k = min(bisect.bisect_left(self.lasts, item), len(self.leaves) - 1)
        leaf = self.leaves[k]
        bisect.insort(leaf, item)
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[k : k + 1] = [leaf[:half], leaf[half:]]
            self.lasts = [x[-1] for x in self.leaves]
        elif not self.lasts:
            self.lasts = [item]
        else:
            self.lasts[k] = leaf[-1]

    def _take(self, k: int, at: int) -> tuple:
        item = self.leaves[k].pop(at)
        if self.leaves[k]:
            self.lasts[k] = self.leaves[k][-1]
        elif len(self.leaves) > 1:
            del self.leaves[k], self.lasts[k]
        else:
            self.lasts = []
        return item

    def take_fitting(self, size) -> tuple | None:
        """Remove and return the bin with the least room of at least ``size``."""
        k = bisect.bisect_left(self.lasts, (size, -1))
        if k == len(self.lasts):
            return None
        return self._take(k, bisect.bisect_left(self.leaves[k], (size, -1)))

    def take_widest(self) -> tuple:
        return self._take(len(self.leaves) - 1, -1)


def best_fit_decreasing(sizes: np.ndarray, rooms: list | None = None, capacity: int | None = None) -> tuple[np.ndarray, list]:
    """The bin of each size, and the room left in every bin.

    With ``rooms`` the bins are given, and what fits none of them enters the widest. With ``capacity`` as
    many bins of it are opened as are needed, a larger size in one of its own.
    """
    tree, left = RoomTree(), list(rooms or [])
    for number, room in enumerate(left):
        tree.add(room, number)
    out = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-np.asarray(sizes), kind="stable"):
        size = sizes[i]
        found = tree.take_fitting(size)
        if found is None and capacity is not None:
            found = (max(capacity, size), len(left))
            left.append(found[0])
        room, number = found or tree.take_widest()
        out[i], left[number] = number, room - size
        tree.add(room - size, number)
    return out, left


def balanced_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24) -> DataFrame:
    """The rows of ``docs`` (id, size, text_crc32) with shard and slot; shards hold near equal bytes.

    A row weighs the bytes of its text plus 8. Rows with equal text share a shard, unless they outweigh
    one. Defined results: null text is an empty one; a null id is an id like others; repeated rows are
    rows of their own; an empty table gives an empty table; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = cut_lineage(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("g1"),
            F.xxhash64(F.lit(1), text).alias("g2"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "rows",
    )
    count, total = rows.agg(F.count("*"), F.sum("size")).first()
    capacity = math.ceil((total or 0) / shards)
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"))
    # At most one in a shard, so the table has no more rows than there are shards.
    over = groups.where(F.col("bytes") > capacity).select("g1", "g2", F.ceil(F.col("bytes") * 4 / max(capacity, 1)).alias("chunks"))
    chunk = F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), F.col("chunks")))
    rows = rows.join(F.broadcast(over), ["g1", "g2"], "left").withColumn("chunk", chunk.cast("long"))
    items = cut_lineage(rows.groupBy("g1", "g2", "chunk").agg(F.sum("size").alias("bytes")), "items")
    large = F.col("bytes") * LARGE > capacity

    def pack_large(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bytes", "g1", "g2", "chunk"], ascending=[False, True, True, True])
        group["shard"], _ = best_fit_decreasing(group["bytes"].to_numpy(), [capacity] * shards)
        return group[["g1", "g2", "chunk", "bytes", "shard"]]

    kind = "g1 long, g2 long, chunk long, bytes long, shard long"
    first = cut_lineage(items.where(large).groupBy(F.lit("all").alias("all")).applyInPandas(lambda g: pack_large(g), kind), "large")
    used = {r.shard: r.bytes for r in first.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    rooms = [max(capacity - used.get(k, 0), 0) for k in range(shards)]
    small_count = items.where(~large).count()
    parts = max(1, math.ceil(small_count / PART_GROUPS))

    def pack_part(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bytes", "g1", "g2"], ascending=[False, True, True])
        part = float(group["bytes"].sum()) / max(sum(rooms), 1)
        group["shard"], _ = best_fit_decreasing(group["bytes"].to_numpy(), [r * part for r in rooms])
        return group[["g1", "g2", "chunk", "bytes", "shard"]]

    part = F.pmod(F.xxhash64("g1", "g2"), F.lit(parts))
    rest = items.where(~large).groupBy(part).applyInPandas(lambda g: pack_part(g), kind)
    packed = first.unionByName(rest).drop("bytes")
    ranges = max(1, math.ceil(count / RANGE_ROWS))
    placed = cut_lineage(
        rows.join(packed, ["g1", "g2", "chunk"])
        .select("id", "size", "text_crc32", "row", F.col("shard").cast("int").alias("shard"))
        .withColumn("range", F.pmod(F.xxhash64("row"), F.lit(ranges))),
        "placed",
    )
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "range").agg(F.count("*").alias("rows"))
    starts = starts.select("shard", "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    line = Window.partitionBy("shard", "range").orderBy("row")
    slots = placed.withColumn("place", F.row_number().over(line)).join(starts, ["shard", "range"])
    return slots.select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("start") + F.col("place") - 1).alias("slot")
    )


def fixed_capacity_shards(
    docs: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", cell_shards: int = 1_000
) -> DataFrame:
    """The rows of ``docs`` (id, size, text_crc32) with the shard that each enters, in as few shards of ``capacity`` as the method needs.

    A row weighs the bytes of its text plus 8. Rows with equal text share a shard unless they outweigh one; then
    they fill shards by rows. The groups are dealt to cells of about ``cell_shards`` shards. In a cell the groups above a
    thousandth of a shard, at most a thousand per shard, are packed by best fit decreasing; running sums lay the others
    into the room that is left, up to a thousandth of a shard, and then into new shards. So a cell wastes a thousandth of
    its shards and one shard. The room of every shard, one number, passes through the driver.

    Defined results: no shard holds more than ``capacity``, but that a row above it has a shard of its own; null text is
    an empty one; a null id is an id like others; repeated rows are rows of their own; an empty table gives
    an empty table; other columns are ignored. Shards are numbered from 0 without gaps.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = cut_lineage(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("g1"),
            F.xxhash64(F.lit(1), text).alias("g2"),
            F.monotonically_increasing_id().alias("row"),
            F.lit(1).alias("one"),
        ),
        "rows",
    )
    count, total = rows.agg(F.count("*"), F.sum("size")).first()
    ranges = F.lit(max(1, math.ceil(count / RANGE_ROWS)))
    # Rows of a group have one size, so a group above the capacity is cut by counting its rows, into eighths of a
    # shard, which fill gaps.
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"))
    over = cut_lineage(groups.where(F.col("bytes") > capacity).select("g1", "g2"), "over")
    whole = rows.join(over, ["g1", "g2"], "left_anti").withColumn("chunk", F.lit(0).cast("long"))
    cut = rows.join(over, ["g1", "g2"], "left_semi").withColumn("range", F.pmod(F.xxhash64("row"), ranges))
    each = F.greatest(F.floor(F.lit(capacity // 8) / F.col("size")), F.lit(1))
    cut = running(cut, "one", ["g1", "g2"], "range", ["row"]).withColumn("chunk", F.floor((F.col("end") - 1) / each))
    rows = cut_lineage(whole.unionByName(cut.select(*whole.columns)), "chunks")
    cells = max(1, (total or 0) // (capacity * cell_shards))
    item = ["g1", "g2", "chunk"]
    cell = F.pmod(F.xxhash64(*item), F.lit(cells)).alias("cell")
    items = cut_lineage(rows.groupBy(*item).agg(F.sum("size").alias("bytes")).select(*item, "bytes", cell), "items")
    large = F.col("bytes") * LARGE > capacity

    def pack_cell(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bytes", "g1", "g2", "chunk"], ascending=[False, True, True, True])
        group["bin"], left = best_fit_decreasing(group["bytes"].to_numpy(), capacity=capacity)
        return group.assign(room=np.array(left)[group["bin"].to_numpy()])

    kind = "g1 long, g2 long, chunk long, bytes long, cell long, bin long, room long"
    first = cut_lineage(items.where(large).groupBy("cell").applyInPandas(lambda g: pack_cell(g), kind), "large")
    margin = capacity // LARGE
    rooms: dict[int, np.ndarray] = {}  # per cell, where the use of each bin by small groups ends
    for c, part in first.select("cell", "bin", "room").distinct().toPandas().groupby("cell"):
        free = np.zeros(int(part["bin"].max()) + 1, np.int64)
        free[part["bin"]] = np.maximum(part["room"] - margin, 0)
        rooms[int(c)] = np.cumsum(free)
    fresh = max(capacity - margin, 1)
    small = items.where(~large)
    amount = {r.cell: r.bytes for r in small.groupBy("cell").agg(F.sum("bytes").alias("bytes")).collect()}
    opened = {c: len(e) for c, e in rooms.items()}
    for c, n in amount.items():
        used = rooms.get(c, np.zeros(0, np.int64))
        rest = n - (int(used[-1]) if len(used) else 0)
        opened[c] = len(used) + max(0, math.ceil(rest / fresh))
    offsets = dict(zip(sorted(opened), np.cumsum([0] + [opened[c] for c in sorted(opened)]).tolist()))

    @F.pandas_udf("long")
    def bin_at(cell: pd.Series, start: pd.Series) -> pd.Series:
        out = np.zeros(len(cell), np.int64)
        for c in cell.unique():
            ends, mine = rooms.get(int(c), np.zeros(0, np.int64)), (cell == c).to_numpy()
            place = start[mine].to_numpy()
            inside = np.searchsorted(ends, place, "right")
            beyond = len(ends) + (place - (ends[-1] if len(ends) else 0)) // fresh
            out[mine] = np.where(inside < len(ends), inside, beyond)
        return pd.Series(out)

    parts = F.lit(max(1, math.ceil(count / cells / RANGE_ROWS)))
    laid = running(small.withColumn("range", F.pmod(F.xxhash64(F.lit(2), *item), parts)), "bytes", ["cell"], "range", item)
    laid = laid.select(*item, "cell", bin_at("cell", F.col("end") - F.col("bytes")).alias("bin"))
    packed = first.select(*item, "cell", "bin").unionByName(laid)
    begin = docs.sparkSession.createDataFrame([(int(c), int(o)) for c, o in offsets.items()], "cell long, begin long")
    numbered = packed.join(F.broadcast(begin), "cell").select(*item, (F.col("begin") + F.col("bin")).alias("shard"))
    return rows.join(numbered, item).select(F.col("id").alias(id_col), "size", "text_crc32", "shard")
