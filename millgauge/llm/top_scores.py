"""Exact top-k by distributed histogram selection.

Every pass scores all pairs of queries and candidates in tiles and counts, per query, the scores of the
interval that must hold the k-th highest one. The counts of all tiles are added, the bin with the k-th
score becomes the next interval, and so on until an interval is one score wide. A last pass keeps the
scores above it, and of the scores equal to it those with the smallest ids. Nothing but counts and final
rows leaves a tile. A tile counts only down to its own k-th score, as the k-th of all cannot be lower.
"""

from __future__ import annotations

import functools
import math
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from millgauge.llm.vectors import grid, in_cells, queries_of, usable
from millgauge.sources.staged import cut_lineage

#: Binary logarithm of the number of bins of a histogram.
BIN_BITS = 12
#: Intervals of up to this many bits are worked on in 64-bit integers, wider ones in integers of any size.
WORD_BITS = 62
#: Bits that a pass over a wider interval settles; a tile still lists no more bins than it needs scores.
WIDE_BITS = 60
LEAST, GREATEST = -(1 << 63), (1 << 63) - 1


def scaled(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); exact integers where a double does not reach that far."""
    with np.errstate(over="ignore"):
        out = np.floor(scale * v)
    if np.isfinite(out).all():
        return out
    return np.array([[math.floor(scale * Fraction(float(x))) for x in row] for row in v], object)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products, as objects if they may not fit 64 bits."""
    plain = q.dtype != object and v.dtype != object
    if plain and max(1.0, np.abs(q).max()) * max(1.0, np.abs(v).max()) * q.shape[1] < 2.0**53:
        return (q @ v.T).astype(np.int64)
    return np.array([[int(x) for x in row] for row in q], object) @ np.array([[int(x) for x in row] for row in v], object).T


def base_of(path: list[int], low: int, shifts: list[int]) -> int:
    """The least score of the interval that the bins of all passes lead to."""
    return low + sum(b << s for b, s in zip(path, shifts))


def step_of(bits: int) -> int:
    """Bits that a pass over an interval of so many bits settles."""
    return min(bits, BIN_BITS if bits <= WORD_BITS else WIDE_BITS)


def counted(rows, q: np.ndarray, ids: np.ndarray, v: np.ndarray, low: int, shifts: list[int], bits: int, wide: bool, scale: int) -> tuple:
    """(query, bin, count) of the scores in each query's interval, from the top down to its need."""
    queries, need = (rows.column(c).to_numpy() for c in ("id", "need"))
    paths = rows.column("path").to_pylist()
    scores = products(scaled(q, scale), scaled(v, scale))
    out: tuple[list, list, list] = ([], [], [])
    for i, row in enumerate(scores):
        row = row[ids != queries[i]].astype(object if wide else np.int64)
        gap = row - base_of(paths[i], low, shifts)
        gap = gap[(gap >= 0) & (gap < (1 << bits))]
        bins, counts = np.unique((gap >> (bits - step_of(bits))).astype(np.int64), return_counts=True)
        bins, counts = bins[::-1], counts[::-1]
        kept = 1 + int(np.searchsorted(np.cumsum(counts), need[i]))
        out[0].append(np.full(len(bins[:kept]), queries[i]))
        out[1].append(bins[:kept])
        out[2].append(counts[:kept])
    return tuple(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out)


def kept(rows, q: np.ndarray, ids: np.ndarray, v: np.ndarray, low: int, shifts: list[int], digits: int, scale: int) -> tuple:
    """(query, id, score, order) above each query's k-th score, and with it the smallest ids that may count.

    ``order`` sorts scores that do not fit 64 bits: ``digits`` hexadecimal digits of their place above ``low``.
    """
    queries, need = (rows.column(c).to_numpy() for c in ("id", "need"))
    paths = rows.column("path").to_pylist()
    scores = products(scaled(q, scale), scaled(v, scale))
    out: tuple[list, list, list, list] = ([], [], [], [])
    for i, row in enumerate(scores):
        base = base_of(paths[i], low, shifts)
        other = ids != queries[i]
        above = np.flatnonzero(other & (row > base))
        equal = np.flatnonzero(other & (row == base))
        if len(equal) > need[i]:
            equal = equal[np.argsort(ids[equal], kind="stable")[: need[i]]]
        chosen = np.concatenate([above, equal])
        out[0].append(np.full(len(chosen), queries[i]))
        out[1].append(ids[chosen])
        out[2].append(np.array([min(max(int(x), LEAST), GREATEST) for x in row[chosen]], np.int64))
        out[3].append(np.array([f"{int(x) - low:0{digits}x}" if digits else "" for x in row[chosen]], object))
    columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
    return *(c.astype(np.int64) for c in columns[:3]), columns[3].astype(object)


def top_scores(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, scale: int = 1024
) -> DataFrame:
    """(query_id, rank, id, score): the k highest scores of every row whose id is divisible by ``every``.

    The score is the inner product of the vectors floor(scale * x); ties go to the smaller id; rows with the
    query's id are left out. Defined results: rows whose id or vector is null, or whose vector is empty or
    not finite, take no part; vectors of different length are not compared; of query rows that share an id
    the smallest vector asks, as candidates all of them count; scores are exact integers of any size and ranked
    as such, and one that does not fit the result type is given as the nearest number that does; with fewer
    than k candidates all are given; an empty table gives an empty table; other columns are ignored.
    """
    rows = cut_lineage(usable(vectors, id_col, vector_col, zero=True), "vectors")
    largest, length, count = rows.agg(
        F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))), F.max(F.size("v")), F.count("*")
    ).first()
    bound = (math.ceil(scale * Fraction(largest or 0)) + 1) ** 2 * (length or 1) + 1
    bits = (2 * bound).bit_length()
    digits = 0 if bits <= WORD_BITS else -(-(bits + 1) // 4)
    asked = queries_of(rows, every)
    nothing = F.array().cast("array<long>").alias("path")
    state = cut_lineage(asked.select("id", "v", nothing, F.lit(k).cast("long").alias("need")), "state")
    shifts: list[int] = []
    n_queries = state.count()
    while bits > 0:
        left, right = grid(state, rows, n_queries, count)
        part_of = functools.partial(counted, low=-bound, shifts=[*shifts], bits=bits, wide=digits > 0, scale=scale)
        found = in_cells(left, right, part_of, ["query", "bin", "n"], ["long"] * 3)
        bins = found.groupBy("query", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query").orderBy(F.desc("bin"))
        reached = bins.withColumn("sum", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        # The first bin from the top that completes the need, or the lowest if none does.
        spot = reached.join(state.select(F.col("id").alias("query"), "need"), "query").groupBy("query").agg(
            F.max(F.when(F.col("sum") >= F.col("need"), F.struct("bin", (F.col("sum") - F.col("n")).alias("above")))).alias("full"),
            F.min(F.struct("bin", (F.col("sum") - F.col("n")).alias("above"))).alias("lowest"),
        )
        spot = spot.select("query", F.coalesce("full", "lowest").alias("s"))
        bits -= step_of(bits)
        shifts.append(bits)
        state = cut_lineage(
            state.join(spot, F.col("id") == F.col("query"), "left").select(
                "id",
                "v",
                F.array_append("path", F.coalesce("s.bin", F.lit(0)).cast("long")).alias("path"),
                (F.col("need") - F.coalesce("s.above", F.lit(0))).alias("need"),
            ),
            "state",
        )
    left, right = grid(state, rows, n_queries, count)
    last = functools.partial(kept, low=-bound, shifts=shifts, digits=digits, scale=scale)
    found = in_cells(left, right, last, ["query_id", "id", "score", "place"], ["long"] * 3 + ["string"])
    order = Window.partitionBy("query_id").orderBy(F.desc("place"), F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
