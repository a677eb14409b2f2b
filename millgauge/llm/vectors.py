"""Tiles of queries and candidates for searches over vectors.

A stated set of queries meets all vectors in blocks: queries are dealt to rows of a grid and candidates to
columns, each is sent to all cells of its row or column, and a cell is one small matrix product. Block
sizes are fixed, so memory is bounded; the number of blocks follows the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Queries and candidates of a cell.
QUERY_BLOCK, CANDIDATE_BLOCK = 1_024, 4_096


def usable(vectors: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """(id, v) of the rows with an id and a vector of finite components, and unless ``zero`` one that is not 0."""
    v = F.col(vector_col).cast("array<double>")

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") > 0)).where(F.forall("v", finite))
    return rows if zero else rows.where(F.exists("v", lambda x: x != 0))


def queries_of(vectors: DataFrame, every: int) -> DataFrame:
    """The rows whose id is divisible by ``every``; of rows that share an id the smallest vector."""
    return vectors.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))


def grid(queries: DataFrame, candidates: DataFrame, n_queries: int, n_candidates: int) -> tuple[DataFrame, DataFrame]:
    """Both tables with the cells (r, c) of their rows."""
    down, across = max(1, math.ceil(n_queries / QUERY_BLOCK)), max(1, math.ceil(n_candidates / CANDIDATE_BLOCK))
    place = F.xxhash64("id")
    left = queries.withColumn("r", F.pmod(place, F.lit(down))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    right = candidates.withColumn("c", F.pmod(place, F.lit(across)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    return left.withColumn("r", F.col("r").cast("int")), right.withColumn("r", F.col("r").cast("int"))


def by_length(left: pa.Table, right: pa.Table) -> Iterator[tuple]:
    """For each length of vectors: query rows and matrix, candidate ids and matrix."""

    def parts(t: pa.Table) -> dict:
        t = t.combine_chunks()
        lengths = t.column("v").combine_chunks().value_lengths().to_numpy()
        out = {}
        for n in np.unique(lengths):
            rows = t.filter(pa.array(lengths == n))
            out[int(n)] = rows, rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, n)
        return out

    mine, other = parts(left), parts(right)
    for n in sorted(mine.keys() & other.keys()):
        yield mine[n][0], mine[n][1], other[n][0].column("id").to_numpy(), other[n][1]


def in_cells(left: DataFrame, right: DataFrame, work: Callable, names: list[str], kinds: list[str]) -> DataFrame:
    """Rows that ``work`` gives as numpy columns for the queries and candidates of every cell."""
    types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [work(*part) for part in by_length(a, b)] if len(a) and len(b) else []
        columns = [np.concatenate([f[k] for f in found]) if found else [] for k in range(len(names))]
        return pa.table([pa.array(c, types[t]) for c, t in zip(columns, kinds)], names=names)

    schema = ", ".join(f"{n} {t}" for n, t in zip(names, kinds))
    return left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(lambda a, b: cell(a, b), schema)


