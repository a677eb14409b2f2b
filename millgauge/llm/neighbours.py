"""Nearest neighbours by a block matrix join over int8 vectors.

A vector is rounded to 127 steps of its largest component, and the length of what rounding cut off is
kept. In a cell one product of int8 matrices gives the distances of all rounded pairs; the true distance
differs by at most the two lengths cut off. A pair survives if its least possible distance does not exceed
the k-th smallest greatest possible one of its query. Survivors are computed again in double precision and
the nearest are taken from a heap, so nothing is lost to rounding.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from millgauge.llm.vectors import grid, in_cells, queries_of, usable
from millgauge.sources.staged import cut_lineage

#: Queries of a cell that are compared at once.
STRIP = 128


def rounded(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 components, the step of each vector, and the length that rounding cut off."""
    step = np.maximum(np.abs(v).max(axis=1) / 127, np.finfo(float).tiny)
    small = np.rint(v / step[:, None]).astype(np.int8)
    return small, step, np.sqrt(np.square(v - small * step[:, None]).sum(axis=1))


def distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances of one vector to many, components added from the first to the last."""
    total = np.zeros(len(v))
    for k in range(v.shape[1]):
        gap = v[:, k] - q[k]
        total += gap * gap
    return np.sqrt(total)


def nearest_in_cell(rows, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple:
    query_ids = rows.column("id").to_numpy()
    q8, q_step, q_cut = rounded(q)
    v8, v_step, v_cut = rounded(v)
    exact = np.float32 if 127 * 127 * q.shape[1] < 1 << 24 else np.float64  # holds integer products exactly
    v_wide = v8.astype(exact).T
    v_square = np.square(v8.astype(np.float64)).sum(axis=1) * v_step**2
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(q), STRIP):
        part = slice(at, at + STRIP)
        product = (q8[part].astype(exact) @ v_wide).astype(np.float64) * q_step[part, None] * v_step
        q_square = np.square(q8[part].astype(np.float64)).sum(axis=1) * q_step[part] ** 2
        squares = q_square[:, None] + v_square
        near = np.sqrt(np.maximum(squares - 2 * product, 0))
        slack = q_cut[part, None] + v_cut + 1e-7 * np.sqrt(squares)
        most = near + slack
        own = query_ids[part, None] == ids
        most[own] = np.inf
        least = np.where(own, np.inf, near - slack)
        last = np.partition(most, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(most), np.inf)
        for i, row in enumerate(least):
            alive = np.flatnonzero((row <= last[i]) & ~own[i])
            found = heapq.nsmallest(k, zip(distances(q[at + i], v[alive]), ids[alive]))
            out[0].extend([query_ids[at + i]] * len(found))
            out[1].extend(n for _, n in found)
            out[2].extend(d for d, _ in found)
    return tuple(np.array(c, t) for c, t in zip(out, (np.int64, np.int64, np.float64)))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows of every row whose id is divisible by ``every``.

    The score is the Euclidean distance; ties go to the smaller id; rows with the query's id are left out.
    Defined results: rows whose id or vector is null, or whose vector is empty, zero or not finite, take no
    part; vectors of different length are not compared; of query rows that share an id the smallest vector
    asks, as candidates all of them count; with fewer than k candidates all are given; an empty table
    gives an empty table; other columns are ignored.
    """
    rows = cut_lineage(usable(vectors, id_col, vector_col, zero=False), "vectors")
    queries = cut_lineage(queries_of(rows, every), "queries")
    left, right = grid(queries, rows, queries.count(), rows.count())
    found = in_cells(left, right, lambda *part: nearest_in_cell(*part, k), ["query_id", "id", "score"], ["long", "long", "double"])
    order = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
