"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard similarity.

Two permutations make a whole signature. The first spreads the shingle hashes over the numbers below
2**32; coordinate k is the least value of the second over the hashes shifted by k, modulo 2**32. Documents
that agree in all rows of a band share a bucket, and pairs that share one are confirmed on their full
shingle sets.

Copies with equal sets are one class, represented by the smallest id, so a group of copies costs one
signature in the buckets. Pairs inside a bucket are not all listed: the smallest member is compared with
the others, links are contracted to components, and only members that are still in different components
go on. After two such rounds the pairs left are listed whole. Two members of one component need no
comparison, so no link is lost that could join two components.

A pair is dropped before its sets are fetched only if it cannot be alike enough: by the sizes, or by the
parities. A document has one bit for each of 1,024 ranges of hashes, set if an odd number of its shingles
lies there. Where two documents have different bits, at least one shingle is in one set alone, so the
number of such bits bounds the similarity from above.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from millgauge.llm.components import components
from millgauge.llm.words import shingle_sets
from millgauge.sources.staged import cut_lineage

#: 32 bands of 5 rows miss a pair of similarity 0.8 with a chance of 3 in a million.
BANDS, ROWS = 32, 5
#: Shingles by coordinates that are permuted at once.
TILE = 1 << 16
#: Binary logarithm of the number of parities.
PARITY_BITS = 10
#: Rounds of comparing a bucket with one member, before the pairs left are listed. Speed only.
PIVOT_ROUNDS = 2


def permuted(x: np.ndarray) -> np.ndarray:
    """A permutation of the numbers below 2**32, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(hashes: np.ndarray, coordinates: int) -> np.ndarray:
    """Least permuted value of the hashes under each circular shift."""
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    spread = (hashes >> np.uint64(32)).astype(np.uint32)  # the first permutation, of mixed hashes
    width = max(1, TILE // coordinates)
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(spread), width):
        np.minimum(out, permuted(spread[None, at : at + width] + shifts).min(axis=1), out=out)
    return out


def band_keys(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number per band, for its place and its coordinates."""
    keys = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in sign.reshape(bands, rows).T.astype(np.uint64):
        keys = (keys ^ column) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Of each range of hashes, whether it holds an odd number of them, as a row of bits."""
    odd = np.bincount((hashes >> np.uint64(64 - PARITY_BITS)).astype(np.int64), minlength=1 << PARITY_BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """doc, n (set size), the class as two hashes of the sorted set, band keys and parities of each document."""

    def sketch(batches):
        for batch in batches:
            n, low, high, keys, odd = [], [], [], [], []
            for hashes in shingle_sets(batch.column(1), size):
                n.append(len(hashes))
                both = xxhash.xxh3_128_intdigest(hashes.tobytes())
                low.append((both & (2**64 - 1)) - 2**63)
                high.append((both >> 64) - 2**63)
                keys.append(band_keys(signature(hashes, bands * rows), bands, rows) if len(hashes) else None)
                odd.append(parities(hashes))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(low, pa.int64()),
                    pa.array(high, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(odd, pa.list_(pa.int64())),
                ],
                names=["doc", "n", "low", "high", "keys", "odd"],
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(sketch, "doc long, n long, low long, high long, keys array<long>, odd array<long>")


def sets_of(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """doc and its shingle set, ascending."""

    def sets(batches):
        for batch in batches:
            found = [hashes.view(np.int64) for hashes in shingle_sets(batch.column(1), size)]
            found = pa.array(found, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), found], names=["doc", "hashes"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(sets, "doc long, hashes array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets share at least ``percent`` of 100 of their union."""

    def confirm(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                both = np.concatenate([a.values.to_numpy(), b.values.to_numpy()])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("doc").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long").distinct()


def unsettled(open_rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets whose members are in different components, with their component c."""
    labelled = open_rows.join(labels, F.col("rep") == F.col("node"), "left")
    rows = labelled.select("key", "rep", "n", "odd", F.coalesce("component", "rep").alias("c"))
    ends = rows.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most"))
    return cut_lineage(rows.join(ends.where("least <> most").select("key"), "key", "left_semi"), "buckets")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    component_id is the smallest id reachable over links, the own id included; kept says that it is the
    own one. Defined results: null or wordless text has an empty set and is linked with nothing; a null
    id takes part in no link, has a null component and is kept; rows that share an id are one document
    with the links of all its rows; an empty table gives an empty table; other columns are ignored.
    """
    sketch = cut_lineage(sketches(docs, id_col, text_col, shingle_words, bands, rows), "sketches")
    classes = cut_lineage(
        sketch.where("n > 0 and doc is not null")
        .groupBy("low", "high")
        .agg(F.min(F.struct("doc", "n", "keys", "odd")).alias("r"))
        .select("low", "high", F.col("r.doc").alias("rep"), "r.n", "r.keys", "r.odd"),
        "classes",
    )
    banded = classes.select("rep", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    open_rows = banded.join(shared, "key", "left_semi").join(classes.select("rep", "n", "odd"), "rep")
    open_rows = cut_lineage(open_rows.select("key", "rep", "n", "odd", F.col("rep").alias("c")), "buckets")

    def fit(x: str, y: str):
        """Can these sets be alike enough? Their union holds at least the odd ranges beside what they share."""
        nx, ny = F.col(f"{x}n"), F.col(f"{y}n")
        differ = sum(
            (F.bit_count(F.col(f"{x}odd")[k].bitwiseXOR(F.col(f"{y}odd")[k])) for k in range((1 << PARITY_BITS) // 64)),
            F.lit(0),
        )
        sizes = F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent
        return sizes & (differ * (100 + percent) <= (nx + ny) * (100 - percent))

    members = open_rows.select("rep").distinct()
    texts = docs.join(members, docs[id_col].cast("long") == members.rep, "left_semi")
    sets = cut_lineage(sets_of(texts, id_col, text_col, shingle_words).where(F.size("hashes") > 0).distinct(), "sets")
    links = None
    for turn in range(PIVOT_ROUNDS + 1):
        if turn < PIVOT_ROUNDS:
            # written, so that the join has a shuffle of its own, which can be split at a crowded bucket
            first = cut_lineage(open_rows.groupBy("key").agg(F.min(F.struct("rep", "n", "c", "odd")).alias("p")), "first")
            met = open_rows.join(first, "key").where(F.col("rep") != F.col("p.rep"))
            pairs = met.where((F.col("c") != F.col("p.c")) & fit("", "p.")).select(
                F.col("p.rep").alias("a"), F.col("rep").alias("b")
            )
            open_rows = met.select("key", "rep", "n", "odd")
        else:
            x, y = open_rows.alias("x"), open_rows.alias("y")
            pairs = x.join(
                y,
                (F.col("x.key") == F.col("y.key"))
                & (F.col("x.c") != F.col("y.c"))
                & (F.col("x.rep") < F.col("y.rep"))
                & fit("x.", "y."),
            ).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        found = cut_lineage(confirmed(pairs.distinct(), sets, percent), "links")
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        if turn < PIVOT_ROUNDS:
            open_rows = unsettled(open_rows, labels)
    reps = classes.select("low", "high", "rep").join(labels, F.col("rep") == F.col("node"), "left")
    reps = reps.select("low", "high", F.coalesce("component", "rep").alias("component_id"))
    # Rows without a set are many at times and need no component, so they stay out of the join.
    linked = sketch.where("n > 0 and doc is not null").select("doc", "n", "low", "high").join(reps, ["low", "high"])
    alone = sketch.where("n = 0 or doc is null").select("doc", "n", F.col("doc").alias("component_id"))
    return linked.select("doc", "n", "component_id").unionByName(alone).select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("component_id").eqNullSafe(F.col("doc")).alias("kept"),
    )
