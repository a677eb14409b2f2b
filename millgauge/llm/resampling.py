"""Importance resampling of documents towards a target text collection, on hashed word runs.

Features of a text are its runs of one to three words; the bucket of a feature is the CRC-32 of its bytes
modulo the number of buckets. What a bucket gains a document is the logarithm of its share in the target
texts over its share in the documents. A Gumbel number drawn from the document's id is added to the sum
of the gains; the highest sums are drawn, which samples without replacement in proportion to importance.

Checksums are made once for every distinct feature of a block of words: distinct features are found by
exact dictionary codes, grouped by their length in bytes, and the bytes of a group form a matrix whose
columns update the checksums of all its features together. The results are scattered back to the places
of the features. The buckets of a document are written once; the second pass only looks gains up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millgauge.llm.words import runs, text_bytes
from millgauge.operators.heavy import HOT_ROWS, Running, running_totals
from millgauge.sources.staged import cut_lineage, scratch

#: Longest run of words that is a feature, and the number of buckets.
RUN_WORDS, BUCKETS = 3, 10_000
#: Words whose features are worked on at once.
BLOCK_WORDS = 1 << 18
#: Features of up to this many bytes go through the matrices, longer ones one by one.
MATRIX_BYTES = 256


def checksum_table() -> np.ndarray:
    """What one byte does to a CRC-32, for each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


def matrix_checksums(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices of ``data``, those of equal length as one matrix of bytes, column by column."""
    import zlib

    out = np.zeros(len(start), np.uint32)
    table = checksum_table()
    order = np.argsort(size, kind="stable")
    lengths, first = np.unique(size[order], return_index=True)
    for length, rows in zip(lengths, np.split(order, first[1:])):
        if length > MATRIX_BYTES:
            out[rows] = [zlib.crc32(data[start[r] : start[r] + length]) for r in rows]
            continue
        bytes_ = np.lib.stride_tricks.sliding_window_view(data, length)[start[rows]]
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for column in np.ascontiguousarray(bytes_.T):
            crc = table[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
        out[rows] = ~crc
    return out


def codes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Exact codes 0, 1, .. of equal values, and for each code a place where its value stands."""
    found = values.dictionary_encode()
    codes = found.indices.to_numpy()
    place = np.zeros(len(found.dictionary), np.int64)
    place[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, place


class Features:
    """Buckets of the word runs of texts."""

    def __init__(self, buckets: int = BUCKETS, run_words: int = RUN_WORDS) -> None:
        self.buckets, self.run_words = buckets, run_words
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32
        self.inside = np.zeros(256, bool)  # digits, a-z and all bytes of characters beyond ASCII
        self.inside[48:58] = self.inside[97:123] = self.inside[128:] = True

    def block(self, words: np.ndarray, sizes: np.ndarray, last: np.ndarray, own: int) -> np.ndarray:
        """Buckets of the runs that begin at the first ``own`` words of a block, in order.

        ``words`` holds the bytes of the words without gaps, ``sizes`` their lengths, and ``last`` for each
        word the place behind the last word of its text.
        """
        n = len(sizes)
        ends = np.cumsum(sizes)
        listed = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), n, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(words)]
        )
        codes, place = codes_of(listed)
        spaced = np.full(len(words) + n, 32, np.uint8)  # every word with one space behind it
        spaced[np.arange(len(words)) + np.repeat(np.arange(n), sizes)] = words
        begin = ends - sizes + np.arange(n)
        out = np.zeros((own, self.run_words), np.int32)
        valid = np.zeros((own, self.run_words), bool)
        codes = codes.astype(np.int64)
        single, kinds = codes, len(place)
        for k in range(self.run_words):
            if k:  # the code of a run is that of its first words, with the next word
                codes, place = codes_of(pa.array(codes[: n - k] * kinds + single[k:]))
                codes = codes.astype(np.int64)
            if not len(codes):
                break
            size = begin[place + k] + sizes[place + k] - begin[place]
            # a code that only crosses from one text into the next is no feature, but harmless
            bucket = (matrix_checksums(spaced, begin[place], size) % np.uint32(self.buckets)).astype(np.int32)
            here = min(own, len(codes))
            out[:here, k] = bucket[codes[:here]]
            valid[:here, k] = np.arange(here) + k < last[:here]
        return out[valid]

    def __call__(self, texts: pa.Array):
        """For each run of texts: words of each text, and the buckets of all features, text by text."""
        data, offsets = text_bytes(texts)
        for first, last in runs(offsets):
            part = self.fold[data[offsets[first] : offsets[last]]]
            cuts = offsets[first : last + 1] - offsets[first]
            inside = self.inside[part]
            fresh = np.zeros(len(part) + 1, bool)  # a text begins here
            fresh[cuts] = True
            starts = inside.copy()
            starts[1:] &= ~inside[:-1] | fresh[1:-1]
            starts = np.flatnonzero(starts)
            at = np.searchsorted(starts, cuts)
            n_words = np.diff(at)
            behind = np.repeat(at[1:], n_words)
            held = np.concatenate([[0], np.cumsum(inside)])
            words = part[inside]
            edges = np.append(held[starts], len(words))  # where each word begins among the bytes of words
            found = []
            for low in range(0, len(starts), BLOCK_WORDS):
                high = min(low + BLOCK_WORDS, len(starts))
                far = min(high + self.run_words - 1, len(starts))
                found.append(
                    self.block(words[edges[low] : edges[far]], np.diff(edges[low : far + 1]), behind[low:high] - low, high - low)
                )
            yield n_words, np.concatenate(found) if found else np.zeros(0, np.int32)

    def count(self, n_words: np.ndarray) -> np.ndarray:
        """Features of texts of so many words."""
        return sum(np.maximum(n_words - k, 0) for k in range(self.run_words))


def with_buckets(docs: DataFrame, id_col: str, text_col: str, buckets: int, run_words: int) -> DataFrame:
    """doc, n_words, n_features and the buckets (little-endian 32-bit numbers) of each row, written once."""

    def measure(batches):
        features = Features(buckets, run_words)
        for batch in batches:
            at = 0
            for n_words, found in features(batch.column(1)):
                size = features.count(n_words)
                edges = np.concatenate([[0], np.cumsum(size)]) * 4
                blobs = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(size), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(found.astype("<i4"))]
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(size)), pa.array(n_words, pa.int64()), pa.array(size, pa.int64()), blobs.cast(pa.binary())],
                    names=["doc", "n_words", "n_features", "buckets"],
                )
                at += len(size)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    found = narrow.mapInArrow(measure, "doc long, n_words long, n_features long, buckets binary")
    path = scratch(docs.sparkSession, "features")
    found.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def histogram(found: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over all rows; a task sums its rows before anything is shuffled."""

    def summed(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += np.bincount(np.frombuffer(blob.as_buffer(), "<i4"), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    return found.select("buckets").mapInArrow(summed, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Thousandths of a natural logarithm that every bucket gains: its smoothed target share over its own share.

    Only the gains, one number a bucket, reach the driver.
    """
    both = source.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full")
    both = both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    s_all, t_all = (F.lit(float(x or 0) + buckets) for x in both.agg(F.sum("s"), F.sum("t")).first())
    s, t = F.col("s").cast("double") + 1, F.col("t").cast("double") + 1
    one = F.lit(1.0)
    number = both.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(both, "bucket", "left")
    s, t = F.coalesce(s, one), F.coalesce(t, one)
    listed = number.select("bucket", F.floor(1000 * F.log(t * s_all / (s * t_all))).alias("gain")).orderBy("bucket")
    return np.array([r.gain for r in listed.collect()], np.int64)


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    percent: int = 5,
    min_words: int = 20,
    seed: int = 42,
    buckets: int = BUCKETS,
    run_words: int = RUN_WORDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row; rank is null for rows that are not drawn.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z as a-z. ``percent`` of
    100 of the rows with ``min_words`` words are drawn, rounded down: the highest scores, ties to the
    smaller id. Ranks are row numbers over consecutive slices of the order, so no task sorts all rows.

    Defined results: null, empty and wordless texts have no features, weight 0 and are never drawn unless
    ``min_words`` is 0; a null id draws its number from the seed alone and comes last among ties; repeated
    rows have equal scores and consecutive ranks; ties of one id go to fewer features; an empty target
    gives every bucket its smoothed share; empty documents give an empty table; other columns are ignored.
    """
    found = with_buckets(docs, id_col, text_col, buckets, run_words)
    wanted = with_buckets(target.withColumn("_none", F.lit(None).cast("long")), "_none", target_text, buckets, run_words)
    gain = gains(histogram(found, buckets), histogram(wanted, buckets), buckets)

    def weigh(batches):
        for batch in batches:
            weight = [int(gain[np.frombuffer(b.as_buffer(), "<i4")].sum()) for b in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=["doc", "n_words", "n_features", "weight"])

    weighed = found.select("doc", "n_words", "n_features", "buckets").mapInArrow(weigh, "doc long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc").cast("string"), F.lit(""))), 256)
    chance = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    scored = weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(chance))))
    scored = cut_lineage(scored, "scores")
    able = scored.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    order = [-F.col("score"), F.col("doc").isNull(), F.col("doc"), F.col("n_features"), F.col("weight")]
    ranked = running_totals(able, [], [Running("rank", order)], hot_rows)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(F.col("doc").alias(id_col), "n_words", "n_features", "weight", "score", "rank")
