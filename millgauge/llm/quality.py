"""Document quality by ridge regression on random Fourier features of document statistics.

The statistics of a text (lengths, kinds of bytes, repetition of words) are standardised and mapped to
random cosines, whose inner products approximate a Gaussian kernel. Every task sums the normal equations
of its labelled rows; the sums, of a size set by the number of features alone, are solved for the ridge
weights, and an isotonic step function turns raw scores into probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millgauge.llm.words import SHORT_RUN_BYTES, WordHashes, runs, text_bytes
from millgauge.sources.staged import cut_lineage

#: Labelled rows used to fit, at most about this many, chosen by a hash of their id.
FIT_ROWS = 200_000
FEATURES, RIDGE, WIDTH, SEED = 256, 1e-4, 3.0, 11
#: Raw scores are calibrated in steps of this size.
STEP = 1e-3

#: Kinds of bytes: blanks, line ends, A-Z, a-z, digits, ends of sentences, commas and quotes, bars, other
#: signs, all that is not ASCII.
KINDS = 10
STATISTICS = 2 + KINDS + 9


def kinds() -> np.ndarray:
    out = np.full(256, 8, np.int64)
    for kind, members in enumerate((b" \t\x0b\x0c\r", b"\n", range(65, 91), range(97, 123), range(48, 58), b".!?", b",;:'\"()-", b"|")):
        out[list(members)] = kind
    out[128:] = 9
    return out


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS numbers for each text; an empty text has zeros."""
    data, offsets = text_bytes(texts)
    hashes, kind = WordHashes(), kinds()
    out = np.zeros((len(offsets) - 1, STATISTICS))
    for first, last in runs(offsets, SHORT_RUN_BYTES):
        cuts = offsets[first : last + 1]
        sizes = np.diff(cuts)
        place = np.repeat(np.arange(last - first) * KINDS, sizes)
        place += kind[data[cuts[0] : cuts[-1]]]
        share = np.bincount(place, minlength=(last - first) * KINDS).reshape(-1, KINDS).astype(float)
        rows = out[first:last]
        words, at = hashes(data, cuts)
        n_words = np.diff(at)
        rows[:, 0], rows[:, 1] = np.log1p(sizes), np.log1p(n_words)
        rows[:, 2 : 2 + KINDS] = share / np.maximum(sizes, 1)[:, None]
        many = np.maximum(n_words, 1)
        rows[:, 12] = np.log1p((sizes - share[:, 0] - share[:, 1]) / many)  # bytes of a word
        rows[:, 13] = np.log1p(n_words / (share[:, 1] + 1))  # words of a line
        rows[:, 14] = np.log1p(n_words / (share[:, 5] + 1))  # words of a sentence
        rows[:, 15] = np.minimum(share[:, 2] / many, 4)  # capitals of a word
        rows[:, 16] = np.minimum((share[:, 7] + share[:, 8]) / many, 4)  # bars and signs of a word
        for k in range(last - first):
            own = words[at[k] : at[k + 1]]
            if len(own):
                _, counts = np.unique(own, return_counts=True)
                rows[k, 17] = len(counts) / len(own)
                rows[k, 18] = counts.max() / len(own)
                rows[k, 19] = np.count_nonzero(own[1:] == own[:-1]) / len(own)
                rows[k, 20] = np.square(counts / len(own)).sum()
    return out


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, the null mark of the text, and its statistics."""

    def measure(batches):
        for batch in batches:
            found = statistics(batch.column(1))
            flat = pa.array(found.ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * STATISTICS), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "statistics"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(measure, "id long, statistics array<double>")


@dataclass
class QualityModel:
    """Frozen numbers of a fitted classifier; their size does not depend on the data."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    values: np.ndarray

    def features(self, rows: np.ndarray) -> np.ndarray:
        draw = np.random.default_rng(SEED)
        spread = draw.normal(0, 1 / WIDTH, (STATISTICS, FEATURES))
        phase = draw.uniform(0, 2 * np.pi, FEATURES)
        even = np.clip((rows - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / FEATURES) * np.cos(even @ spread + phase)
        return np.hstack([waves, np.ones((len(rows), 1))])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(self.features(rows) @ self.weights, -1, 2)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(rows), self.values[0])
        return np.interp(self.raw(rows), self.knots, self.values)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, STATISTICS)


def isotonic(scores: np.ndarray, counts: np.ndarray, positives: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares nondecreasing values at ascending scores, neighbours pooled while they violate the order."""
    pools: list[list[float]] = []
    for x, n, p in zip(scores, counts, positives):
        pools.append([x, x, n, p])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    knots = np.array([[low, high] for low, high, _, _ in pools]).ravel()
    values = np.array([[p / n, p / n] for _, _, n, p in pools]).ravel()
    return knots, values


def fit(measured: DataFrame, labels: DataFrame, id_col: str, label_col: str, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Fit on the measured rows whose id has labels; several labels of an id count with their mean.

    Without labels the score is 0.5, with labels of one kind it is that label.
    """
    named = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y"))
    named = named.where("id is not null and y is not null").groupBy("id").agg(F.avg("y").alias("y"))
    known, mean_y = named.agg(F.count("*"), F.avg("y")).first()
    cells = [F.col("statistics")[k] for k in range(STATISTICS)]
    sums = measured.agg(*[F.avg(c) for c in cells], *[F.stddev_pop(c) for c in cells]).first()
    centre = [np.array([x or 0.0 for x in part]) for part in (sums[:STATISTICS], sums[STATISTICS:])]
    model = QualityModel(centre[0], np.where(centre[1] > 1e-9, centre[1], 1.0), None, np.zeros(1), np.array([0.5]))
    if not known or mean_y in (0.0, 1.0):
        model.values = np.array([0.5 if not known else mean_y])
        return model
    if known > fit_rows:
        named = named.where(F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / known))
    sample = cut_lineage(measured.join(named, "id").select("statistics", "y"), "labelled")

    def partial(batches):
        total = np.zeros((FEATURES + 2, FEATURES + 2))
        for batch in batches:
            rows = np.hstack([model.features(matrix(batch.column(0))), batch.column(1).to_numpy()[:, None]])
            total += rows.T @ rows
        for k, row in enumerate(total):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([row], pa.list_(pa.float64()))], names=["k", "row"])

    def added(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": group["k"].iloc[:1], "row": [np.sum(np.stack(group["row"].to_list()), axis=0)]})

    kind = "k long, row array<double>"
    parts = sample.mapInArrow(partial, kind).groupBy("k").applyInPandas(lambda g: added(g), kind)
    total = np.array([r.row for r in parts.orderBy("k").collect()])
    if not len(total) or not total[FEATURES, FEATURES]:
        return model
    left, right = total[:-1, :-1], total[:-1, -1]
    model.weights = np.linalg.solve(left + RIDGE * total[FEATURES, FEATURES] * np.eye(len(left)), right)

    def raw(batches):
        for batch in batches:
            steps = np.rint(model.raw(matrix(batch.column(0))) / STEP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(steps), batch.column(1)], names=["step", "y"])

    steps = sample.mapInArrow(raw, "step long, y double").groupBy("step").agg(F.count("*"), F.sum("y")).orderBy("step").collect()
    found = np.array([tuple(r) for r in steps], float)  # at most 3 / STEP rows
    model.knots, model.values = isotonic(found[:, 0] * STEP, found[:, 1], found[:, 2])
    return model


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """The rows of ``docs`` that ``classify`` predicts as 1, whole. Scores belong to rows, not to ids."""
    measured = cut_lineage(with_statistics(docs, id_col, text_col), "statistics")
    model = fit(measured, labels, id_col, label_col, fit_rows)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.clip(model.score(statistics(texts)), 0, 1))

    return docs.where(score(F.col(text_col).cast("string")) >= threshold)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """(id, score, predicted) of every row: the chance of label 1, and whether it reaches the threshold.

    Defined results: null, empty and wordless texts are scored from zero counts; a null id has no label
    but a score; repeated rows are scored alike; labels of unknown ids do nothing; an empty table gives
    an empty table; other columns are ignored.
    """
    measured = cut_lineage(with_statistics(docs, id_col, text_col), "statistics")
    model = fit(measured, labels, id_col, label_col, fit_rows)

    def score(batches):
        for batch in batches:
            found = np.clip(model.score(matrix(batch.column(1))), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "score"])

    scored = measured.mapInArrow(score, "id long, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
