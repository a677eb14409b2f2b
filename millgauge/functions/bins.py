"""Price bands, tail bands, period bands and quantile groups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from millgauge.operators.heavy import HOT_ROWS, Running, running_totals


@dataclass(frozen=True)
class Band:
    """One labelled interval; an open side is None."""

    label: str
    low: float | None = None
    high: float | None = None
    low_closed: bool = True
    high_closed: bool = False

    def holds(self, c: Column) -> Column:
        tests = []
        if self.low is not None:
            tests.append(c >= self.low if self.low_closed else c > self.low)
        if self.high is not None:
            tests.append(c <= self.high if self.high_closed else c < self.high)
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


# Band labels and edges of the published tables.
WIDE = (
    Band("1 - <$100K", None, 100_000),
    Band("2 - $100K-$200K", 100_000, 200_000, True, True),
    Band("3 - $200K-$250K", 200_000, 250_000, False, False),
    Band("4 - $250K-$350K", 250_000, 350_000, True, True),
    Band("5 - >$350K", 350_000, None, False),
)
NARROW = (
    Band("1 - <$120K", None, 120_000),
    Band("2 - $120K-$180K", 120_000, 180_000, True, True),
    Band("3 - $180K-$270K", 180_000, 270_000, False, False),
    Band("4 - $270K-$330K", 270_000, 330_000, True, True),
    Band("5 - >$330K", 330_000, None, False),
)


def _money(k: int) -> str:
    return f"${k}K" if k < 1000 else "$1M"


ELEVEN = (
    Band("1 - <$100K", None, 100_000),
    *[
        Band(f"{i} - {_money((i - 1) * 100)}-{_money(i * 100)}", (i - 1) * 100_000, i * 100_000)
        for i in range(2, 11)
    ],
    Band("11 - >$1M", 1_000_000, None),
)


def price_band(c: Column, spec: Sequence[Band]) -> Column:
    """Label of the band holding the value; null stays null."""
    out = F.when(spec[0].holds(c), spec[0].label)
    for band in spec[1:]:
        out = out.when(band.holds(c), band.label)
    return out


def band_order(c: Column, spec: Sequence[Band]) -> Column:
    """Position of a band label in its list (labels sort wrongly as text: 10 before 2)."""
    out = F.when(c == spec[0].label, 1)
    for i, band in enumerate(spec[1:], start=2):
        out = out.when(c == band.label, i)
    return out


def tail_band(percentile: Column, low: int = 2, high: int = 99) -> Column:
    """``Tails`` at both ends, else ``Middle 96%``; a null percentile counts as middle."""
    return F.when((percentile <= low) | (percentile >= high), "Tails").otherwise("Middle 96%")


def period_band(year: Column, split_year: int = 2019) -> Column:
    """``Pre-<year>`` or ``Post-<year>``; a null year counts as post."""
    return F.when(year < split_year, f"Pre-{split_year}").otherwise(f"Post-{split_year}")


def quantile_of_percentile(percentile: Column, groups: int) -> Column:
    """Percentile 1..100 to ``groups`` groups as equal as whole percentiles allow (10 deciles, 5 quintiles)."""
    return F.ceil(percentile * groups / 100).cast("int")


def rank_quartile(rank: Column, thresholds: Sequence[int] = (18, 36, 54)) -> Column:
    """Rank to 1..len+1 by fixed thresholds."""
    out = None
    for i, t in enumerate(thresholds, start=1):
        out = F.when(rank <= t, i) if out is None else out.when(rank <= t, i)
    return out.when(rank > thresholds[-1], len(thresholds) + 1)


def _equal_bin(share: Column, bins: Column) -> Column:
    """The bin of ``share`` between the edges ``k * (1 / bins)`` and 1, right-closed; null at or below 0.

    The product guesses the bin; the two edges around it decide, so rounding cannot move a share.
    """
    step, guess = F.lit(1.0) / bins, F.ceil(share * bins) - 1
    upper = F.when(guess + 1 >= bins, F.lit(1.0)).otherwise((guess + 1) * step)
    index = F.when(share <= guess * step, guess - 1).when(share > upper, guess + 1).otherwise(guess)
    return F.when(share > 0, index)


def weighted_qcut(
    df: DataFrame,
    value: str,
    weight: str,
    q: int | Sequence[float] | None = None,
    per_group: int | None = None,
    into: str = "partition_index",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Bin each distinct value by its cumulative share of weight, right-closed, numbered from 0.

    ``q`` is a number of equal bins or a list of break points in 0..1; ``per_group`` instead
    derives the number of bins from the total weight (``ceil(total / per_group)``). Returns
    ``(value, weight, into)`` with one row per distinct value. Values are merged first, and the
    running total is sliced, so no step sorts the whole table in one task.
    """
    merged = df.groupBy(value).agg(F.sum(weight).alias(weight))
    spec = Running("_upto", [F.col(value)], F.col(weight), "_total")
    run = running_totals(merged, [], [spec], hot_rows)
    share = F.try_divide(F.col("_upto").cast("double"), F.col("_total"))
    if per_group is not None:
        index = _equal_bin(share, F.ceil(F.col("_total") / per_group))
    elif isinstance(q, int):
        index = _equal_bin(share, F.lit(q))
    elif q is not None:
        edges = F.array(*[F.lit(float(e)) for e in q])
        below = F.size(F.filter(edges, lambda e: e < share))
        index = F.when((below > 0) & (below < len(q)), below - 1)
    else:
        raise ValueError("give q or per_group")
    return run.select(value, weight, index.cast("int").alias(into))


def chunk_keys(assigned: DataFrame, value: str, into: str = "partition_index") -> DataFrame:
    """One row per chunk with its sorted list of keys.

    For chunks of bounded size, as ``weighted_qcut`` makes them with ``per_group``; a fixed number of
    chunks grows with the table, and its keys are better left as rows.
    """
    return assigned.groupBy(into).agg(F.sort_array(F.collect_list(value)).alias("keys"))
