"""Exact order statistics of all groups and measures at once, by digit-wise (radix) selection.

Every value has a first digit that does not depend on its group: the logarithm of its size in fine steps,
with its sign. A first pass counts (group, measure, digit), merged map-side, with the least and greatest
value of each such bin. Running sums over the bins of a group tell which bin holds each wanted rank. A bin
of one distinct value answers at once; a bin of few rows is fetched; a larger one is split into equal
steps between its least and greatest value and counted again. So a group costs some hundred counts, whatever its
size, and no task holds the values of a group.

Where every group is as small as a bin that would be fetched, there is nothing to split: the groups are
fetched at once, as sorted lists.

Digits need only be monotone, as bins carry their own bounds: logarithms, and differences and quotients of
doubles, never decrease when their argument grows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from millgauge.sources.staged import cut_lineage

#: First digits per doubling of a value, and equal steps of a bin that is split.
STEPS_PER_OCTAVE, SPLIT = 64, 4_096
#: A bin of at most this many rows is fetched instead of split.
FETCH_ROWS = 10_000
#: Tables of open bins of up to this many rows are broadcast; they are counted first.
BROADCAST_ROWS = 200_000

BIN = ["_m", "_d"]


def first_digit(value: Column) -> Column:
    """A number that never decreases with the value; null for null, the greatest for NaN."""
    size = F.greatest(F.abs(value), F.lit(5e-324))  # the smallest double above zero
    # 1,100 octaves lift every logarithm above zero, so that both signs stay in order
    step = F.floor((F.log2(size) + 1_100) * STEPS_PER_OCTAVE).cast("long")
    return (
        F.when(value.isNull(), F.lit(None).cast("long"))
        .when(F.isnan(value), F.lit(2**62))
        .when(value == 0, F.lit(0).cast("long"))
        .when(value > 0, step)
        .otherwise(-step)
    )


def long_values(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """keys, _m (place of the measure), _v (double) and its first digit _d; nulls stay, without a digit."""
    entries = [F.struct(F.lit(i).alias("_m"), F.col(m).cast("double").alias("_v")) for i, m in enumerate(measures)]
    long = df.select(*keys, F.explode(F.array(*entries)).alias("_x")).select(*keys, "_x.*")
    return long.withColumn("_d", first_digit(F.col("_v")))


def value_bins(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, _m, _d, _n (values), _lo, _hi; a group keeps a row for its nulls, with no values."""
    counted = [F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    return long.groupBy(*keys, *BIN).agg(*counted)


def merged_bins(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bins of finer groups added up for the coarser ``keys``."""
    counted = [F.sum("_n").alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")]
    return bins.groupBy(*keys, *BIN).agg(*counted)


def match(left: DataFrame, right: DataFrame, by: Sequence[str], small: bool) -> DataFrame:
    """Inner join on null-safe keys; ``right``'s keys go. It is broadcast if known to be ``small``."""
    renamed = right.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(by)})
    same = F.lit(True)
    for i, k in enumerate(by):
        same &= F.col(f"_l.{k}").eqNullSafe(F.col(f"_r._key_{i}"))
    renamed = (F.broadcast(renamed) if small else renamed).alias("_r")
    return left.alias("_l").join(renamed, same).drop(*[f"_key_{i}" for i in range(len(by))])


def select_ranks(
    bins: DataFrame,
    values: DataFrame,
    by: Sequence[str],
    ranks: Callable[[Column], Column],
    fetch_rows: int = FETCH_ROWS,
) -> DataFrame:
    """(by, _m, _size, _r, _v): the values of the wanted ranks (from 0) of every group and measure.

    ``bins`` come from ``value_bins`` over ``values`` (by, _m, _d, _v), a table or cheap to read again.
    ``ranks`` gives the array of ranks for a number of values and may look at ``_m``. A group and measure without
    values has a row of nulls. Each round reads the values once; a round splits every open bin into up to
    4,096, and two distinct values of a bin always part, so rounds are few.
    """
    group = W.partitionBy(*by, "_m")
    before = group.orderBy("_d").rowsBetween(W.unboundedPreceding, -1)
    placed = bins.withColumns(
        {"_from": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_size": F.sum("_n").over(group)}
    )
    placed = placed.withColumn("_wanted", F.when(F.col("_size") > 0, ranks(F.col("_size"))))
    one, few = F.col("_lo") == F.col("_hi"), F.col("_n") <= fetch_rows
    found = None
    while True:
        inside = F.filter("_wanted", lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_n")))
        kept = placed.withColumn("_wanted", F.array_distinct(inside)).where((F.size("_wanted") > 0) | (F.col("_size") == 0))
        kept = kept.select(*by, *BIN, "_size", "_n", "_lo", "_hi", "_from", "_wanted")
        seen = Observation()
        watched = kept.observe(seen, F.count_if(~one & few).alias("few"), F.count_if(~one & ~few).alias("many"))
        kept = cut_lineage(watched, "bins")
        n_few, n_many = seen.get["few"], seen.get["many"]
        answered = kept.where(one | (F.col("_size") == 0)).select(
            *by, "_m", "_size", F.explode_outer("_wanted").alias("_r"), F.col("_lo").alias("_v")
        )
        found = answered if found is None else found.unionByName(answered)
        within = F.col("_v").between(F.col("_lo"), F.col("_hi"))
        if n_few:
            wanted = kept.where(~one & few).select(*by, *BIN, "_size", "_lo", "_hi", "_from", "_wanted")
            fetched = match(values, wanted, [*by, *BIN], n_few <= BROADCAST_ROWS).where(within)
            held = [F.first(c).alias(c) for c in ("_size", "_wanted")]
            listed = fetched.groupBy(*by, *BIN, "_from").agg(F.sort_array(F.collect_list("_v")).alias("_vs"), *held)
            listed = listed.withColumn("_r", F.explode("_wanted"))
            picked = F.get("_vs", (F.col("_r") - F.col("_from")).cast("int")).alias("_v")
            found = found.unionByName(listed.select(*by, "_m", "_size", "_r", picked))
        if not n_many:
            return found
        opened = kept.where(~one & ~few).drop("_n")
        split = match(values, opened, [*by, *BIN], n_many <= BROADCAST_ROWS).where(within)
        part = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * SPLIT)
        held = [F.first(c).alias(c) for c in ("_size", "_wanted")]
        counted = split.groupBy(*by, *BIN, "_from", part.alias("_part")).agg(
            F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *held
        )
        line = W.partitionBy(*by, *BIN, "_from").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        placed = counted.withColumn("_from", F.col("_from") + F.coalesce(F.sum("_n").over(line), F.lit(0)))


def quantile_ranks(probs: Sequence[Sequence[float]]) -> Callable[[Column], Column]:
    """The ranks that quantiles of each measure interpolate between."""

    def wanted(size: Column) -> Column:
        out = F.lit(None).cast("array<bigint>")
        for i, ps in enumerate(probs):
            at = [f(F.lit(float(p)) * (size - 1)) for p in ps for f in (F.floor, F.ceil)]
            out = F.when(F.col("_m") == i, F.array(*at)).otherwise(out)
        return out

    return wanted


def between(at: Callable[[Column], Column], size: Column, prob: float) -> Column:
    """Linear interpolation between the two order statistics around ``prob * (size - 1)``."""
    spot = F.lit(float(prob)) * (size - 1)
    low, high = F.floor(spot), F.ceil(spot)
    below, above = at(low), at(high)
    return F.when((low == high) | (below == above), below).otherwise((high - spot) * below + (spot - low) * above)


def interpolated(found: DataFrame, by: Sequence[str], probs: Mapping[str, Sequence[float]]) -> DataFrame:
    """One array column of linearly interpolated quantiles per measure; null without values."""
    entry = F.when(F.col("_r").isNotNull(), F.struct("_r", "_v"))
    ranked = found.groupBy(*by, "_m", "_size").agg(F.map_from_entries(F.array_distinct(F.collect_list(entry))).alias("_ranked"))
    ranked = ranked.withColumn("_size", F.when(F.col("_size") > 0, F.col("_size")))
    at = lambda rank: F.element_at("_ranked", rank)
    columns = []
    for i, (m, ps) in enumerate(probs.items()):
        own = (F.col("_m") == i) & F.col("_size").isNotNull()
        columns.append(F.first(F.when(own, F.array(*[between(at, F.col("_size"), p) for p in ps])), ignorenulls=True).alias(m))
    return ranked.groupBy(*by).agg(*columns)


def listed_quantiles(df: DataFrame, by: Sequence[str], probs: Mapping[str, Sequence[float]]) -> DataFrame:
    """The same for groups that are all small enough to be fetched, in one aggregation."""
    listed = df.groupBy(*by).agg(*[F.sort_array(F.collect_list(F.col(m).cast("double"))).alias(m) for m in probs])
    columns = []
    for m, ps in probs.items():
        at = lambda rank, m=m: F.get(m, rank.cast("int"))
        columns.append(F.when(F.size(m) > 0, F.array(*[between(at, F.size(m), p) for p in ps])).alias(m))
    return listed.select(*by, *columns)
