"""Heavy groups: finding them, and ordering rows inside them without one giant task.

A window ``partitionBy(key)`` puts every row of a key into one task. That is fine until
one key holds a large share of the table. The operators of this package therefore look first
(:func:`has_heavy`, one map-side combined count per key, of which only a yes or no reaches the
driver). Without heavy groups they use the plain window or aggregate. With them, groups above
``hot_rows`` rows are cut into ordered slices of roughly ``hot_rows`` rows, the window runs per
slice, and a small table of slice totals supplies what came before.

The look and the slicing read the input more than once, so hand these operators a staged table
rather than a long chain of joins (the pipeline does).

Broadcast bound: a table of N rows has at most ``N / hot_rows`` groups with more than
``hot_rows`` rows, and at most that many slices, whatever the key distribution. With the
default of one million rows this is a million rows for a table of 10^12 rows. Only tables
with this bound carry a broadcast hint in this package.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

HOT_ROWS = 1_000_000
SEARCH_STEPS = 31  # binary search over any number of cut points that fits an array
SAMPLES_PER_SLICE = 16


def attach(df: DataFrame, bounded: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Join a size-bounded table onto ``df`` by null-safe key equality.

    ``bounded`` must be small by construction (see the module note); it is broadcast, so the
    large side is neither shuffled nor skewed. Without keys ``bounded`` is a one-row table and
    becomes a scalar subquery.
    """
    if not by:
        row = bounded.select(F.struct(*bounded.columns)).scalar()
        out = df.withColumn("_row", row).select("*", "_row.*").drop("_row")
        return out
    renamed = bounded.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(by)})
    match = None
    for i, k in enumerate(by):
        same = df[k].eqNullSafe(renamed[f"_key_{i}"])
        match = same if match is None else match & same
    out = df.join(F.broadcast(renamed), match, how)
    return out.drop(*[f"_key_{i}" for i in range(len(by))])


def heavy_groups(df: DataFrame, by: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Groups with more than ``hot_rows`` rows and their size ``_n`` (counts combine map-side)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)


def has_heavy(df: DataFrame, by: Sequence[str], hot_rows: int | None = HOT_ROWS) -> bool:
    """Is there any group with more than ``hot_rows`` rows? Runs one job.

    ``None`` says the caller already knows that there is none (a coarser grouping had none).
    """
    if hot_rows is None:
        return False
    return not heavy_groups(df, by, hot_rows).isEmpty()


def split_heavy(
    df: DataFrame, by: Sequence[str], hot_rows: int | None = HOT_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """``(light, heavy)``: rows of ordinary groups, and rows of heavy ones or None."""
    if not has_heavy(df, by, hot_rows):
        return df, None
    if not by:
        return df.limit(0), df
    hot = heavy_groups(df, by, hot_rows).drop("_n")
    return attach(df, hot, by, "left_anti"), attach(df, hot, by, "left_semi")


def _slice_of(cuts: Column, key: Column) -> Column:
    """How many cut points lie below ``key``, by binary search."""
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(SEARCH_STEPS - 1))])
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(
            (step <= F.size(cuts) - at) & (F.get(cuts, at + step - 1) < key), at + step
        ).otherwise(at),
    )
    return F.when(cuts.isNull(), F.lit(0)).otherwise(found)


def slice_heavy(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    hot_rows: int = HOT_ROWS,
    samples: DataFrame | None = None,
) -> DataFrame:
    """Add ``_hot_n`` (size of a heavy group, else null) and ``_slice`` (0 in ordinary groups).

    Slices are consecutive in ``order`` (ascending), so all rows of slice ``s`` precede all rows
    of slice ``s + 1``. Cut points come from rows picked by a hash of their order key: the pick
    does not depend on partitioning, so a recomputed task lands on the same slices, and the
    result does not depend on the pick at all, only the balance does. ``samples`` is the table to
    pick from when ``df`` is a wider version of it.
    """
    source = df if samples is None else samples
    key = F.struct(*[F.col(c) for c in order])
    hot = heavy_groups(source, by, hot_rows).withColumn(
        "_k", F.expr(f"_n div {hot_rows}") + 1
    )
    every = F.greatest(F.expr(f"_n div (_k * {SAMPLES_PER_SLICE})"), F.lit(1))
    picked = (
        attach(source.select(*by, *order), hot, by, "inner")
        .where(F.pmod(F.xxhash64(*order), every) == 0)
        .groupBy(*by, "_n", "_k")
        .agg(F.sort_array(F.collect_set(key)).alias("_picked"))
    )
    cuts = picked.select(
        *by,
        F.col("_n").alias("_hot_n"),
        F.transform(
            F.sequence(F.lit(1).cast("long"), F.col("_k") - 1),
            lambda i: F.get("_picked", (F.floor(i * F.size("_picked") / F.col("_k"))).cast("int")),
        ).alias("_cuts"),
    )
    return (
        attach(df, cuts, by, "left")
        .withColumn("_slice", _slice_of(F.col("_cuts"), key))
        .drop("_cuts")
    )


@dataclass(frozen=True)
class Running:
    """A running sum of ``weight`` (a row number when None) in ascending ``order``, as ``into``.

    Negate numeric sort expressions for a descending order and end with a unique column, so that
    the result is deterministic. ``total`` names an optional column for the whole-group sum.
    """

    into: str
    order: Sequence[Column]
    weight: Column | None = None
    total: str | None = None


def running_totals(
    df: DataFrame, by: Sequence[str], specs: Sequence[Running], hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Add one or more running totals within ``by``.

    Ordinary groups: plain windows sharing one shuffle on ``by``. Heavy groups: one shuffle per
    spec on ``(by, slice)`` plus the totals of the slices before.
    """
    keyed, names = df, []
    for i, spec in enumerate(specs):
        names.append([f"_o{i}_{j}" for j in range(len(spec.order))])
        weight = {} if spec.weight is None else {f"_w{i}": spec.weight}
        keyed = keyed.withColumns({**dict(zip(names[i], spec.order)), **weight})
    results = [s.into for s in specs] + [s.total for s in specs if s.total]
    columns = [*[c for c in df.columns if c not in results], *results]

    def running(i: int, part) -> Column:
        if specs[i].weight is None:
            return F.row_number().over(part.orderBy(*names[i])).cast("long")
        frame = part.orderBy(*names[i]).rowsBetween(W.unboundedPreceding, W.currentRow)
        return F.sum(f"_w{i}").over(frame)

    def whole(i: int) -> Column:
        return F.count(F.lit(1)) if specs[i].weight is None else F.sum(f"_w{i}")

    if not has_heavy(df, by, hot_rows):
        part = W.partitionBy(*by)
        added = {s.into: running(i, part) for i, s in enumerate(specs)}
        added |= {s.total: whole(i).over(part) for i, s in enumerate(specs) if s.total}
        return keyed.withColumns(added).select(*columns)

    out, before = keyed, []
    for i in range(len(specs)):
        sliced = slice_heavy(keyed, by, names[i], hot_rows)
        inside = W.partitionBy(*by)
        before.append(
            sliced.where(F.col("_hot_n").isNotNull())
            .groupBy(*by, "_slice")
            .agg(whole(i).alias("_s"))
            .select(
                *by,
                F.col("_slice").alias(f"_slice{i}"),
                F.sum("_s")
                .over(inside.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
                .alias(f"_before{i}"),
                F.sum("_s").over(inside).alias(f"_all{i}"),
            )
        )
        out = slice_heavy(out, by, names[i], hot_rows, samples=keyed).withColumnRenamed(
            "_slice", f"_slice{i}"
        ).drop("_hot_n")
    for i, spec in enumerate(specs):
        part = W.partitionBy(*by, f"_slice{i}")
        added = {f"_local{i}": running(i, part)}
        if spec.total:
            added[f"_whole{i}"] = whole(i).over(part)
        out = attach(out.withColumns(added), before[i], [*by, f"_slice{i}"], "left")
        earlier = F.col(f"_before{i}")
        final = {
            spec.into: F.when(earlier.isNull(), F.col(f"_local{i}")).otherwise(
                F.col(f"_local{i}") + earlier
            )
        }
        if spec.total:
            final[spec.total] = F.coalesce(f"_all{i}", f"_whole{i}")
        out = out.withColumns(final).drop(
            f"_slice{i}", f"_local{i}", f"_whole{i}", f"_before{i}", f"_all{i}"
        )
    return out.select(*columns)
