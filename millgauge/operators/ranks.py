"""Ranks, latest-per-key, percentiles, tiles, modal periods and directional fills."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millgauge.operators.heavy import HOT_ROWS, Running, running_totals


def newest_first(df: DataFrame, date: str, tiebreak: str) -> list[Column]:
    """Ascending sort keys for the newest first at full precision, rows without a date last."""
    kind = df.schema[date].dataType.typeName()
    if kind == "date":
        key = F.unix_date(F.col(date)).cast("long")
    elif kind.startswith("timestamp"):
        key = F.unix_micros(F.col(date).cast("timestamp"))
    else:
        key = F.col(date)
    return [F.col(date).isNull(), -key, F.col(tiebreak)]


def recency_rank(
    df: DataFrame,
    keys: Sequence[str],
    date: str,
    tiebreak: str,
    into: str,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Unique rank per key, newest date = 1; a row without a date gets no rank.

    Ties are broken by ``tiebreak`` ascending, so reruns give the same ranks. Rows without a
    date sort last and do not use up a rank.
    """
    ranked = running_totals(df, keys, [Running("_rank", newest_first(df, date, tiebreak))], hot_rows)
    return ranked.withColumn(into, F.when(F.col(date).isNotNull(), F.col("_rank"))).drop("_rank")


def latest(
    df: DataFrame, keys: Sequence[str], date: str, tiebreak: str, qualifies: Column | None = None
) -> DataFrame:
    """The newest row per key, kept only if it qualifies.

    The rank comes first: a newer row that does not qualify hides an older one that does.
    ``row_number() = 1`` lets Spark cut each map task's rows to one per key before the shuffle
    (``WindowGroupLimit``), so a key with very many rows sends one row per map task.
    """
    newest = W.partitionBy(*keys).orderBy(F.col(date).desc_nulls_last(), F.col(tiebreak).asc())
    top = (
        df.withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") == 1)
        .where(F.col(date).isNotNull())
        .drop("_rank")
    )
    return top if qualifies is None else top.where(qualifies)


def first_by_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Drop duplicates by key, keeping the first row in ``order``."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def percentile_ranks(
    df: DataFrame,
    values: Mapping[str, str],
    by: Sequence[str],
    tiebreak: str | Sequence[str],
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Whole-number percentiles 1..100 within ``by``, 1 holding the highest values.

    ``values`` maps output to value columns. ``ceil(rank / count * 100)`` in double arithmetic,
    with the division first: ``7 / 100 * 100`` is slightly above 7 and gives 8, as in the published
    numbers. Null values get no percentile. ``tiebreak`` should tell all rows of equal value apart.
    """
    ties = [F.col(c) for c in ([tiebreak] if isinstance(tiebreak, str) else tiebreak)]
    specs = [
        Running(
            f"_rank_{into}", [F.col(v).isNull(), -F.col(v), *ties], total=f"_size_{into}"
        )
        for into, v in values.items()
    ]
    ranked = running_totals(df, by, specs, hot_rows)
    out = {}
    for into, v in values.items():
        share = F.col(f"_rank_{into}").cast("double") / F.col(f"_size_{into}")
        out[into] = F.when(F.col(v).isNotNull(), F.ceil(share * 100)).cast("int")
    return ranked.withColumns(out).drop(*[s.into for s in specs], *[s.total for s in specs])


def percentile_rank(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    tiebreak: str | Sequence[str],
    into: str,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """One percentile column; see :func:`percentile_ranks`."""
    return percentile_ranks(df, {into: value}, by, tiebreak, hot_rows)


def ntile(
    df: DataFrame,
    value: str,
    tiles: int,
    by: Sequence[str],
    tiebreak: str,
    into: str,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Tile number 1..tiles by ascending value; the first tiles take the remainder rows."""
    present = F.col(value).isNotNull()
    order = [~present, F.col(value), F.col(tiebreak)]
    specs = [Running("_rank", order), Running("_count", order, present.cast("long"), "_size")]
    ranked = running_totals(df, by, specs, hot_rows)
    base, extra = F.expr(f"_size div {tiles}"), F.col("_size") % tiles
    wide = extra * (base + 1)
    tile = F.when(
        F.col("_rank") <= wide, F.ceil(F.col("_rank") / (base + 1))
    ).otherwise(extra + F.ceil(F.try_divide(F.col("_rank") - wide, base)))
    return ranked.withColumn(into, F.when(present, tile).cast("int")).drop("_rank", "_size", "_count")


def global_rank(
    df: DataFrame, value: str, tiebreak: str, into: str, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Row number over the whole table, highest value = 1; a null value gets no rank."""
    order = [F.col(value).isNull(), -F.col(value), F.col(tiebreak)]
    ranked = running_totals(df, [], [Running("_rank", order)], hot_rows)
    return ranked.withColumn(into, F.when(F.col(value).isNotNull(), F.col("_rank"))).drop("_rank")


def dense_rank_values(
    df: DataFrame, value: str, into: str, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Dense rank (ascending) over the whole table of a group-level statistic.

    Distinct values are ranked and joined back, so rows are never pulled into one window.
    """
    distinct = df.select(value).where(F.col(value).isNotNull()).distinct()
    ranks = running_totals(distinct, [], [Running(into, [F.col(value)])], hot_rows)
    return df.join(ranks, value, "left")


def group_total(df: DataFrame, by: Sequence[str], measure: Column, into: str) -> DataFrame:
    """Sum of ``measure`` per group on every row: aggregated first, then joined back.

    A window sum would put a whole group into one task; this combines map-side, and the join
    back is one Spark can broadcast or split when skewed.
    """
    totals = df.groupBy(*by).agg(measure.alias(into))
    right = totals.withColumnsRenamed({k: f"_key_{k}" for k in by})
    match = None
    for k in by:
        same = df[k].eqNullSafe(right[f"_key_{k}"])
        match = same if match is None else match & same
    return df.join(right, match, "left").drop(*[f"_key_{k}" for k in by])


def modal_period(
    df: DataFrame,
    entity: Sequence[str],
    period: str,
    ties: str = "dense",
    weight: Column | None = None,
    min_total: int = 0,
) -> DataFrame:
    """The busiest period(s) of each entity: ``(entity, period, period_total)``.

    ``ties='dense'`` keeps all tied periods, ``ties='first'`` the earliest of them. The rank runs
    on the aggregated ``(entity, period)`` table, never on rows.
    """
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    totals = df.groupBy(*entity, period).agg(size.alias("period_total"))
    w = W.partitionBy(*entity)
    if ties == "dense":
        place = F.dense_rank().over(w.orderBy(F.desc("period_total")))
    else:
        place = F.row_number().over(w.orderBy(F.desc("period_total"), F.asc(period)))
    return (
        totals.withColumn("_place", place)
        .where((F.col("_place") == 1) & (F.col("period_total") > min_total))
        .drop("_place")
    )


def keep_modal_period(
    df: DataFrame, entity: Sequence[str], period: str, ties: str = "dense", min_total: int = 0
) -> DataFrame:
    """Only the rows of each entity's busiest period."""
    modal = modal_period(df, entity, period, ties, min_total=min_total).drop("period_total")
    keys = [*entity, period]
    right = modal.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    match = None
    for k in keys:
        same = df[k].eqNullSafe(right[f"_key_{k}"])
        match = same if match is None else match & same
    return df.join(right, match, "left_semi")


def fill_down_up(
    df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, str]
) -> DataFrame:
    """Fill nulls from the row before, then from the row after, per key.

    ``columns`` maps source to target names. Meant for panels with one row per key and period,
    whose groups are as long as the number of periods.
    """
    past = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = W.partitionBy(*keys).orderBy(order).rowsBetween(W.currentRow, W.unboundedFollowing)
    return df.withColumns(
        {
            into: F.coalesce(
                F.last(src, ignorenulls=True).over(past), F.first(src, ignorenulls=True).over(ahead)
            )
            for src, into in columns.items()
        }
    )
