"""Recency ranks of a transaction table: both for every row, or for the newest row per period alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from millgauge.operators.heavy import HOT_ROWS, Running, running_totals, split_heavy
from millgauge.operators.ranks import newest_first


def recency_ranks(
    df: DataFrame,
    entity: str,
    period: str,
    date: str,
    tiebreak: str,
    by_period: str = "RecentSaleByYear",
    overall: str = "MostRecentSale",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Rank within ``(period, entity)`` and within ``entity``, newest = 1, null without a date.

    ``period`` is any column. Both windows of ordinary entities run on one shuffle by ``entity``. For an
    entity with more than ``hot_rows`` rows both ranks are sliced, one per entity and one per entity and
    period, in the same order as the plain windows.
    """
    light, heavy = split_heavy(df, [entity], hot_rows)
    newest = [F.col(date).desc_nulls_last(), F.col(tiebreak).asc()]
    dated = F.col(date).isNotNull()
    overall_rank = F.row_number().over(W.partitionBy(entity).orderBy(*newest)).cast("long")
    period_rank = F.row_number().over(W.partitionBy(entity, period).orderBy(*newest)).cast("long")
    ranked = light.withColumns(
        {by_period: F.when(dated, period_rank), overall: F.when(dated, overall_rank)}
    )
    if heavy is None:
        return ranked

    order = newest_first(heavy, date, tiebreak)
    sliced = running_totals(heavy, [entity], [Running("_overall", order)], hot_rows)
    sliced = running_totals(sliced, [entity, period], [Running("_inside", order)], hot_rows)
    sliced = sliced.withColumns(
        {
            by_period: F.when(dated, F.col("_inside")),
            overall: F.when(dated, F.col("_overall")),
        }
    ).drop("_inside", "_overall")
    return ranked.unionByName(sliced)


def newest_per_period(
    df: DataFrame,
    entity: str,
    period: str,
    date: str,
    tiebreak: str,
    by_period: str = "RecentSaleByYear",
    overall: str = "MostRecentSale",
) -> DataFrame:
    """The rows that :func:`recency_ranks` ranks first in their period, with both ranks.

    ``period`` must follow from ``date``, as a year does. Then a row that is first in its period is also first
    on its date, and its overall rank is 1 plus the rows of the entity on later dates. So nothing is
    sorted whole: each map task sends one row per entity and period (``row_number() = 1``), and
    counts per entity and date, which merge map-side; an entity has at most as many of those as there are dates.
    """
    dated = df.where(F.col(date).isNotNull())
    newest = W.partitionBy(entity, period).orderBy(F.col(date).desc(), F.col(tiebreak).asc())
    first = dated.withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place")
    counts = dated.groupBy(F.col(entity).alias("_entity"), F.col(date).alias("_date")).agg(F.count(F.lit(1)).alias("_rows"))
    later = W.partitionBy("_entity").orderBy(F.col("_date").desc()).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("_entity", "_date", F.coalesce(F.sum("_rows").over(later), F.lit(0)).alias("_later"))
    same = first[entity].eqNullSafe(counts["_entity"]) & (first[date] == counts["_date"])
    ranks = {by_period: F.lit(1).cast("long"), overall: F.col("_later") + 1}
    return first.join(counts, same).withColumns(ranks).drop("_entity", "_date", "_later")
