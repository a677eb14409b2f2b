"""Grid completion, pivots, unpivots, unions and ordered category helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from millgauge.operators.joins import equi_join


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def complete(
    df: DataFrame,
    entity: Sequence[str],
    period: str,
    fill: Mapping[str, object] | None = None,
    entities: DataFrame | None = None,
) -> DataFrame:
    """All combinations of the occurring entity tuples and periods; missing cells become null.

    Several entity columns are kept together as they co-occur. The distinct periods (years) travel
    as one array value and are exploded per entity, so the grid is made without a product join.
    ``fill`` gives defaults for cells that are null afterwards.
    """
    periods = df.select(period).distinct().agg(F.sort_array(F.collect_list(period))).scalar()
    keys = (entities if entities is not None else df).select(*entity).distinct()
    grid = keys.withColumn(period, F.explode(periods))
    out = equi_join(grid, df, [*entity, period], "left", null_safe=True)
    return out.fillna(dict(fill)) if fill else out


def to_long(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], names_to: str, values_to: str
) -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(columns), names_to, values_to)


def pivot_single(
    df: DataFrame,
    ids: Sequence[str],
    names: str,
    value: str,
    categories: Sequence[object],
    template: str = "{category}_{value}",
) -> DataFrame:
    """Long to wide for one value column, with a name template.

    Several rows for one cell keep the largest value.
    """
    wide = df.groupBy(*ids).pivot(names, list(categories)).agg(F.max(value))
    return wide.withColumnsRenamed(
        {str(c): template.format(category=c, value=value) for c in categories}
    )


def pivot_multi(
    df: DataFrame,
    ids: Sequence[str],
    names: str,
    values: Sequence[str],
    categories: Sequence[object],
) -> DataFrame:
    """Long to wide for several value columns, named ``{value}_{category}``.

    A missing category gives null; several rows for one cell keep the largest value.
    """
    aggs = [F.max(v).alias(v) for v in values]
    if len(values) == 1:
        return pivot_single(df, ids, names, values[0], categories, "{value}_{category}")
    wide = df.groupBy(*ids).pivot(names, list(categories)).agg(*aggs)
    return wide.withColumnsRenamed({f"{c}_{v}": f"{v}_{c}" for c in categories for v in values})


def first_distinct(df: DataFrame, column: str, n: int) -> DataFrame:
    """The first ``n`` distinct values in sort order."""
    return df.select(column).distinct().orderBy(column).limit(n)


def with_category_order(df: DataFrame, column: str, levels: Sequence[object], into: str) -> DataFrame:
    """Position of a category in an explicit level list; unlisted values get null."""
    out = F.when(F.col(column) == levels[0], 1)
    for i, level in enumerate(levels[1:], start=2):
        out = out.when(F.col(column) == level, i)
    return df.withColumn(into, out)
