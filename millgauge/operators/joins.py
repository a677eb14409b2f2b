"""Equi-joins with renamed keys, role-playing and fallback lookups, coverage and spines.

Dimension sides carry no broadcast hint: Spark broadcasts them when their measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, splitting skewed partitions at
run time (``spark.sql.adaptive.skewJoin``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


def equi_join(
    left: DataFrame,
    right: DataFrame,
    on: Mapping[str, str] | Sequence[str],
    how: str = "inner",
    null_safe: bool = False,
) -> DataFrame:
    """Join on pairs ``{left: right}``; the right key columns are dropped.

    ``null_safe=True`` lets null match null, as R's ``left_join`` does; otherwise null never matches.
    """
    pairs = dict(on) if isinstance(on, Mapping) else {k: k for k in on}
    renamed = right.withColumnsRenamed({r: f"_right_{i}" for i, r in enumerate(pairs.values())})
    match = None
    for i, l in enumerate(pairs):
        a, b = left[l], renamed[f"_right_{i}"]
        same = a.eqNullSafe(b) if null_safe else a == b
        match = same if match is None else match & same
    out = left.join(renamed, match, how)
    return out.drop(*[f"_right_{i}" for i in range(len(pairs))])


def coverage(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Keys of ``df`` that ``other`` lacks."""
    return df.select(key).join(other.select(key), key, "left_anti")


def in_values_of(
    df: DataFrame, other: DataFrame, left_on: str, right_on: str, cast: str | None = None
) -> DataFrame:
    """Rows whose key occurs in another table's column, optionally compared as ``cast``.

    ``cast='int'`` makes ``'0107000'`` meet ``107000``.
    """
    keys = other.select(
        (F.col(right_on).try_cast(cast) if cast else F.col(right_on)).alias("_value")
    ).distinct()
    key = df[left_on].try_cast(cast) if cast else df[left_on]
    return df.join(keys, key == keys["_value"], "left_semi")


def role_lookup(
    df: DataFrame,
    dim: DataFrame,
    entity: str,
    dim_entity: str,
    dim_period: str,
    measure: str,
    roles: Mapping[str, tuple[str, str]],
) -> DataFrame:
    """Look the same measure up several times, by different period columns.

    ``roles`` maps an output column to ``(period column of df, how)``.
    """
    out = df
    for into, (period, how) in roles.items():
        side = dim.select(dim_entity, dim_period, F.col(measure).alias(into))
        out = equi_join(out, side, {entity: dim_entity, period: dim_period}, how)
    return out


@dataclass(frozen=True)
class Level:
    """One level of a fallback lookup: a table, its key, and its value columns by output name."""

    table: DataFrame
    left_on: str
    right_on: str
    values: Mapping[str, str]


def left_lookup(df: DataFrame, table: DataFrame, on: Mapping[str, str]) -> DataFrame:
    return equi_join(df, table, on, "left")


def fallback_lookup(
    df: DataFrame, levels: Sequence[Level], join: Callable[[DataFrame, DataFrame, Mapping[str, str]], DataFrame] = left_lookup
) -> DataFrame:
    """Fill each output from the first level that has it, independently per output.

    The column's own value counts as level zero. Each level is one left join on a unique key, made by ``join``;
    see :func:`millgauge.operators.lookup.skew_safe_lookup` for keys that hold many rows.
    """
    out, found = df, {}
    for i, level in enumerate(levels):
        names = {v: f"_level{i}_{o}" for o, v in level.values.items()}
        side = level.table.select(level.right_on, *level.values.values()).withColumnsRenamed(names)
        out = join(out, side, {level.left_on: level.right_on})
        for o, v in level.values.items():
            found.setdefault(o, []).append(names[v])
    filled = {
        o: F.coalesce(*([F.col(o)] if o in df.columns else []), *[F.col(c) for c in cs])
        for o, cs in found.items()
    }
    return out.withColumns(filled).drop(*[c for cs in found.values() for c in cs])


def spine_join(
    spine: DataFrame, tables: Sequence[tuple[DataFrame, Mapping[str, str]]]
) -> DataFrame:
    """Chain of left joins of summary tables onto a spine."""
    out = spine
    for table, on in tables:
        out = equi_join(out, table, on, "left")
    return out
