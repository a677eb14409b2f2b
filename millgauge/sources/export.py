"""Report exports: parquet and CSV side by side, partitioned summary tables, named table sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from millgauge.operators.summary import Mode, one_table

#: The columns that tell the tables of a cube apart.
CUBE_KEYS = ("mode", "bin_family")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write one dataset, replacing an earlier one. CSV carries a header."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.option("compression", "snappy").parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def export_tables(named: Mapping[str, DataFrame], directory: str, fmt: str = "csv") -> list[str]:
    """One dataset per name under ``directory``; returns the paths."""
    paths = [f"{directory.rstrip('/')}/{name}" for name in named]
    for path, df in zip(paths, named.values()):
        write_table(df, path, fmt)
    return paths


def export_cube(cube: DataFrame, directory: str, keys: Sequence[str] = CUBE_KEYS) -> None:
    """The whole cube as one partitioned parquet dataset: one job, one directory per table."""
    cube.write.mode("overwrite").partitionBy(*keys).parquet(directory)


def export_queries(
    cube: DataFrame, modes: Sequence[Mode], families: Sequence[str], geo_key: str, directory: str
) -> list[str]:
    """Every (mode, bin family) table of the cube as parquet and CSV, named by its keys.

    ``cube`` should be staged (read back from :func:`export_cube`): every table is then one
    partition directory of that dataset.
    """
    paths = []
    for mode in modes:
        for family in families:
            table = one_table(cube, geo_key, family, mode)
            base = f"{directory.rstrip('/')}/{mode.name}_{geo_key}_{family}_query"
            write_table(table, f"{base}.parquet", "parquet")
            write_table(table, f"{base}.csv", "csv")
            paths.append(base)
    return paths
