"""Delimited text: tolerant, schema-first reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from millgauge.functions.clean import grouped_number
from millgauge.schemas import BENCHMARK_MONEY, BENCHMARK_RATES

BAD_RECORD = "_corrupt_record"


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    separator: str = "|",
    header: bool = True,
    report_bad: bool = False,
) -> DataFrame:
    """Read text with an explicit schema.

    A cell that does not parse becomes null, surplus fields are dropped, short rows are padded with
    nulls. ``report_bad`` adds the original line of every such row in ``_corrupt_record``. With a
    header, columns are matched by name, so the files may hold more columns, in any order; a file
    whose header differs from the first one's is refused rather than misread.
    """
    if not header:
        return _read(spark, path, schema, separator, False, report_bad)
    names = spark.read.option("sep", separator).option("header", True).csv(path).columns
    wanted = {f.name: f for f in schema.fields}
    found = T.StructType([wanted.get(n, T.StructField(n, T.StringType())) for n in names])
    rows = _read(spark, path, found, separator, True, report_bad)
    extra = [BAD_RECORD] if report_bad else []
    return rows.select(
        *[
            F.col(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ],
        *extra,
    )


def _read(spark, path, schema, separator, header, report_bad) -> DataFrame:
    reader = (
        spark.read.option("sep", separator)
        .option("header", header)
        .option("enforceSchema", not header)
        .option("mode", "PERMISSIVE")
    )
    if report_bad:
        schema = T.StructType([*schema.fields, T.StructField(BAD_RECORD, T.StringType())])
        # unread columns must still be parsed for a short or long row to be noticed
        reader = reader.option("columnNameOfCorruptRecord", BAD_RECORD).option("columnPruning", False)
    return reader.schema(schema).csv(path)


#: Types from the narrowest to the widest that holds any cell, with the cells each one takes whole.
LADDER = {
    "bigint": r"[+-]?\d+",
    "double": r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?",
    "date": r"\d{4}-\d{2}-\d{2}",
    "timestamp": r"\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?",
}


def _fits(cell: Column, kind: str) -> Column:
    """Does the type hold the cell without loss? Whole numbers from 2**53 on are not doubles."""
    fits = F.rlike(cell, F.lit(rf"^({LADDER[kind]})\z")) & cell.try_cast(kind).isNotNull()
    if kind == "double":
        whole = F.rlike(cell, F.lit(rf"^({LADDER['bigint']})\z"))
        fits &= ~whole | (F.abs(cell.try_cast("double")) < F.lit(2.0**53))
    return fits


def inferred_types(cells: DataFrame) -> dict[str, str]:
    """For every string column the narrowest type of :data:`LADDER` that holds all its cells, else string.

    One pass over all rows; what a task has seen of a column merges into one bit per type, so no cell
    escapes and nothing but these bits is shuffled. A column without values is a string.
    """
    seen = []
    for i, c in enumerate(cells.columns):
        cell = F.col(f"`{c}`")
        seen.append(F.count(cell).alias(f"n{i}"))
        seen += [F.bool_and(F.when(cell.isNotNull(), _fits(cell, kind))).alias(f"{kind}{i}") for kind in LADDER]
    found = cells.agg(*seen).first()
    return {
        c: next((kind for kind in LADDER if found[f"n{i}"] and found[f"{kind}{i}"]), "string")
        for i, c in enumerate(cells.columns)
    }


def read_inferred(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Read text with types found in all rows, so that no cell is lost; prefer :func:`read_delimited`.

    Empty cells are null. One cell that is no number makes its column a string.
    """
    cells = spark.read.option("sep", separator).option("header", True).csv(path)
    kinds = inferred_types(cells)
    return cells.select(*[F.col(f"`{c}`").try_cast(kind).alias(c) for c, kind in kinds.items()])


def read_benchmark_rates(spark: SparkSession, path: str) -> DataFrame:
    """Statutory-rate table with its grouped-digit money columns as numbers."""
    raw = read_delimited(spark, path, BENCHMARK_RATES, ",")
    return raw.withColumns({c: grouped_number(F.col(c)) for c in BENCHMARK_MONEY})
