"""Lenient cleaning expressions. Bad input becomes null; nothing here raises under ANSI mode."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def pad_left(c: Column, width: int) -> Column:
    """Left-pad with zeros; longer text is kept whole (``lpad`` alone would cut it)."""
    text = c.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def flag(c: Column, yes: Sequence[str]) -> Column:
    """True for the listed codes, null for everything else."""
    return F.when(c.cast("string").isin(*yes), F.lit(True))


def tri_flag(c: Column, yes: str, no: str) -> Column:
    """True, false, or null for any other code."""
    return F.when(c == yes, F.lit(True)).when(c == no, F.lit(False))


def domain(c: Column, allowed: Iterable[str]) -> Column:
    """The code as text if it is in the valid domain, else null."""
    text = c.cast("string")
    return F.when(text.isin(*allowed), text)


def in_range(c: Column, low: float, high: float) -> Column:
    """The value if ``low <= value <= high``, else null."""
    return F.when(c.between(low, high), c)


def sentinel_null(c: Column, value: object = 0) -> Column:
    """Null where the column holds the sentinel."""
    return F.nullif(c, F.lit(value))


def parse_yyyymmdd(c: Column) -> Column:
    """First eight-digit run in the text as a date; impossible dates become null."""
    return F.try_to_date(F.regexp_extract(c.cast("string"), r"\d{8}", 0), "yyyyMMdd")


def grouped_number(c: Column, missing: Sequence[str] = ("-", ".", "")) -> Column:
    """Number from text such as ``104,125``; missing markers and junk become null."""
    bare = F.regexp_replace(F.trim(c), ",", "")
    return F.when(~bare.isin(*missing), bare).try_cast("double")


def concat_or_first(first: Column, second: Column, separator: str = "_") -> Column:
    """``first + separator + second``, or just ``first`` when either part is missing."""
    a, b = first.cast("string"), second.cast("string")
    return F.coalesce(F.concat(a, F.lit(separator), b), a)


def geography_code(*parts: Column, length: int | None = None) -> Column:
    """Concatenated hierarchical code cut to ``length``; null if a part is missing."""
    code = F.concat(*[p.cast("string") for p in parts])
    return code if length is None else F.substring(code, 1, length)


def recode(c: Column, mapping: Mapping[object, object], default: Column | None = None) -> Column:
    """Fixed-map recode; unlisted values take ``default`` (null when omitted)."""
    out = None
    for src, dst in mapping.items():
        out = F.when(c == src, F.lit(dst)) if out is None else out.when(c == src, F.lit(dst))
    if out is None:
        raise ValueError("recode needs at least one entry")
    return out if default is None else out.otherwise(default)


def two_way(condition: Column, yes: object = 1, no: object = 0) -> Column:
    """Two-way recode that stays null when the condition is null."""
    return F.when(condition, F.lit(yes)).when(~condition, F.lit(no))


def substitute(primary: Column, alternate: Column, primary_out: Column, alternate_out: Column) -> Column:
    """``alternate_out`` where ``primary`` is zero or null and ``alternate`` is positive."""
    unusable = (primary == 0) | primary.isNull()
    return F.when(unusable & (alternate > 0), alternate_out).otherwise(primary_out)


def split_first(c: Column, separator: str) -> Column:
    """The part before the first match of the regex ``separator``."""
    return F.split(c, separator, 2)[0]


def sanitise_columns(
    df: DataFrame, pattern: str = r"\s+|\.|/|%|\(|\)", replacement: str = "_"
) -> DataFrame:
    """Lower-case all column names and replace awkward characters."""
    return df.toDF(*[re.sub(pattern, replacement, c).lower() for c in df.columns])


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Lenient bulk cast of named columns."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})
