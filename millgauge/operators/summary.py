"""Summary tables: the 25-measure group summary and its cube over bins and time modes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millgauge.functions.bins import quantile_of_percentile
from millgauge.operators.heavy import HOT_ROWS, has_heavy
from millgauge.operators.quantiles import join_null_safe
from millgauge.operators.ranks import percentile_rank
from millgauge.operators.selection import (
    FETCH_ROWS,
    interpolated,
    listed_quantiles,
    long_values,
    merged_bins,
    quantile_ranks,
    select_ranks,
    value_bins,
)
from millgauge.sources.staged import cut_lineage

# Which statistics the published tables carry per measure.
ALL = ("sum", "mean", "median", "std")
SPREAD = ("mean", "median", "std")
MEASURES = {
    "TaxAmt": ALL,
    "TaxRate": SPREAD,
    "SaleAmt": ALL,
    "AssdTotalValue_HPI2021_Imputed": ALL,
    "AssdValue_SaleAmt_Ratio": SPREAD,
    "TaxAmt_to_AssdValue_SaleAmt_Ratio": SPREAD,
}
COUNTED = ("TaxAmt", "SaleAmt")


@dataclass(frozen=True)
class Mode:
    """A time mode: which rows count, the period column, and the columns used as measures."""

    name: str
    period: str
    recency: str
    columns: Mapping[str, str] = field(default_factory=dict)
    period_type: str = "string"

    def column(self, measure: str) -> str:
        return self.columns.get(measure, measure)


SNAPSHOT = Mode("Snapshot", "SaleRecordingYear", "RecentSaleByYear", period_type="int")
POOLED = Mode(
    "Pooled",
    "SaleRecordingYear_Bins",
    "MostRecentSale",
    {"TaxAmt": "TaxAmt_HPI2021", "TaxRate": "TaxRate_HPI2021", "SaleAmt": "SaleAmt_HPI2021"},
)


@dataclass(frozen=True)
class State:
    """What summaries need of some rows, by finest group: tables that merge into coarser groups.

    ``groups`` holds counts and, per measure, number, sum and squared deviations; ``bins`` the counts of first
    digits, for exact medians of large groups; ``ids`` the ids, made distinct once per coarser group. They stay rows: a
    bitmap aggregate takes four kilobytes for each group and range of 32,768 ids, more than the few ids that
    a finest group has of a range.
    """

    rows: DataFrame
    keys: Sequence[str]
    measures: Sequence[str]

    @property
    def groups(self) -> DataFrame:
        moments = [F.count(F.lit(1)).alias("_count")]
        for i, m in enumerate(self.measures):
            squares = F.var_pop(m) * F.count(m)
            moments += [F.count(m).alias(f"_n{i}"), F.sum(m).alias(f"_s{i}"), squares.alias(f"_q{i}")]
        return self.rows.groupBy(*self.keys).agg(*moments)

    @property
    def ids(self) -> DataFrame:
        return self.rows.select(*self.keys, "_id")

    @property
    def bins(self) -> DataFrame:
        return value_bins(long_values(self.rows, self.keys, self.measures), self.keys)


def summary_state(rows: DataFrame, keys: Sequence[str], id_col: str, measures: Sequence[str]) -> State:
    """The mergeable state of the finest groups ``keys``. The rows are staged, so they are evaluated once."""
    narrow = rows.select(F.col(id_col).alias("_id"), *keys, *[F.col(m).cast("double").alias(m) for m in measures])
    return State(cut_lineage(narrow, "summary_rows"), keys, measures)


def roll_up(
    state: State,
    expand: Callable[[DataFrame], DataFrame],
    by: Sequence[str],
    wanted: Mapping[str, Sequence[str]],
    column: Callable[[str], Column],
    counted: Sequence[str],
    unique: str,
    large: bool,
    fetch_rows: int = FETCH_ROWS,
) -> DataFrame:
    """Summary tables from the state: counts, distinct ids, sums, means, medians, standard deviations.

    Medians come from sorted lists, or, if some group is ``large`` (of more than ``fetch_rows`` rows), from digits
    counted per finest group and merged.

    ``expand`` gives a row of the finest groups once for each coarser group ``by`` that it belongs to, with the
    columns it came with. ``column`` names, per expanded row, the measure of the state that a wanted measure
    stands for. Deviations of a group are those inside its parts and those of the parts' means, so nothing large cancels.
    """
    of = list(state.measures)

    def of_measure(measure: str) -> Column:
        out = F.lit(None).cast("double")
        for name in of:
            out = F.when(column(measure) == name, F.col(name)).otherwise(out)
        return out

    def cell(prefix: str, measure: str) -> Column:
        out = F.lit(None)
        for i, name in enumerate(of):
            out = F.when(column(measure) == name, F.col(f"{prefix}{i}")).otherwise(out)
        return out

    parts = expand(state.groups)
    parts = parts.select(
        *by, "_count", *[cell(p, m).alias(f"{p}:{m}") for m in wanted for p in ("_n", "_s", "_q")]
    )
    group = W.partitionBy(*by)
    means = {f"_mean:{m}": F.try_divide(F.sum(f"_s:{m}").over(group), F.sum(f"_n:{m}").over(group)) for m in wanted}
    parts = parts.withColumns(means)
    out = [F.sum("_count").alias("count")]
    out += [F.sum(f"_n:{m}").alias(f"{m}_notnull") for m in counted]
    for m, stats in wanted.items():
        n = F.sum(f"_n:{m}")
        gap = F.try_divide(F.col(f"_s:{m}"), F.col(f"_n:{m}")) - F.col(f"_mean:{m}")
        squares = F.sum(F.col(f"_q:{m}") + F.col(f"_n:{m}") * gap * gap)
        make = {"sum": F.sum(f"_s:{m}"), "mean": F.max(f"_mean:{m}"), "std": F.sqrt(F.try_divide(squares, F.when(n > 1, n - 1)))}
        out += [make[s].alias(f"{m}_{s}") for s in stats if s in make]
    table = parts.groupBy(*by).agg(*out)

    ids = expand(state.ids).select(*by, "_id").distinct().groupBy(*by).agg(F.count("_id").alias(unique))
    table = join_null_safe(table, ids, by)

    medians = [m for m, stats in wanted.items() if "median" in stats]
    if not medians:
        return table

    wide = expand(state.rows).select(*by, *[of_measure(m).alias(m) for m in medians])
    probs = {m: [0.5] for m in medians}
    if not large:
        exact = listed_quantiles(wide, by, probs)
    else:
        # the digits of a measure of the state serve those wanted measures that stand for it
        serves = [F.when(column(m) == F.get(F.array(*map(F.lit, of)), F.col("_m")), F.lit(i)) for i, m in enumerate(medians)]
        bins = expand(state.bins).withColumn("_m", F.explode(F.array_compact(F.array(*serves))))
        found = select_ranks(
            merged_bins(bins, by), long_values(wide, by, medians), by, quantile_ranks(list(probs.values())), fetch_rows
        )
        exact = interpolated(found, by, probs)
    exact = exact.select(*by, *[F.col(m)[0].alias(f"{m}_median") for m in medians])
    return join_null_safe(table, exact, by)


def summarise(
    df: DataFrame,
    by: Sequence[str],
    id_col: str = "PropertyID",
    measures: Mapping[str, Sequence[str]] = MEASURES,
    counted: Sequence[str] = COUNTED,
    hot_rows: int | None = None,
) -> DataFrame:
    """Counts, distinct ids, sums, means, medians and standard deviations per group.

    All come from a mergeable state: moments merge map-side, distinct ids are counted after a distinct that can
    spill, and medians are sorted lists where no group has more than ``hot_rows`` rows (at most 10,000), else
    selected digit by digit.
    """
    fetch_rows = min(hot_rows or FETCH_ROWS, FETCH_ROWS)
    state = summary_state(df, by, id_col, list(measures))
    large = has_heavy(state.rows, by, fetch_rows)
    return roll_up(state, lambda rows: rows, by, measures, F.lit, counted, f"{id_col}_nunique", large, fetch_rows)


def with_ratios(df: DataFrame) -> DataFrame:
    """Ratio-of-sums rates next to the means and medians."""
    return df.withColumns(
        {
            "TaxRate": F.try_divide("TaxAmt_sum", "SaleAmt_sum"),
            "AssdValue_SaleAmt_Ratio": F.try_divide(
                "AssdTotalValue_HPI2021_Imputed_sum", "SaleAmt_sum"
            ),
        }
    )


def with_totals(df: DataFrame, query: Sequence[str], geo: Sequence[str]) -> DataFrame:
    """Totals over a whole query (``*_Total``) and per geography (``*_GeoTotal``).

    A query is one table of the cube (mode and bin family); its grand totals are aggregated
    map-side and joined back. A geography has as many rows as bins times periods.
    """
    grand = df.groupBy(*query).agg(
        F.sum("SaleAmt_sum").alias("SaleAmt_Total"), F.sum("count").alias("count_Total")
    )
    per_geo = W.partitionBy(*query, *geo)
    return join_null_safe(df, grand, query).withColumns(
        {
            "SaleAmt_GeoTotal": F.sum("SaleAmt_sum").over(per_geo),
            "count_GeoTotal": F.sum("count").over(per_geo),
        }
    )


def mode_rows(
    tiles: DataFrame,
    geo: Sequence[str],
    bins: Sequence[str],
    modes: Sequence[Mode],
    id_col: str = "PropertyID",
    measures: Mapping[str, Sequence[str]] = MEASURES,
) -> DataFrame:
    """Trimmed sales once per time mode they belong to, with that mode's measure columns.

    One scan of the tiles serves all modes: each row is expanded into an array of the modes whose
    recency rank is 1.
    """
    entries = [
        F.when(
            F.col(m.recency) == 1,
            F.struct(
                F.lit(m.name).alias("mode"),
                F.col(m.period).cast("string").alias("period"),
                *[F.col(m.column(x)).cast("double").alias(x) for x in measures],
                F.col("TaxRate").alias("TaxRate_nominal"),
            ),
        )
        for m in modes
    ]
    kept = tiles.where(F.col("TaxRate_Outliers") == "Middle 96%")
    return kept.select(
        id_col,
        *geo,
        *bins,
        F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("_mode"),
    ).select(id_col, *geo, *bins, "_mode.*")


def summary_cube(
    tiles: DataFrame,
    geo: Sequence[str],
    static_bins: Sequence[str] = ("Total", "SaleBins", "SaleBinsWide", "SaleBinsNarrow"),
    quantile_bins: Mapping[str, int] | None = None,
    modes: Sequence[Mode] = (SNAPSHOT, POOLED),
    id_col: str = "PropertyID",
    measures: Mapping[str, Sequence[str]] = MEASURES,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """All summary tables in one: keyed by ``mode``, ``bin_family``, geography, ``bin``, ``period``.

    ``quantile_bins`` maps a bin family to its number of groups; they are ranked by sale price
    within period and the first geography column, highest price first. The tiles are evaluated once, into
    the state of the finest groups (mode, period, geography and all bins together); every bin family is rolled up
    from that state. Every summary group lies inside one (mode, period, geography) group, so one look at their sizes
    serves the ranks and the medians. Families of quantile groups use the rate in money of the year, the
    others that of the mode.
    """
    groups = {"SaleAmt_Decile": 10, "SaleAmt_Quintile": 5} if quantile_bins is None else quantile_bins
    rows = mode_rows(tiles, geo, static_bins, modes, id_col, measures)
    market = ["mode", "period", geo[0]]
    hot = hot_rows or HOT_ROWS
    fetch_rows = min(hot, FETCH_ROWS)
    large = has_heavy(rows, market, fetch_rows)
    if groups:
        if large:
            rows = cut_lineage(rows, "cube_rows")  # the ranks look again, and slicing passes over the rows often
        rows = percentile_rank(rows, "SaleAmt", market, id_col, "_percentile", hot if large else None)
        rows = rows.withColumns({name: quantile_of_percentile(F.col("_percentile"), k).cast("string") for name, k in groups.items()})
    families = [*static_bins, *groups]
    nominal = [*groups] if groups and "TaxRate" in measures else []
    finest = ["mode", *geo, "period", *families]
    state = summary_state(rows, finest, id_col, [*measures, *(["TaxRate_nominal"] if nominal else [])])

    def expand(df: DataFrame) -> DataFrame:
        bins = F.array(*[F.struct(F.lit(f).alias("bin_family"), F.col(f).cast("string").alias("bin")) for f in families])
        rest = [c for c in df.columns if c not in families]
        return df.select(*rest, F.explode(bins).alias("_bin")).select(*rest, "_bin.*")

    def column(measure: str) -> Column:
        if measure == "TaxRate" and nominal:
            return F.when(F.col("bin_family").isin(nominal), "TaxRate_nominal").otherwise("TaxRate")
        return F.lit(measure)

    by = ["mode", "bin_family", *geo, "bin", "period"]
    counted = [c for c in COUNTED if c in measures]
    table = roll_up(state, expand, by, measures, column, counted, f"{id_col}_nunique", large, fetch_rows)
    return with_totals(with_ratios(table), ["mode", "bin_family"], geo)


def summary(
    tiles: DataFrame,
    geo: Sequence[str],
    bin_column: str,
    mode: Mode = SNAPSHOT,
    id_col: str = "PropertyID",
    measures: Mapping[str, Sequence[str]] = MEASURES,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """One summary table, for one time mode and one bin column present in ``tiles``."""
    cube = summary_cube(tiles, geo, [bin_column], {}, [mode], id_col, measures, hot_rows)
    return one_table(cube, geo[0], bin_column, mode)


def one_table(cube: DataFrame, geo_key: str, family: str, mode: Mode) -> DataFrame:
    """One summary table out of the cube, with its own column names, sorted."""
    return (
        cube.where((F.col("mode") == mode.name) & (F.col("bin_family") == family))
        .drop("mode", "bin_family")
        .withColumn("period", F.col("period").cast(mode.period_type))
        .withColumnsRenamed({"bin": family, "period": mode.period})
        .orderBy(geo_key, family, mode.period)
    )
