"""Column profiles, missingness, outliers and duplicate keys, each in one pass over the panel."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck.functions.order import quantiles
from quarterdeck.functions.stats import adjusted_kurtosis, adjusted_skewness, rounded

MEASURES = ("n", "missing_rate", "q01", "q05", "q50", "q95", "q99", "mean", "std", "skew", "kurtosis", "zero_rate", "negative_rate")


#: Those that sums alone give.
SHAPES = tuple(m for m in MEASURES if not m.startswith("q"))


def _measures(c: Column) -> dict[str, Column]:
    return {
        "n": F.count(c).cast("double"),
        "missing_rate": F.avg(c.isNull().cast("double")),
        "mean": F.avg(c),
        "std": F.when(F.count(c) > 1, F.stddev_samp(c)),
        "skew": adjusted_skewness(c),
        "kurtosis": adjusted_kurtosis(c),
        "zero_rate": F.avg((c == 0).cast("double")),
        "negative_rate": F.avg((c < 0).cast("double")),
    }


def shapes(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with all SHAPES, in one aggregation; rates besides missing_rate are among values that are there."""
    wide = df.agg(*(rounded(x).alias(f"{c}__{m}") for c in columns for m, x in _measures(F.col(c).cast("double")).items()))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"{c}__{m}").alias(m) for m in SHAPES)) for c in columns))))


def profiled(df: DataFrame, columns: list[str]) -> DataFrame:
    """shapes() and the quantiles: one row per column with all MEASURES."""
    points = quantiles(df, columns, (0.01, 0.05, 0.5, 0.95, 0.99))  # one row, also if df has none
    named = F.array(*(F.struct(F.lit(c).alias("column"), *(rounded(F.get(F.col(c), F.lit(k)).cast("double")).alias(f"q{q}") for k, q in enumerate(("01", "05", "50", "95", "99")))) for c in columns))
    return shapes(df, columns).join(F.broadcast(points.select(F.inline(named))), "column").select("column", *MEASURES)  # a row per column


def before_after(before: DataFrame, after: DataFrame, columns: list[str], measures: tuple[str, ...] = ("missing_rate", "q01", "q99", "mean", "std", "skew", "kurtosis")) -> DataFrame:
    """The two profiles side by side."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return profiled(df, columns).select("column", *(F.col(m).alias(f"{m}_{name}") for m in measures))

    return side(before, "before").join(side(after, "after"), "column")


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """column and n_values, its values that are there: one pass over all columns."""
    wide = df.agg(*(F.count(c).alias(c) for c in columns))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_values")) for c in columns))))


def missingness(df: DataFrame, columns: list[str], above: float = 0.0, top: int | None = None) -> DataFrame:
    """Share of nulls and blank strings per column, for columns above a threshold, largest first."""
    def blank(c: str) -> Column:
        return F.avg((F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).cast("double"))

    wide = df.agg(*(blank(c).alias(c) for c in columns))
    rows = wide.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), rounded(F.col(c)).alias("missing_rate")) for c in columns))))
    rows = rows.where(F.col("missing_rate") > above)
    return rows.orderBy(F.desc("missing_rate"), "column").limit(top) if top else rows


def outliers(df: DataFrame, columns: list[str], width: float = 3.0) -> DataFrame:
    """Per column: quartiles and the share of values beyond them by more than width times their distance."""
    limits = quantiles(df, columns, (0.25, 0.75))
    limits = limits.select(*(F.col(c)[0].alias(f"{c}__q1") for c in columns), *(F.col(c)[1].alias(f"{c}__q3") for c in columns))
    both = df.select(*columns).crossJoin(F.broadcast(limits))  # one row

    def rate(c: str) -> Column:
        q1, q3 = F.col(f"{c}__q1"), F.col(f"{c}__q3")
        beyond = (F.col(c) < q1 - width * (q3 - q1)) | (F.col(c) > q3 + width * (q3 - q1))
        return F.struct(F.lit(c).alias("column"), rounded(F.max(q1)).alias("q1"), rounded(F.max(q3)).alias("q3"), rounded(F.avg(F.when(F.col(c).isNotNull(), beyond.cast("double")))).alias("outlier_rate"))

    return both.agg(F.array(*map(rate, columns)).alias("rows")).select(F.inline("rows"))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows, rows of keys that stand more than once (all_members), and rows beyond the first of each key (extras)."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("all_members"), F.sum(F.col("n") - 1).alias("extras"))


def conditional_rates(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Share of all rows that meet each condition; an unknown result does not meet it."""
    rows = F.array(*(F.struct(F.lit(n).alias("check_name"), rounded(F.avg(F.coalesce(c, F.lit(False)).cast("double"))).alias("rate")) for n, c in conditions.items()))
    return df.agg(rows.alias("rows")).select(F.inline("rows"))


def sheet_summary(df: DataFrame, sheet: str, key: str) -> DataFrame:
    """Rows, distinct keys and rows of repeated keys for each sheet; blank keys are no keys."""
    keyed = df.select(sheet, F.nullif(F.trim(F.col(key).cast("string")), F.lit("")).alias("_key"))
    repeated = F.count("_key").over(Window.partitionBy(sheet, "_key"))
    return keyed.withColumn("_n", repeated).groupBy(sheet).agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("_key").alias("unique_keys"), F.count_if(F.col("_n") > 1).alias("duplicate_rows"))
