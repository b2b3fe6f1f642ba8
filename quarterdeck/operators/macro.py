"""Cleaning and alignment of macro series: month to quarter, the three alignment modes, mapping, catalogue."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck.operators.profile import filled

#: Tokens that mark a growth series, in its name or its definition.
GROWTH_TOKENS = ("gr", "growth", "同比", "增速", "增长")


def is_growth(name: str, definition: str = "") -> bool:
    text = f"{name} {definition}".lower()
    return any(t in text for t in GROWTH_TOKENS)


def parse_yyyymm(text: Column) -> Column:
    """First day of a month written 201601 or 201601.0; null if it is neither."""
    text = F.trim(text.cast("string"))
    valid = text.rlike(r"^\d{6}(\.0+)?$") & F.substring(text, 5, 2).between("01", "12")
    return F.when(valid, F.to_date(F.substring(text, 1, 6), "yyyyMM"))


def explanation_rows_removed(rows: DataFrame, time: str) -> DataFrame:
    """Without the rows whose time is blank: remarks below a sheet's data, and empty rows."""
    return rows.where(F.trim(F.coalesce(F.col(time).cast("string"), F.lit(""))) != "")


#: Months at which a quarterly series is observed.
QUARTER_MONTHS = (1, 4, 7, 10)
_FATAL = ("time_parse_failed", "non_quarter_observation_in_quarter_sheet")


def exceptions(rows: DataFrame, sheet: str, row: str, time: str, values: list[str], quarterly_sheet: bool = False) -> DataFrame:
    """One row per fault of a raw sheet (sheet_name, row_index, raw_time, issue, row_preview): explanation rows that cleaning removes, times
    that can't be parsed, values that are no numbers, and, in a quarterly sheet, months that no quarter starts with."""
    month = parse_yyyymm(F.col(time))
    raw = F.trim(F.coalesce(F.col(time).cast("string"), F.lit("")))
    any_value = F.lit(False)
    for c in values:
        any_value = any_value | (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")
    faults = [
        F.when((raw == "") & any_value, F.struct(F.lit("explanation_row_removed").alias("issue"), F.concat_ws("|", *(F.col(c).cast("string") for c in values)).alias("row_preview"))),
        F.when((raw != "") & month.isNull(), F.struct(F.lit("time_parse_failed").alias("issue"), raw.alias("row_preview"))),
    ]
    for c in values:
        text = F.trim(F.col(c).cast("string"))
        faults.append(F.when((raw != "") & (text != "") & text.try_cast("double").isNull(), F.struct(F.lit("numeric_conversion_failed").alias("issue"), F.concat(F.lit(f"{c}="), text).alias("row_preview"))))
    if quarterly_sheet:
        faults.append(F.when(~F.month(month).isin(*QUARTER_MONTHS), F.struct(F.lit(_FATAL[1]).alias("issue"), F.concat(F.lit("month_period="), F.date_format(month, "yyyy-MM")).alias("row_preview"))))
    found = rows.select(F.col(row).alias("row_index"), raw.alias("raw_time"), F.explode(F.array_compact(F.array(*faults))).alias("fault"))
    return found.select(F.lit(sheet).alias("sheet_name"), "row_index", "raw_time", "fault.issue", "fault.row_preview")


def cleaned(rows: DataFrame, sheet: str, row: str, time: str, values: list[str], quarterly_sheet: bool = False) -> DataFrame:
    """The sheet with month_start and numeric values, without explanation rows; raises while it is read if a time is fatal."""
    kept = explanation_rows_removed(rows, time).withColumn("month_start", parse_yyyymm(F.col(time)))
    good = F.col("month_start").isNotNull()
    if quarterly_sheet:
        good = good & F.month("month_start").isin(*QUARTER_MONTHS)
    kept = kept.where(F.assert_true(good, F.concat(F.lit(f"{sheet}: time can't be used: "), F.coalesce(F.col(time).cast("string"), F.lit("null")))).isNull())
    return kept.select(row, "month_start", *(F.trim(F.col(c).cast("string")).try_cast("double").alias(c) for c in values))


def quarterly(monthly: DataFrame, series: list[str], how: str) -> DataFrame:
    """Months to quarters: the last value that is not null (quarter_end), the mean (quarter_mean), or by the series' kind (by_class)."""
    def one(name: str) -> Column:
        mean = how == "quarter_mean" or how == "by_class" and is_growth(name)
        value = F.avg(name) if mean else F.max_by(name, F.when(F.col(name).isNotNull(), F.col("month_start")))
        return value.alias(name)

    if how not in ("quarter_end", "quarter_mean", "by_class"):
        raise ValueError(f"unknown aggregation {how}")
    out = monthly.groupBy("quarter_period").agg(*map(one, series), F.count(F.lit(1)).alias("months"), F.last_day(F.max(F.add_months(F.trunc("month_start", "quarter"), 2))).alias("date"))
    return numbered(out)


def numbered(rows: DataFrame) -> DataFrame:
    """quarter_idx by order of quarter_period; a row for each quarter, so one task is enough."""
    return rows.withColumn("quarter_idx", F.row_number().over(Window.orderBy("quarter_period")))


def aligned(native: DataFrame, aggregated: DataFrame, mode: str) -> DataFrame:
    """Quarterly series next to those made from months.

    prefer_quarterly keeps native and adds the columns that only months have; aggregate_monthly keeps the aggregated
    alone; dual_track is their full outer join, each side's columns under its own prefix and each with its own date."""
    if mode == "aggregate_monthly":
        return aggregated
    if mode == "prefer_quarterly":
        only = [c for c in aggregated.columns if c not in native.columns]
        return native.join(aggregated.select("quarter_period", *only), "quarter_period", "left")
    if mode == "dual_track":
        def side(df: DataFrame, prefix: str) -> DataFrame:
            return df.select("quarter_period", *(F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != "quarter_period"))

        return side(native, "quarterly").join(side(aggregated, "monthly_agg"), "quarter_period", "full")
    raise ValueError(f"unknown mode {mode}")


def mapping(panel_quarters: DataFrame, macro: DataFrame) -> DataFrame:
    """quarter_idx of the panel with the macro period of that number, and whether there is one."""
    both = panel_quarters.join(macro.select("quarter_idx", "quarter_period"), "quarter_idx", "left")
    return both.select("quarter_idx", "quarter_period", F.col("quarter_period").isNotNull().alias("covered"))


def with_macro(panel: DataFrame, macro: DataFrame, series: list[str], lag: int = 0) -> DataFrame:
    """Many-to-one left join on the quarter; raises, as it is read, if a quarter of the panel has two macro rows or a value is missing.

    The macro rows of a quarter are counted by the shuffle that the join needs; nothing runs before."""
    right = macro.groupBy((F.col("quarter_idx") + lag).alias("quarter_idx")).agg(*(F.first(c).alias(c) for c in series), F.count(F.lit(1)).alias("_rows"))
    missing = F.greatest(*(F.col(c).isNull().cast("int") for c in series), F.lit(0))
    joined = panel.join(right, "quarter_idx", "left")
    known = joined.where(F.assert_true(F.coalesce("_rows", F.lit(1)) == 1, F.lit("macro has several rows of one quarter")).isNull())
    return known.where(F.assert_true(missing == 0, F.lit("a quarter of the panel has no macro value")).isNull()).drop("_rows")


def projected(rows: DataFrame, series: list[str]) -> DataFrame:
    """The key, the period and date where there are any, and the series, of whatever table has them; raises where a series is missing.

    Without quarter_idx, rows are numbered by period, or else by date; a row for each quarter."""
    absent = [c for c in series if c not in rows.columns]
    if absent:
        raise ValueError(f"macro has no {', '.join(absent)}")
    known = [c for c in ("quarter_period", "date") if c in rows.columns]
    if "quarter_idx" not in rows.columns:
        if not known:
            raise ValueError("macro has neither quarter_idx nor a period or date to number its rows by")
        rows = rows.withColumn("quarter_idx", F.row_number().over(Window.orderBy(known[0])))
    return rows.select("quarter_idx", *known, *series)


def definitions(rows: DataFrame) -> DataFrame:
    """series, definition and frequency from a sheet of definitions (acronym, variable, definition, frequency): trimmed, without rows that have no acronym; the variable where a definition is blank."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    return rows.select(text("acronym").alias("series"), F.coalesce(text("definition"), text("variable")).alias("definition"), text("frequency").alias("frequency")).where("series IS NOT NULL")


def catalogue(monthly: DataFrame, native: DataFrame, months: list[str], quarters: list[str], defined: DataFrame) -> DataFrame:
    """Every series of either source or the definitions, its values in each, and what is missing: defined_no_data, data_no_definition, monthly_only, quarterly_only or ok.

    A series is in a source where that has a value of it."""
    data = filled(monthly, months).withColumnRenamed("n_values", "n_monthly").join(filled(native, quarters).withColumnRenamed("n_values", "n_quarterly"), "column", "full")
    both = data.withColumnRenamed("column", "series").join(defined.select("series", "definition"), "series", "full")
    count = F.coalesce("n_monthly", F.lit(0)), F.coalesce("n_quarterly", F.lit(0))
    held = count[0] > 0, count[1] > 0
    status = (
        F.when(~held[0] & ~held[1], "defined_no_data").when(F.col("definition").isNull(), "data_no_definition")
        .when(held[0] & ~held[1], "monthly_only").when(~held[0] & held[1], "quarterly_only").otherwise("ok")
    )
    return both.select("series", "definition", count[0].alias("n_monthly"), count[1].alias("n_quarterly"), held[0].alias("in_monthly"), held[1].alias("in_quarterly"), status.alias("status"))


def conflicts(entries: DataFrame, documented: int) -> DataFrame:
    """A row for each series of a catalogue whose sources and definition disagree, and one if the series with data are not as many as documented."""
    own = entries.where("status <> 'ok'").select("series", F.col("status").alias("conflict"), F.concat(F.lit("monthly="), "n_monthly", F.lit("; quarterly="), "n_quarterly").alias("detail"))
    present = entries.agg(F.count_if(F.col("in_monthly") | F.col("in_quarterly")).alias("n"))
    number = present.where(F.col("n") != documented).select(F.lit("*").alias("series"), F.lit("series_count").alias("conflict"), F.concat(F.lit("present="), "n", F.lit(f"; documented={documented}")).alias("detail"))
    return own.unionByName(number)
