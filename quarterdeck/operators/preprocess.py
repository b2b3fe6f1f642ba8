"""Preprocessing fitted on the training quarters alone: fill, winsorise, transform, scale."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck.functions.order import quantiles, settled
from quarterdeck.functions.stats import EPS, clipped, log1p_or_signed, rounded, scaled
from quarterdeck.operators.scalers import power_scaled, quantile_scaled

TRAIN = (1, 21)
TAILS = (0.01, 0.99)


def train_params(panel: DataFrame, columns: list[str], train: tuple[int, int] = TRAIN) -> DataFrame:
    """One row: for each column the training median, the tails of the filled values, and mean and population deviation of the clipped ones."""
    rows = panel.where(F.col("quarter_idx").between(*train)).select(*columns)
    points = quantiles(rows, columns, (0.5,), filled=TAILS)
    names = ("median", "p01", "p99")
    fitted = points.select(*(F.coalesce(F.get(F.col(c), F.lit(k)), F.lit(0.0)).alias(f"{c}__{name}") for c in columns for k, name in enumerate(names)))
    rows = rows.crossJoin(F.broadcast(fitted)).select(*(clipped(F.coalesce(c, f"{c}__median"), F.col(f"{c}__p01"), F.col(f"{c}__p99")).alias(c) for c in columns))
    moments = rows.agg(*(F.avg(c).alias(f"{c}__mean") for c in columns), *(F.stddev_pop(c).alias(f"{c}__std") for c in columns))
    return fitted.crossJoin(moments)  # two single rows


def params_table(params: DataFrame, columns: list[str]) -> DataFrame:
    """The fitted row as a table, one row per column."""
    fields = (("median", "median_train"), ("p01", "winsor_p01_train"), ("p99", "winsor_p99_train"), ("mean", "mean_train"), ("std", "std_train"))
    rows = (F.struct(F.lit(c).alias("source_column"), *(rounded(F.when(F.col(f"{c}__std") < EPS, 1.0).otherwise(F.col(f"{c}__std")) if f == "std" else F.col(f"{c}__{f}")).alias(n) for f, n in fields)) for c in columns)
    return params.select(F.inline(F.array(*rows)))


def standardized(panel: DataFrame, params: DataFrame, columns: list[str], prefix: str = "z_") -> DataFrame:
    """panel with prefix + column: filled, clipped and scaled by the fitted row, which is broadcast."""
    out = panel.crossJoin(F.broadcast(params))
    values = {}
    for c in columns:
        x = clipped(F.coalesce(c, f"{c}__median"), F.col(f"{c}__p01"), F.col(f"{c}__p99"))
        values[f"{prefix}{c}"] = scaled(x, F.col(f"{c}__mean"), F.col(f"{c}__std"))
    return out.withColumns(values).drop(*params.columns)


def train_quarters(panel: DataFrame, ratio: float) -> DataFrame:
    """The first floor(n * ratio) distinct quarters, one at least; raises if there are fewer than three."""
    quarters = panel.select("quarter_idx").distinct()
    w = Window.orderBy("quarter_idx")  # a row for each quarter
    n = F.count(F.lit(1)).over(Window.partitionBy())
    ranked = quarters.withColumns({"nth": F.row_number().over(w), "n": n})
    ranked = ranked.where(F.assert_true(F.col("n") >= 3, F.lit("three quarters at least are needed")).isNull())
    return ranked.where(F.col("nth") <= F.greatest(F.lit(1), F.floor(F.col("n") * ratio))).select("quarter_idx")


def quarter_fits(panel: DataFrame, columns: list[str], train: tuple[int, int] = TRAIN) -> tuple[DataFrame, DataFrame]:
    """Medians and tails by training quarter, and the same over all of them (one row)."""
    rows = panel.where(F.col("quarter_idx").between(*train))

    def fits(group: tuple[str, ...]) -> DataFrame:
        found = quantiles(rows, columns, (0.5, *TAILS), group)
        return found.select(*group, *(F.col(c)[0].alias(f"{c}__med") for c in columns), *(F.slice(c, 2, 2).alias(f"{c}__tails") for c in columns))

    by_quarter, over_all = fits(("quarter_idx",)), fits(())
    for kind in ("med", "tails"):
        over_all = over_all.withColumnsRenamed({f"{c}__{kind}": f"{c}__all_{kind}" for c in columns})
    return by_quarter, over_all


def _with_fits(panel: DataFrame, columns: list[str], train: tuple[int, int]) -> DataFrame:
    by_quarter, over_all = quarter_fits(panel, columns, train)
    return panel.join(F.broadcast(by_quarter), "quarter_idx", "left").crossJoin(F.broadcast(over_all))  # a row per quarter, and one


def imputed(panel: DataFrame, columns: list[str], train: tuple[int, int] = TRAIN) -> DataFrame:
    """Nulls become the quarter's own training median, or the one over all training quarters, or 0."""
    out = _with_fits(panel, columns, train)
    return out.withColumns({c: F.coalesce(c, f"{c}__med", f"{c}__all_med", F.lit(0.0)) for c in columns}).select(*panel.columns)


def winsorised(panel: DataFrame, columns: list[str], train: tuple[int, int] = TRAIN) -> tuple[DataFrame, DataFrame]:
    """Filled values clipped to the tails of the raw ones, and the log of how many were clipped, by column and quarter."""
    out = _with_fits(panel, columns, train)
    low = {c: F.coalesce(F.col(f"{c}__tails")[0], F.col(f"{c}__all_tails")[0]) for c in columns}
    high = {c: F.coalesce(F.col(f"{c}__tails")[1], F.col(f"{c}__all_tails")[1]) for c in columns}
    filled = {c: F.coalesce(c, f"{c}__med", f"{c}__all_med", F.lit(0.0)) for c in columns}
    values = out.withColumns({c: clipped(filled[c], low[c], high[c]) for c in columns}).select(*panel.columns)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), low[c].alias("low"), high[c].alias("high"), filled[c].alias("value")) for c in columns))
    long = out.select("quarter_idx", F.inline(rows))
    log = long.groupBy("column", "quarter_idx").agg(
        F.count_if(F.col("value") < F.col("low")).alias("below_low_count"), F.count_if(F.col("value") > F.col("high")).alias("above_high_count"),
        rounded(F.max("low"), 9).alias("low"), rounded(F.max("high"), 9).alias("high"),
    )
    return values, log.where("below_low_count + above_high_count > 0")


def transformed(panel: DataFrame, columns: list[str]) -> DataFrame:
    """log1p of each column, or the signed form if it ever falls below -1."""
    least = panel.agg(*(F.min(c).alias(f"{c}__min") for c in columns))
    return panel.crossJoin(F.broadcast(least)).withColumns({c: log1p_or_signed(F.col(c), F.col(f"{c}__min")) for c in columns}).select(*panel.columns)


def rescaled(panel: DataFrame, columns: list[str], how: str, train: tuple[int, int] = TRAIN) -> DataFrame:
    """Standard, robust, min-max, power or quantile_normal scaling fitted on train; a constant training column becomes 0."""
    if how == "power":  # its jobs while the plan is built would compute the panel, and shuffle its sources, each time
        panel = settled(panel)
    rows = panel.where(F.col("quarter_idx").between(*train))
    if how in ("power", "quantile_normal"):
        return (power_scaled if how == "power" else quantile_scaled)(panel, columns, rows)
    fits, fitted = [], rows
    if how == "robust":
        points = quantiles(rows, columns, (0.25, 0.5, 0.75)).withColumnsRenamed({c: f"{c}__points" for c in columns})
        fitted = rows.crossJoin(F.broadcast(points))  # one row
    for c in columns:
        if how == "standard":
            centre, scale = F.avg(c), F.stddev_pop(c)
        elif how == "robust":
            at = F.first(f"{c}__points")
            centre, scale = at[1], at[2] - at[0]
        elif how == "minmax":
            centre, scale = F.min(c), F.max(c) - F.min(c)
        else:
            raise ValueError(f"unknown scaling {how}")
        fits += [centre.alias(f"{c}__centre"), F.when(scale == 0, 1.0).otherwise(scale).alias(f"{c}__scale"), F.coalesce(F.max(c) == F.min(c), F.lit(True)).alias(f"{c}__constant")]
    out = panel.crossJoin(F.broadcast(fitted.agg(*fits)))
    return out.withColumns({c: F.when(F.col(f"{c}__constant"), 0.0).otherwise((F.col(c) - F.col(f"{c}__centre")) / F.col(f"{c}__scale")) for c in columns}).select(*panel.columns)


def strategies(profile: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """What to do with each profiled column: action by role; scaling, transform and risk flags by its shape."""
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in roles.items() for x in pair)), F.col("column")), F.lit("factor")) if roles else F.lit("factor")
    skew, kurtosis = F.coalesce(F.abs("skew"), F.lit(0.0)), F.coalesce("kurtosis", F.lit(0.0))
    negative, zero, missing = (F.coalesce(c, F.lit(0.0)) for c in ("negative_rate", "zero_rate", "missing_rate"))
    long_tail, extreme = (skew > 2) | (kurtosis > 10), (skew > 5) | (kurtosis > 20)
    by_sign = F.when(negative > 0, "signed_log1p").otherwise("log1p")
    transform = F.when((zero > 0.25) & (negative == 0) & (skew > 2), "log1p").when(extreme, "signed_log1p").when(long_tail, by_sign).otherwise("none")
    scaling = F.when(extreme, "QuantileTransformer(candidate) / RobustScaler(baseline)").when(long_tail, "RobustScaler").otherwise("StandardScaler")
    flags = F.concat_ws(";", F.when(missing > 0.4, "missing_too_high"), F.when(skew > 5, "extreme_skew").when(skew > 2, "high_skew"), F.when(kurtosis > 20, "heavy_tail"))
    action = F.when(kind.isin("id", "meta"), "preserve_unmodified").when(kind.isin("label", "return_like"), "exclude_from_features").otherwise("transform_as_factor")
    used = action == "transform_as_factor"
    return profile.select(
        "column", kind.alias("role"), action.alias("feature_action"),
        F.when(used, scaling).otherwise("none").alias("scaling_strategy"), F.when(used, transform).otherwise("none").alias("transform_strategy"), F.when(used, flags).otherwise("").alias("risk_flags"),
    )


def fit_scope(fitted_quarters: DataFrame, train: DataFrame) -> DataFrame:
    """Fitted quarters outside the training ones, and whether there are none."""
    outside = fitted_quarters.select("quarter_idx").distinct().join(train, "quarter_idx", "left_anti")
    return outside.agg(F.count(F.lit(1)).alias("outside_train"), F.when(F.count(F.lit(1)) == 0, "PASS").otherwise("FAIL").alias("status"))
