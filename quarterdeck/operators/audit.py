"""Audits: temporal split, coverage, leakage, problem scan, macro resolution, assumption ledger, expectations."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarterdeck.operators.schema import RETURN_TOKENS

ISSUE = ("issue", "category", "severity", "priority", "assertion")


def ratio_split(quarters: DataFrame, train: float, valid: float) -> DataFrame:
    """quarter_idx and split: the first share of the quarters, the next, and the rest, at least one of each; raises below three."""
    place = F.row_number().over(Window.orderBy("quarter_idx"))  # a row for each quarter
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rows = quarters.select("quarter_idx").distinct().withColumns({"nth": place, "n": n})
    rows = rows.where(F.assert_true(F.col("n") >= 3, F.lit("three quarters at least are needed")).isNull())
    train_end = F.greatest(F.lit(1), F.floor(F.col("n") * train))
    valid_end = F.least(F.greatest(train_end + 1, F.floor(F.col("n") * (train + valid))), F.col("n") - 1)
    return rows.select("quarter_idx", F.when(F.col("nth") <= train_end, "train").when(F.col("nth") <= valid_end, "valid").otherwise("test").alias("split"))


def split_manifest(panel: DataFrame) -> DataFrame:
    """First and last quarter, rows and entities of each split."""
    return panel.groupBy("split").agg(F.min("quarter_idx").alias("start_quarter"), F.max("quarter_idx").alias("end_quarter"), F.count(F.lit(1)).alias("row_count"), F.countDistinct("entity_id").alias("unique_entities"))


def split_assertions(manifest: DataFrame, panel: DataFrame, last_labelled: int) -> DataFrame:
    """order_ok (splits follow each other), rows_ok (they hold all rows) and tail_ok (test ends at the last labelled quarter)."""
    ends = manifest.agg(
        F.max(F.when(F.col("split") == "train", F.col("end_quarter"))).alias("a"), F.min(F.when(F.col("split") == "valid", F.col("start_quarter"))).alias("b"),
        F.max(F.when(F.col("split") == "valid", F.col("end_quarter"))).alias("c"), F.min(F.when(F.col("split") == "test", F.col("start_quarter"))).alias("d"),
        F.max(F.when(F.col("split") == "test", F.col("end_quarter"))).alias("e"), F.sum("row_count").alias("rows"),
    )
    total = panel.agg(F.count(F.lit(1)).alias("total"))
    return ends.crossJoin(total).select(((F.col("a") < F.col("b")) & (F.col("c") < F.col("d"))).alias("order_ok"), (F.col("rows") == F.col("total")).alias("rows_ok"), (F.col("e") <= last_labelled).alias("tail_ok"))


def uncovered_quarters(panel: DataFrame, macro: DataFrame) -> DataFrame:
    """Quarters of the panel without a macro row."""
    return panel.select("quarter_idx").distinct().join(macro.select("quarter_idx"), "quarter_idx", "left_anti")


def final_features(strategy: DataFrame, prohibited: list[str]) -> DataFrame:
    """Every column with its strategies, if given, included_in_X and the first reason against it: prohibited, return-like, its action."""
    like = reduce(or_, (F.lower("column").contains(t) for t in RETURN_TOKENS["preprocess"]))
    banned, used = F.col("column").isin(prohibited), F.col("feature_action") == "transform_as_factor"
    shape = [c for c in ("scaling_strategy", "transform_strategy", "risk_flags") if c in strategy.columns]
    reason = F.when(banned, "prohibited_or_leakage_guard").when(like, "return_like_excluded").when(~used, F.concat(F.lit("feature_action="), "feature_action")).otherwise("")
    return strategy.select("column", "role", "feature_action", *shape, (used & ~banned & ~like).alias("included_in_X"), like.alias("is_return_like"), banned.alias("is_prohibited"), reason.alias("exclusion_reason"))


def leakage_report(features: DataFrame) -> DataFrame:
    """Number of features used, of prohibited and return-like ones among them, and PASS or FAIL."""
    used = F.col("included_in_X")
    bad = F.count_if(used & (F.col("is_prohibited") | F.col("is_return_like")))
    return features.agg(F.count_if(used).alias("x_columns"), F.count_if(used & F.col("is_prohibited")).alias("prohibited_in_x"), F.count_if(used & F.col("is_return_like")).alias("return_like_in_x"), F.when(bad == 0, "PASS").otherwise("FAIL").alias("status"))


def issues(spark: SparkSession, checks: list[tuple[DataFrame, Column, tuple[str, str, str, str, str], Column]]) -> DataFrame:
    """Runs checks: each is a one-row DataFrame, when it is an issue, the issue's fields, and its evidence."""
    out = None
    for measured, when, fields, evidence in checks:
        rows = measured.where(when).select(*(F.lit(v).alias(n) for n, v in zip(ISSUE, fields, strict=True)), evidence.alias("evidence"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], ", ".join(f"{n} string" for n in (*ISSUE, "evidence")))
    return out


def basis_points(items: DataFrame) -> DataFrame:
    """item, value and status: an item named in basis points must be a number, and one between 0 and 1 looks like a fraction (error)."""
    number = F.trim("value").try_cast("double")
    named = F.col("item").contains("bps")
    status = F.when(~named, "not_in_bps").when(number.isNull(), "error_not_a_number").when((number > 0) & (number < 1), "error_looks_like_a_fraction").otherwise("ok")
    return items.select("item", "value", status.alias("status"))


def fit_window_audit(params: DataFrame, scalers: DataFrame, panel: DataFrame) -> DataFrame:
    """PASS or FAIL for each fit: parameters (column, quarter_idx) and scalers (column, fit_start, fit_end) may use the training quarters alone."""
    train = panel.where("split = 'train'").agg(F.min("quarter_idx").alias("first"), F.max("quarter_idx").alias("last"))  # one row
    own = params.where("quarter_idx IS NOT NULL").groupBy("column").agg(F.min("quarter_idx").alias("fit_start"), F.max("quarter_idx").alias("fit_end")).withColumn("fit", F.lit("parameters"))
    both = own.unionByName(scalers.select("column", "fit_start", "fit_end").withColumn("fit", F.lit("scaler")))
    inside = (F.col("fit_start") >= F.col("first")) & (F.col("fit_end") <= F.col("last"))
    return both.crossJoin(F.broadcast(train)).select("fit", "column", "fit_start", "fit_end", F.when(inside, "PASS").otherwise("FAIL").alias("status"))


def outlier_skew(profiles: DataFrame, outliers: DataFrame, skew: float, ratio: float, least: int = 20) -> DataFrame:
    """Columns of at least `least` values that are skewed beyond `skew`, or with more outliers beyond 3 IQR than `ratio`, as one row of both lists."""
    rows = profiles.select("column", "n", F.col("skew").alias("s")).join(outliers.select("column", F.col("outlier_rate").alias("o"), (F.col("q3") > F.col("q1")).alias("wide")), "column").where(F.col("n") >= least)
    skewed, out = F.abs("s") > skew, F.col("wide") & (F.col("o") > ratio)
    names = lambda when: F.coalesce(F.array_join(F.array_sort(F.collect_list(F.when(when, F.col("column")))), ","), F.lit(""))  # noqa: E731  (names of columns, not rows)
    return rows.agg(names(skewed).alias("skewed"), names(out).alias("outliers"))


def macro_resolution(catalogue: DataFrame, needed: int) -> DataFrame:
    """Series in use with how they are resolved, and a row for each one that is missing up to the needed number."""
    use = F.when(F.col("in_quarterly"), "use_quarterly").otherwise("aggregate_monthly")
    used = catalogue.where("in_monthly OR in_quarterly").select("series", use.alias("resolution"))
    gap = used.agg(F.greatest(F.lit(needed) - F.count(F.lit(1)), F.lit(0)).cast("int").alias("gap"))
    missing = gap.where("gap > 0").select(F.explode(F.sequence(F.lit(1), F.col("gap"))).alias("k"))
    return used.unionByName(missing.select(F.concat(F.lit("missing_"), F.col("k").cast("string")).alias("series"), F.lit("documented_missing").alias("resolution")))


def ledger(overrides: DataFrame, seeds: DataFrame, defaults: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """One row per item, by override before seed before default; unknown items are kept; status confirmed, assumed or unknown_item."""
    canonical = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)), F.col("item")), F.col("item")) if aliases else F.col("item")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("item", canonical).groupBy("item").agg(F.max("value").alias(name))

    rows = side(overrides, "override").join(side(seeds, "seed"), "item", "full").join(side(defaults, "fallback"), "item", "full")
    source = F.when(F.col("override").isNotNull(), "override").when(F.col("seed").isNotNull(), "seed").otherwise("default")
    status = F.when(F.col("fallback").isNull(), "unknown_item").when(F.col("override").isNotNull(), "confirmed").otherwise("assumed")
    return rows.select("item", F.coalesce("override", "seed", "fallback").alias("value"), source.alias("source_type"), status.alias("status"))


def expectations(measured: DataFrame, expected: DataFrame) -> DataFrame:
    """Each expected item with what was found and PASS, FAIL or MISSING."""
    both = expected.join(measured, "item", "left")
    status = F.when(F.col("found").isNull(), "MISSING").when(F.col("found") == F.col("expected"), "PASS").otherwise("FAIL")
    return both.select("item", "expected", "found", status.alias("status"))
