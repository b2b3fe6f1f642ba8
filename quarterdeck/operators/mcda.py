"""Entropy weights and PROMETHEE II net flows, per quarter, over a long table (quarter_idx, entity_id, feature, value)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck.functions.order import quantiles, with_prefix
from quarterdeck.functions.stats import EPS


def long_form(panel: DataFrame, features: dict[str, int]) -> DataFrame:
    """features: column to direction; a column of negative direction is negated."""
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), (F.col(c) if d >= 0 else -F.col(c)).alias("value")) for c, d in features.items()))
    return panel.select("quarter_idx", "entity_id", F.inline(rows))


def composite_form(panel: DataFrame, picks: DataFrame, catalogue: list[tuple[str, str, str]]) -> DataFrame:
    """Values z_factor * z_macro of the composites picked for each quarter (columns quarter_idx, feature, coefficient), negated where the coefficient is negative.

    catalogue: composite, column of the factor and column of the macro series."""
    values = F.create_map(*(x for name, f, m in catalogue for x in (F.lit(name), F.col(f) * F.col(m))))
    sign = F.when(F.col("coefficient") < 0, -1.0).otherwise(1.0)
    own = picks.groupBy("quarter_idx").agg(F.collect_list(F.struct("feature", sign.alias("sign"))).alias("picks"))
    rows = panel.join(F.broadcast(own), "quarter_idx").withColumn("values", values)  # a row per quarter
    rows = rows.select("quarter_idx", "entity_id", "values", F.inline("picks"))
    return rows.select("quarter_idx", "entity_id", "feature", (F.element_at("values", F.col("feature")) * F.col("sign")).alias("value"))


def benefits(long: DataFrame) -> DataFrame:
    """value as 0 to 1 within quarter and feature, after filling nulls with the median there (0 if there is none)."""
    by = ["quarter_idx", "feature"]
    medians = quantiles(long, ["value"], (0.5,), tuple(by)).select(*by, F.coalesce(F.col("value")[0], F.lit(0.0)).alias("median"))
    filled = long.join(F.broadcast(medians), by).withColumn("value", F.coalesce("value", "median"))  # a row per quarter and feature
    ends = filled.groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    share = F.when(F.col("high") - F.col("low") < EPS, F.lit(0.5)).otherwise(F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")))
    return filled.join(F.broadcast(ends), by).select("quarter_idx", "entity_id", "feature", share.alias("benefit"))


def entropy_weights(benefit: DataFrame) -> DataFrame:
    """entropy and weight per quarter and feature; equal weights where no feature tells entities apart."""
    sums = benefit.groupBy("quarter_idx", "feature").agg(F.sum("benefit").alias("total"))
    shares = benefit.join(F.broadcast(sums), ["quarter_idx", "feature"]).withColumn("p", F.try_divide("benefit", "total"))  # a row per quarter and feature
    by = shares.groupBy("quarter_idx", "feature").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("p") > 0, -F.col("p") * F.ln("p"))).alias("h"))
    entropy = F.coalesce(F.try_divide(F.col("h"), F.ln(F.col("n").cast("double"))), F.lit(1.0))
    by = by.where("n > 1").withColumn("entropy", entropy).withColumn("d", F.greatest(F.lit(0.0), 1 - F.col("entropy")))
    quarter = Window.partitionBy("quarter_idx")
    total = F.sum("d").over(quarter)
    return by.select("quarter_idx", "feature", "entropy", F.when(total <= EPS, F.try_divide(F.lit(1.0), F.count(F.lit(1)).over(quarter))).otherwise(F.try_divide(F.col("d"), total)).alias("weight"))


def weight_log(weights: DataFrame, picks: DataFrame) -> DataFrame:
    """Entropy and weight of each quarter's features with the coefficient whose sign is their direction (0, so positive, where none is known)."""
    given = picks.select("quarter_idx", "feature", F.col("coefficient").alias("coefficient_for_direction"))
    rows = weights.join(given, ["quarter_idx", "feature"], "left").withColumn("coefficient_for_direction", F.coalesce("coefficient_for_direction", F.lit(0.0)))
    return rows.withColumn("direction", F.when(F.col("coefficient_for_direction") >= 0, "positive").otherwise("negative"))


def flows(benefit: DataFrame, weights: DataFrame) -> DataFrame:
    """phi_plus, phi_minus and net_flow of linear preference max(0, a - b), by sorted prefix sums and no pairs."""
    rows = with_prefix(benefit, "benefit", ["quarter_idx", "feature"], "lower", "before").withColumnsRenamed({"_n": "n", "_total": "total"})
    x = F.col("benefit")
    plus = x * F.col("lower") - F.col("before")
    minus = (F.col("total") - F.col("before") - x) - x * (F.col("n") - F.col("lower") - 1)
    rows = rows.join(F.broadcast(weights.select("quarter_idx", "feature", "weight")), ["quarter_idx", "feature"])  # a row per quarter and feature
    others = F.nullif(F.max("n") - 1, F.lit(0))
    out = rows.groupBy("quarter_idx", "entity_id").agg(F.try_divide(F.sum(plus * F.col("weight")), others).alias("phi_plus"), F.try_divide(F.sum(minus * F.col("weight")), others).alias("phi_minus"))
    return out.withColumn("net_flow", F.col("phi_plus") - F.col("phi_minus"))


def selected_features(selection: DataFrame, quarters: DataFrame, top: int) -> DataFrame:
    """Each quarter's own picks in step order (the last pick of a feature counts), or, where there are none, the features picked most often before."""
    last = Window.partitionBy("quarter_idx", "feature").orderBy(F.desc("step"))
    own = selection.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("quarter_idx").orderBy("step", "feature"))).where(F.col("place") <= top)
    without = quarters.join(own.select("quarter_idx").distinct(), "quarter_idx", "left_anti")
    past = without.join(selection.withColumnRenamed("quarter_idx", "past"), F.col("past") < F.col("quarter_idx"))
    past = past.groupBy("quarter_idx", "feature").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("coefficient")).alias("strength"), F.avg("coefficient").alias("coefficient"))
    past = past.withColumn("place", F.row_number().over(Window.partitionBy("quarter_idx").orderBy(F.desc("n"), F.desc("strength"), "feature"))).where(F.col("place") <= top)
    columns = ["quarter_idx", "feature", "place", "coefficient"]
    return own.select(columns).unionByName(past.select(columns))
