"""Proof that a label is the next quarter's return, its reconstruction, and the model-ready panel."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck.functions.stats import matches


def beside_next(panel: DataFrame, label: str, value: str) -> DataFrame:
    """Each row with `next_value`: value one quarter later of the same entity. Repeated keys fan out."""
    later = panel.select("entity_id", (F.col("quarter_idx") - 1).alias("quarter_idx"), F.col(value).alias("next_value"), F.lit(True).alias("has_next"))
    return panel.select("entity_id", "quarter_idx", F.col(label).alias("label_value")).join(later, ["entity_id", "quarter_idx"], "left")


def shift_report(panel: DataFrame, label: str, value: str, absolute: float = 1e-8, relative: float = 1e-6) -> DataFrame:
    """Per quarter: rows, pairs, matches, rate, errors and status (tail_without_t_plus_1 where no quarter follows)."""
    both = beside_next(panel, label, value)
    pair = F.col("label_value").isNotNull() & F.col("next_value").isNotNull()
    hit = pair & matches(F.col("label_value"), F.col("next_value"), absolute, relative)
    error = F.when(pair, F.abs(F.col("label_value") - F.col("next_value")))
    out = both.groupBy("quarter_idx").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("has_next").alias("overlap_count"),
        F.count_if(pair).alias("valid_pairs"),
        F.count_if(hit).alias("match_count"),
        F.count_if(pair & ~hit).alias("mismatch_count"),
        F.coalesce(F.max(error), F.lit(0.0)).alias("max_abs_error"),
    )
    rate = F.try_divide(F.col("match_count"), F.col("valid_pairs"))
    status = F.when(F.col("overlap_count") == 0, "tail_without_t_plus_1").when(F.col("valid_pairs") == 0, "no_valid_pairs").when(rate >= 0.99, "pass").otherwise("fail")
    return out.withColumns({"match_rate": rate, "status": status})


def proof(panel: DataFrame, label: str, value: str, absolute: float = 1e-8, relative: float = 1e-6, threshold: float = 0.99) -> DataFrame:
    """The full report per quarter: rows on both sides, compared and matched rows, errors, missing values, repeated ids, assertion and note.

    Repeated keys fan out, as in beside_next(). The last quarter, or one before a gap, can't be proved and is marked as tail."""
    ids = Window.partitionBy("quarter_idx", "entity_id")
    counts = panel.withColumn("_n", F.count(F.lit(1)).over(ids)).groupBy("quarter_idx").agg(
        F.count(F.lit(1)).alias("left_rows"), F.count_if(F.col("_n") > 1).alias("duplicate_left_ids"), F.count_if(F.col(label).isNull()).alias("_left_missing"))
    later = counts.select((F.col("quarter_idx") - 1).alias("quarter_idx"), F.col("left_rows").alias("right_rows"), F.col("duplicate_left_ids").alias("duplicate_right_ids"))
    both = beside_next(panel, label, value)
    pair = F.col("label_value").isNotNull() & F.col("next_value").isNotNull()
    error = F.when(pair, F.abs(F.col("label_value") - F.col("next_value")))
    compared = both.groupBy("quarter_idx").agg(
        F.count(F.lit(1)).alias("joined_rows"), F.count_if(pair).alias("valid_compare_rows"), F.count_if(pair & matches(F.col("label_value"), F.col("next_value"), absolute, relative)).alias("matched_rows"),
        F.max(error).alias("max_abs_error"), F.avg(error).alias("mean_abs_error"), F.count_if(F.col("label_value").isNull()).alias("missing_label_rows"), F.count_if(F.col("next_value").isNull()).alias("missing_next_return_rows"))
    rows = counts.join(later, "quarter_idx", "left").join(compared, "quarter_idx")
    tail = F.col("right_rows").isNull()
    rate = F.try_divide(F.col("matched_rows"), F.col("valid_compare_rows"))

    def unless_tail(name: str, otherwise=None) -> Column:
        return F.when(~tail, F.col(name)).otherwise(F.lit(0) if otherwise is None else otherwise).alias(name)

    assertion = F.when(tail, "tail_without_t_plus_1").when(F.col("valid_compare_rows") == 0, "no_valid_pairs").when(rate >= threshold, "pass").otherwise("fail")
    return rows.select(
        "quarter_idx", (F.col("quarter_idx") + 1).alias("next_quarter_idx"), "left_rows", unless_tail("right_rows"), unless_tail("joined_rows"), unless_tail("valid_compare_rows"), unless_tail("matched_rows"),
        F.when(~tail, rate).alias("match_rate"), F.when(~tail, F.col("max_abs_error")).alias("max_abs_error"), F.when(~tail, F.col("mean_abs_error")).alias("mean_abs_error"),
        unless_tail("missing_label_rows", F.col("_left_missing")), unless_tail("missing_next_return_rows"), "duplicate_left_ids", unless_tail("duplicate_right_ids"),
        assertion.alias("assertion"), F.when(tail, "no later quarter to compare with").otherwise("").alias("note"),
    )


def decision(report: DataFrame, threshold: float = 0.99) -> DataFrame:
    """One row over proof(): overall match rate, rows, largest error, quarters compared and passed, and whether the label is already shifted."""
    valid, matched = F.coalesce(F.sum("valid_compare_rows"), F.lit(0)), F.coalesce(F.sum("matched_rows"), F.lit(0))
    rate = F.try_divide(matched, valid)
    return report.agg(
        rate.alias("overall_match_rate"), valid.alias("total_valid_compare_rows"), matched.alias("total_matched_rows"), F.max("max_abs_error").alias("global_max_abs_error"),
        F.count("match_rate").alias("comparable_quarter_count"), F.count_if(F.col("assertion") == "pass").alias("quarter_pass_count"), F.max("quarter_idx").alias("tail_quarter"),
        F.coalesce(rate >= threshold, F.lit(False)).alias("label_already_shifted"),
    )


def anomalies(panel: DataFrame, label: str, value: str, limit: int, absolute: float = 1e-8, relative: float = 1e-6) -> DataFrame:
    """The first `limit` rows, by quarter and entity, whose label is not the next quarter's value."""
    both = beside_next(panel, label, value).where("has_next")
    kind = (
        F.when(F.col("label_value").isNull() & F.col("next_value").isNull(), F.lit(None))
        .when(F.col("label_value").isNull(), "label_missing").when(F.col("next_value").isNull(), "next_missing")
        .when(~matches(F.col("label_value"), F.col("next_value"), absolute, relative), "value_mismatch")
    )
    return both.withColumn("error_type", kind).where("error_type IS NOT NULL").drop("has_next").orderBy("quarter_idx", "entity_id").limit(limit)


def rebuilt(panel: DataFrame, value: str) -> DataFrame:
    """entity_id, quarter_idx and rebuilt_label: next quarter's value."""
    return beside_next(panel, value, value).select("entity_id", "quarter_idx", F.col("next_value").alias("rebuilt_label"))


def model_ready(panel: DataFrame, label: str, value: str, trusted: bool) -> DataFrame:
    """The panel's keys with the label to use, where it comes from, whether it is there, and whether the quarter is the last."""
    both = beside_next(panel, label, value)
    if not trusted:
        both = both.withColumn("label_value", F.col("next_value"))
    both = both.crossJoin(F.broadcast(panel.agg(F.max("quarter_idx").alias("last_quarter"))))  # one row
    source = F.lit("supplied_label" if trusted else "rebuilt_from_next_quarter")
    return both.select(
        "entity_id", "quarter_idx", F.col("label_value").alias("label"), source.alias("label_source"),
        F.when(F.col("label_value").isNotNull(), "available").when(F.col("quarter_idx") == F.col("last_quarter"), "tail").otherwise("missing").alias("label_status"),
        (F.col("quarter_idx") == F.col("last_quarter")).alias("is_tail_quarter"),
    )
