import random
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from quarterdeck.functions import stats
from quarterdeck.operators import evaluation, labels, macro, mcda, preprocess, profile, schema

SAMPLE = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0]


def frame(spark, values, name="x"):
    return spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], f"quarter_idx int, entity_id long, {name} double")


def test_average_rank_and_nulls(spark):
    rows = frame(spark, [*SAMPLE, None]).withColumn("r", stats.average_rank_pct("x", "quarter_idx")).orderBy("entity_id").collect()
    assert [None if r["r"] is None else round(r["r"] * 9, 6) for r in rows] == [4, 1.5, 5, 1.5, 6.5, 9, 3, 8, 6.5, None]


def test_adjusted_moments_and_quantiles(spark):
    got = {r["column"]: r for r in profile.profiled(frame(spark, SAMPLE), ["x"]).collect()}["x"]
    assert got["skew"] == pytest.approx(0.659829, abs=1e-6) and got["kurtosis"] == pytest.approx(0.261023, abs=1e-6)
    assert (got["q50"], got["q99"]) == (4.0, 8.76)
    flat = profile.profiled(frame(spark, [2.0, 2.0, None]), ["x"]).first()
    assert flat["skew"] is None and flat["kurtosis"] is None and flat["missing_rate"] == pytest.approx(1 / 3, abs=1e-6)
    empty = profile.profiled(frame(spark, []), ["x"]).first()
    assert empty["n"] == 0 and empty["mean"] is None


def test_rank_ic_never_raises(spark):
    rows = spark.createDataFrame([(1, 1, 1.0, 2.0), (1, 2, 2.0, 3.0), (2, 1, 1.0, 1.0), (2, 2, 1.0, 2.0), (2, 3, 1.0, 3.0), (3, 1, 1.0, 5.0), (3, 2, 2.0, 6.0), (3, 3, 3.0, 9.0)], "quarter_idx int, entity_id int, p double, y double")
    got = {r["quarter_idx"]: r["rankic"] for r in evaluation.rank_ic(rows, "p", "y").collect()}
    assert got[1] is None and got[2] is None and got[3] == pytest.approx(1.0)


def test_promethee_of_three(spark):
    benefit = spark.createDataFrame([(1, k, "f", v) for k, v in enumerate((0.0, 0.5, 1.0))], "quarter_idx int, entity_id long, feature string, benefit double")
    weights = spark.createDataFrame([(1, "f", 1.0)], "quarter_idx int, feature string, weight double")
    got = [(r["phi_plus"], r["phi_minus"], r["net_flow"]) for r in mcda.flows(benefit, weights).orderBy("entity_id").collect()]
    assert got == [(0.0, 0.75, -0.75), (0.25, 0.25, 0.0), (0.75, 0.0, 0.75)]


def test_entropy_weights_sum_to_one_and_constants_are_uniform(spark):
    long = spark.createDataFrame([(1, k, f, v) for k in range(5) for f, v in (("a", float(k)), ("b", float(k * k)))] + [(2, k, f, 1.0) for k in range(3) for f in "ab"], "quarter_idx int, entity_id long, feature string, value double")
    rows = mcda.entropy_weights(mcda.benefits(long)).collect()
    assert sum(r["weight"] for r in rows if r["quarter_idx"] == 1) == pytest.approx(1.0)
    assert [r["weight"] for r in rows if r["quarter_idx"] == 2] == [0.5, 0.5]


def test_ids_names_and_months(spark):
    rows = spark.createDataFrame([("1",), ("1.0",), ("000001.SZ",), (None,)], "x string").select(schema.padded_id(F.col("x")).alias("i")).collect()
    assert [r["i"] for r in rows] == ["000001", "000001", "000001.SZ", "000000"]
    name = spark.createDataFrame([("净资产收益率(1年，增长率)",)], "x string").select(schema.safe_feature_name(F.col("x"))).first()[0]
    assert name == "净资产收益率_1年_增长率"
    months = spark.createDataFrame([("201601",), ("201601.0",), ("201613",), ("x",), (None,)], "x string").select(macro.parse_yyyymm(F.col("x")).alias("m")).collect()
    assert [str(r["m"]) for r in months] == ["2016-01-01", "2016-01-01", "None", "None", "None"]
    assert schema.normalized_names(["", "a", " a ", None]) == ["row_id_raw", "a", "a__dup1", "empty_col_3"]
    values = spark.createDataFrame([("1d",), ("1e3",), (" 2 ",)], "x string").select(schema.numeric(F.col("x")).alias("v")).collect()
    assert [r["v"] for r in values] == [None, 1000.0, 2.0]


def test_label_proof(spark):
    rows = spark.createDataFrame([(1, 1, 5.0, 2.0), (1, 2, 7.0, 5.0 + 1e-9), (1, 3, None, 7.001)], "entity_id int, quarter_idx int, y double, r double")
    got = {r["quarter_idx"]: r["status"] for r in labels.shift_report(rows, "y", "r").collect()}
    assert got == {1: "pass", 2: "fail", 3: "tail_without_t_plus_1"}
    assert [r["error_type"] for r in labels.anomalies(rows, "y", "r", 5).collect()] == ["value_mismatch"]


def test_standardiser_fits_on_train_alone(spark):
    rows = spark.createDataFrame([(q, float(q)) for q in range(1, 28)] + [(5, None)], "quarter_idx int, x double")
    params = preprocess.train_params(rows, ["x"])
    p = params.first()
    assert p["x__median"] == 11.0 and p["x__p99"] < 21
    z = preprocess.standardized(rows, params, ["x"]).where("x = 27").first()["z_x"]
    assert z == pytest.approx((p["x__p99"] - p["x__mean"]) / p["x__std"])


def test_min_max_of_equals(spark):
    from pyspark.sql import Window

    rows = frame(spark, [2.0, 2.0]).select(stats.min_max(F.col("x"), Window.partitionBy("quarter_idx")).alias("m")).collect()
    assert [r["m"] for r in rows] == [0.5, 0.5]


def test_macro_gate_and_display_names(spark):
    from quarterdeck.operators import portfolio

    sheet = spark.createDataFrame([(1, "201601", "1.5"), (2, None, "remark"), (3, " ", None), (4, "2016.04", "2"), (5, "201602", "x")], "k int, t string, v string")
    got = {(r["row_index"], r["issue"]) for r in macro.exceptions(sheet, "q", "k", "t", ["v"], quarterly_sheet=True).collect()}
    assert got == {(2, "explanation_row_removed"), (4, "time_parse_failed"), (5, "numeric_conversion_failed"), (5, "non_quarter_observation_in_quarter_sheet")}
    assert [tuple(r)[::2] for r in macro.cleaned(sheet.where("k IN (1, 2, 3)"), "q", "k", "t", ["v"], quarterly_sheet=True).collect()] == [(1, 1.5)]
    assert macro.cleaned(sheet.where("k = 5"), "m", "k", "t", ["v"]).first()["v"] is None
    for k, quarterly in ((4, False), (5, True)):
        with pytest.raises(Exception, match="time can't be used"):
            macro.cleaned(sheet.where(f"k = {k}"), "q", "k", "t", ["v"], quarterly_sheet=quarterly).collect()
    names = spark.createDataFrame([("hybrid_score_50_50_top10",), ("pure_stagewise_score_top20",)], "s string").select(portfolio.display_name(F.col("s")).alias("s")).collect()
    assert [r["s"] for r in names] == ["hybrid 50 50 top10", "stagewise top20"]


def test_label_proof_of_gaps_and_repeats(spark):
    rows = [(1, 1, 5.0, 1.0), (1, 2, 2.0, 1.0), (2, 1, 7.0, 5.0), (2, 1, 7.0, 5.0), (4, 1, None, 7.0)]
    df = spark.createDataFrame(rows, "quarter_idx int, entity_id int, label double, ret double")
    report = labels.proof(df, "label", "ret")
    got = {r["quarter_idx"]: r for r in report.collect()}
    assert (got[1]["left_rows"], got[1]["right_rows"], got[1]["joined_rows"], got[1]["valid_compare_rows"], got[1]["matched_rows"], got[1]["missing_next_return_rows"], got[1]["duplicate_right_ids"], got[1]["assertion"]) == (2, 2, 3, 2, 2, 1, 2, "pass")
    assert (got[2]["assertion"], got[2]["joined_rows"], got[2]["duplicate_left_ids"], got[4]["missing_label_rows"], got[4]["match_rate"]) == ("tail_without_t_plus_1", 0, 2, 1, None)
    assert tuple(labels.decision(report).first())[:3] == (1.0, 2, 2)


def test_rounding_is_that_of_sql(spark):
    draw = random.Random(7)
    values = [*(draw.randrange(-(10**8), 10**8) / 10**7 for _ in range(20_000)), 0.5e-6, -0.5e-6, 1e300, 2.0**53 + 2, -0.0, float("nan"), float("inf"), float("-inf"), 5e-324, None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double").select("k", "x", stats.rounded(F.col("x")).alias("got"), stats.rounded(F.col("x"), 9).alias("fine")).toPandas()
    wanted = duckdb.sql("SELECT k, round(x, 6) + 0.0 AS got, round(x, 9) + 0.0 AS fine FROM rows ORDER BY k").df()
    rows = rows.sort_values("k").reset_index(drop=True)
    assert rows["got"].equals(wanted["got"]) and rows["fine"].equals(wanted["fine"])


def test_steady_sums_are_the_same_in_any_order(spark):
    draw = random.Random(5)
    values = [round(draw.uniform(900, 105_000), 2) for _ in range(3000)] + [draw.gauss(0, 1) for _ in range(3000)]
    measures = [f(F.col("x")) for f in (stats.steady_sum, stats.steady_avg, stats.steady_stddev)]
    found = set()
    for parts in (1, 7, 30):
        draw.shuffle(values)
        found.add(tuple(frame(spark, values).repartition(parts).agg(*measures).first()))
    assert len(found) == 1
    total, mean, deviation = found.pop()
    assert (total, mean) == (pytest.approx(statistics.fsum(values), rel=1e-14), pytest.approx(statistics.fmean(values), rel=1e-14))
    assert deviation == pytest.approx(statistics.stdev(values), rel=1e-12)


@pytest.mark.parametrize("values", [[100.123, 100.123, 100.123], [1e9, 1e9 + 1, 1e9 + 2], [1e15, 3e15], [1e-7, 3e-7, None], [4.5], [None], [], [1.0, float("nan")], [1.0, float("inf")]])
def test_steady_sums_of_odd_values(spark, values):
    got = frame(spark, values).agg(*(f(F.col("x")) for f in (stats.steady_sum, stats.steady_avg, stats.steady_stddev))).first()
    wanted = frame(spark, values).agg(F.sum("x"), F.avg("x"), F.stddev_samp("x")).first()
    assert [None if x is None else pytest.approx(x, rel=1e-8, abs=1e-15, nan_ok=True) for x in wanted] == list(got)
