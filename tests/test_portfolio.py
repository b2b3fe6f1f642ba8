import pytest
from pyspark.sql import functions as F

from quarterdeck.operators import macro, portfolio

#: Published quarterly returns of one strategy and of the benchmark, quarters 13 to 30, in percent, and the turnover.
PORTFOLIO = [-12.873576572665254, -2.6385514618926433, 5.726122996071049, -0.4636277542051226, 21.234406585081395, 18.201431820822357, 29.674794266904065, -6.673012723757222, 33.12681967424269, 0.05162673478435105, 4.095889221159005, -13.643910234204727, 18.02920516050336, -12.114279030155739, -3.21491396733208, 1.9849381100938375, -4.801534397191962, -5.552949168216482]
BENCHMARK = [-7.914060610601374, -1.945782629963268, 5.373002977571485, -1.5970844833882765, 8.62059914061964, 13.312880684614123, 4.8096274712707405, 0.0416997801260893, 13.191845569003988, 9.158055960388827, 14.597573182972084, -9.444570757478221, 4.7276673056485645, -8.793030026774517, 4.427705195647978, 8.714858581934497, -0.4145420671977687, -1.2756732225217289]
#: Published measures of the same strategy: average, cumulative, annualised, volatility, Sharpe, alpha, beta, drawdown, win rate.
MEASURES = {
    "all": (3.8971599588911605, 0.7064727581991324, 0.12610175545157598, 0.2861477480032155, 0.4406875690322013, -0.014284929376256444, 1.3775145523775179, -0.22002416659650137, 0.5),
    "train": (9.479422981177926, 1.0610001702289487, 0.3790824588071131, 0.33178758724657487, 1.1425456327436085, 0.08357615945778363, 1.9623729063739832, -0.06673012723757221, 0.5555555555555556),
    "valid": (2.1332027205604973, 0.06154934138132773, 0.06154934138132773, 0.2607131971195632, 0.23608065131087771, -0.05466402125286579, 0.7353019962757095, -0.13643910234204726, 0.75),
    "test": (-4.739747690560486, -0.22002416659650137, -0.18028115877605022, 0.10128935961889941, -1.779862756111372, -0.20570815563935965, 0.7576305852789363, -0.11251131037415352, 0.2),
}
NAMES = ("holding_period_avg_return", "cumulative_return", "annualized_return", "annualized_volatility", "sharpe_ratio", "alpha", "beta", "max_drawdown", "win_rate")


def test_published_measures_follow_from_published_returns(spark):
    split = lambda q: "train" if q <= 21 else "valid" if q <= 25 else "test"
    rows = [("s", q, split(q), p, b, 0.5) for q, p, b in zip(range(13, 31), PORTFOLIO, BENCHMARK, strict=True)]
    df = spark.createDataFrame(rows, "strategy string, quarter_idx int, split string, portfolio_return double, benchmark_return double, turnover double")
    got = {r["scope"]: r for r in portfolio.performance(df).collect()}
    assert set(got) == set(MEASURES)
    for scope, values in MEASURES.items():
        for name, value in zip(NAMES, values, strict=True):
            assert got[scope][name] == pytest.approx(value, abs=1e-12), (scope, name)


def test_opening_loss_is_no_drawdown(spark):
    rows = [("all", "a", 1, -50.0), ("all", "a", 2, 10.0), ("all", "b", 1, 10.0), ("all", "b", 2, -50.0)]
    got = {r["strategy"]: r["max_drawdown"] for r in portfolio.drawdowns(spark.createDataFrame(rows, "scope string, strategy string, quarter_idx int, portfolio_return double")).collect()}
    assert got["a"] == 0.0 and got["b"] == pytest.approx(-0.5)


def test_turnover(spark):
    rows = [("s", 1, "a", 0.5), ("s", 1, "b", 0.5), ("s", 4, "b", 0.5), ("s", 4, "c", 0.5)]
    got = {r["quarter_idx"]: r["turnover"] for r in portfolio.turnover(spark.createDataFrame(rows, "strategy string, quarter_idx int, entity_id string, weight double")).collect()}
    assert got == {1: 0.5, 4: 0.5}


def test_grades_are_spread(spark):
    rows = spark.range(1424).select(F.lit(1).alias("quarter_idx"), F.col("id").alias("entity_id"), F.col("id").cast("double").alias("score"))
    counts = {r["rating"]: r["count"] for r in portfolio.ratings(rows, "score").groupBy("rating").count().collect()}
    assert [counts[g] for g in portfolio.GRADES] == [110, 110, 109, 110, 109, 110, 109, 110, 109, 110, 109, 110, 109]
    best = portfolio.ratings(rows, "score").where("rating = 'AAA'").agg(F.min("score")).first()[0]
    assert best == 1424 - 110


def test_hybrid_rejects_repeated_keys(spark):
    model = spark.createDataFrame([(1, 1, "train", 1.0, 0.5), (1, 1, "train", 1.0, 0.6)], "quarter_idx int, entity_id long, split string, future_return_1q double, prediction double")
    flow = spark.createDataFrame([(1, 1, 0.1)], "quarter_idx int, entity_id long, net_flow double")
    with pytest.raises(Exception, match="not unique"):
        portfolio.hybrid_scores(model, flow).collect()


def test_validated_joins_take_one_exchange_a_side(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        model = spark.createDataFrame([(1, 1, "train", 0.1, 0.2), (1, None, "train", 0.3, 0.4)], "quarter_idx int, entity_id long, split string, future_return_1q double, prediction double")
        flow = spark.createDataFrame([(1, 1, 0.5), (1, None, 0.6)], "quarter_idx int, entity_id long, net_flow double")
        both = portfolio._keyed(model, ["prediction"]).join(portfolio._keyed(flow, ["net_flow"]), "_key")
        assert both.count() == 2
        assert both._jdf.queryExecution().sparkPlan().toString().count("Exchange") == 0
        assert both._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 2
        panel = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "quarter_idx int, e string")
        series = spark.createDataFrame([(1, 5.0), (2, 6.0), (2, 7.0), (9, None)], "quarter_idx int, m double")
        with pytest.raises(Exception, match="several rows"):
            macro.with_macro(panel, series, ["m"]).collect()
        with pytest.raises(Exception, match="no macro value"):
            macro.with_macro(panel, series.where("quarter_idx <> 2"), ["m"]).collect()
        assert macro.with_macro(panel, series.where("m <> 7"), ["m"]).count() == 3
        with pytest.raises(ValueError, match="macro has no m2"):
            macro.projected(series, ["m2"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
