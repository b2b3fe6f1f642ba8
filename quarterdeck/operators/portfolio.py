"""Hybrid scores, Top-K portfolios, turnover, performance and ratings."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck.functions.order import quantiles, with_average_rank, with_ordinal
from quarterdeck.functions.stats import EPS, grade_number

PERIODS_PER_YEAR = 4
#: Score and portfolio sizes of each strategy.
TOPK_PLAN = (
    ("pure_stagewise_score", (10, 20, 30)),
    ("pure_promethee_score", (10, 20, 30)),
    ("hybrid_score_50_50", (10, 20, 30)),
    ("hybrid_score_70_30", (10, 20)),
    ("hybrid_score_30_70", (10, 20)),
)
#: Parts of a strategy's name and what a display shows for them, in order.
DISPLAY = (("_score", ""), ("pure_", ""), ("hybrid_", "hybrid "), ("_top", " top"), ("_", " "))
#: Grades from best to worst.
GRADES = ("AAA", "AA+", "AA", "AA-", "A+", "A", "A-", "BBB+", "BBB", "BBB-", "BB+", "BB", "B")


def display_name(strategy: Column) -> Column:
    """A strategy's name for tables and figures."""
    for part, shown in DISPLAY:
        strategy = F.replace(strategy, F.lit(part), F.lit(shown))
    return strategy


def _keyed(rows: DataFrame, values: list[str]) -> DataFrame:
    """values by _key, quarter and entity as one value (so that nulls are equal); raises, as it is read, where a key is repeated. A join on the
    key needs no further shuffle."""
    one = rows.groupBy(F.struct("quarter_idx", "entity_id").alias("_key")).agg(*(F.first(c).alias(c) for c in values), F.count(F.lit(1)).alias("_n"))
    return one.where(F.assert_true(F.col("_n") == 1, F.lit("quarter and entity are not unique")).isNull()).drop("_n")


def hybrid_scores(model: DataFrame, flow: DataFrame) -> DataFrame:
    """Inner join of one row each on quarter and entity (nulls match nulls, repeated keys raise), percentile ranks, and their blends.

    In hybrid_score_70_30 the first number is the weight of the net flow's rank."""
    both = _keyed(model, ["split", "future_return_1q", "prediction"]).join(_keyed(flow, ["net_flow"]), "_key")
    both = both.select("_key.quarter_idx", "_key.entity_id", "split", "future_return_1q", "prediction", "net_flow")
    both = with_average_rank(both, "prediction", ["quarter_idx"], "pure_stagewise_score", pct=True)
    both = with_average_rank(both, "net_flow", ["quarter_idx"], "pure_promethee_score", pct=True)
    s, p = F.col("pure_stagewise_score"), F.col("pure_promethee_score")
    return both.withColumns({f"hybrid_score_{a}_{b}": a / 100 * p + b / 100 * s for a, b in ((50, 50), (70, 30), (30, 70))})


def holdings(scores: DataFrame, plan=TOPK_PLAN) -> DataFrame:
    """Rows that each strategy holds: the k best by score, then by entity, of those with score and label, at equal weights."""
    spark = scores.sparkSession
    names = [name for name, _ in plan]
    long = scores.select("quarter_idx", "split", "entity_id", "future_return_1q", F.inline(F.array(*(F.struct(F.lit(c).alias("score_col"), F.col(c).alias("score")) for c in names))))
    long = long.where("score IS NOT NULL AND future_return_1q IS NOT NULL")
    ranked = long.withColumn("portfolio_rank", F.row_number().over(Window.partitionBy("score_col", "quarter_idx").orderBy(F.desc("score"), "entity_id")))
    ranked = ranked.where(F.col("portfolio_rank") <= max(k for _, ks in plan for k in ks))
    sizes = spark.createDataFrame([(f"{name}_top{k}", name, k) for name, ks in plan for k in ks], "strategy string, score_col string, topk int")
    held = ranked.join(F.broadcast(sizes), "score_col").where(F.col("portfolio_rank") <= F.col("topk"))
    return held.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("strategy", "quarter_idx")))


def benchmark(scores: DataFrame) -> DataFrame:
    """Equal-weight return of all entities with a label, by quarter."""
    return scores.groupBy("quarter_idx").agg(F.avg("future_return_1q").alias("benchmark_return"))


def turnover(held: DataFrame) -> DataFrame:
    """Half the sum of absolute weight changes against the strategy's previous quarter with holdings; 0.5 in the first."""
    periods = held.select("strategy", "quarter_idx").distinct()
    order = Window.partitionBy("strategy").orderBy("quarter_idx")
    periods = periods.withColumns({"previous": F.lag("quarter_idx").over(order), "next": F.lead("quarter_idx").over(order)})
    now = held.join(F.broadcast(periods.select("strategy", "quarter_idx", "next")), ["strategy", "quarter_idx"])
    # a holding counts in its own quarter and, with the other sign, in the next: no full outer join is needed
    changes = now.select("strategy", "entity_id", F.inline(F.array(F.struct(F.col("quarter_idx").alias("quarter_idx"), F.col("weight").alias("change")), F.struct(F.col("next").alias("quarter_idx"), (-F.col("weight")).alias("change")))))
    changes = changes.where("quarter_idx IS NOT NULL").groupBy("strategy", "quarter_idx", "entity_id").agg(F.sum("change").alias("change"))
    return changes.groupBy("strategy", "quarter_idx").agg((0.5 * F.sum(F.abs("change"))).alias("turnover"))


def returns(scores: DataFrame, held: DataFrame) -> DataFrame:
    """One row per strategy and quarter: portfolio, benchmark and excess return, turnover, number of holdings."""
    own = held.groupBy("strategy", "score_col", "topk", "quarter_idx", "split").agg(F.sum(F.col("weight") * F.col("future_return_1q")).alias("portfolio_return"), F.count(F.lit(1)).alias("holding_count"))
    own = own.join(F.broadcast(benchmark(scores)), "quarter_idx").join(turnover(held), ["strategy", "quarter_idx"])
    return own.withColumn("excess_return", F.col("portfolio_return") - F.col("benchmark_return"))


def drawdowns(quarterly: DataFrame) -> DataFrame:
    """max_drawdown per scope and strategy; equity starts after the first period, so an opening loss is none."""
    order = Window.partitionBy("scope", "strategy").orderBy("quarter_idx").rowsBetween(Window.unboundedPreceding, 0)
    equity = quarterly.withColumn("equity", F.product(1 + F.col("portfolio_return") / 100).over(order))
    equity = equity.withColumn("peak", F.max("equity").over(order))
    return equity.groupBy("scope", "strategy").agg(F.min(F.try_divide(F.col("equity"), F.col("peak")) - 1).alias("max_drawdown"))


def scoped(quarterly: DataFrame) -> DataFrame:
    """Every row once under "all" and once under its split."""
    return quarterly.withColumn("scope", F.explode(F.array(F.lit("all"), F.col("split"))))


def performance(quarterly: DataFrame) -> DataFrame:
    """Per scope and strategy the return, risk and benchmark-relative measures; returns are percent, rates fractions."""
    rows = scoped(quarterly.where("portfolio_return IS NOT NULL")).withColumns({"r": F.col("portfolio_return") / 100, "b": F.col("benchmark_return") / 100})
    out = rows.groupBy("scope", "strategy").agg(
        F.count(F.lit(1)).alias("period_count"),
        F.avg("portfolio_return").alias("holding_period_avg_return"),
        (F.product(1 + F.col("r")) - 1).alias("cumulative_return"),
        (F.stddev_samp("r") * F.sqrt(F.lit(float(PERIODS_PER_YEAR)))).alias("annualized_volatility"),
        F.avg("r").alias("mean_r"), F.avg("b").alias("mean_b"),
        F.when(F.var_samp("b") > EPS, F.try_divide(F.covar_samp("r", "b"), F.var_samp("b"))).alias("beta"),
        F.avg((F.col("r") > 0).cast("double")).alias("win_rate"),
        F.avg("turnover").alias("average_turnover"),
    )
    annual = F.pow(1 + F.col("cumulative_return"), F.lit(float(PERIODS_PER_YEAR)) / F.col("period_count")) - 1
    out = out.withColumn("annualized_return", annual)
    out = out.withColumn("sharpe_ratio", F.when(F.col("annualized_volatility") > EPS, F.try_divide(F.col("annualized_return"), F.col("annualized_volatility"))))
    out = out.withColumn("alpha", (F.col("mean_r") - F.col("beta") * F.col("mean_b")) * PERIODS_PER_YEAR).drop("mean_r", "mean_b")
    return out.join(drawdowns(rows), ["scope", "strategy"])


def ratings(scores: DataFrame, score: str, grades: tuple[str, ...] = GRADES) -> DataFrame:
    """rating and its place in the quarter, by score (best first), then entity."""
    ranked = with_ordinal(scores.where(F.col(score).isNotNull()), score, "entity_id", ["quarter_idx"], "rating_rank", size="_rated")
    number = grade_number(F.col("rating_rank"), F.col("_rated"), len(grades))
    return ranked.withColumn("rating", F.element_at(F.array(*map(F.lit, grades)), number + 1)).drop("_rated")


def rating_performance(rated: DataFrame, grades: tuple[str, ...] = GRADES) -> DataFrame:
    """Per split and grade; a missing return counts as not positive."""
    middle = quantiles(rated, ["future_return_1q"], (0.5,), ("split", "rating")).select(F.col("split").alias("_s"), F.col("rating").alias("_r"), F.col("future_return_1q")[0].alias("median_future_return"))
    out = rated.groupBy("split", "rating").agg(
        F.avg("future_return_1q").alias("avg_future_return"), F.count("entity_id").alias("stock_count"),
        F.avg(F.coalesce(F.col("future_return_1q") > 0, F.lit(False)).cast("double")).alias("positive_rate"),
    )
    out = out.join(F.broadcast(middle), F.col("split").eqNullSafe(F.col("_s")) & F.col("rating").eqNullSafe(F.col("_r"))).drop("_s", "_r")
    return out.withColumn("rating_order", F.array_position(F.array(*map(F.lit, grades)), F.col("rating")))
