"""Queries on composites, rolling selection, PROMETHEE scores, portfolios, ratings, and the tables behind their figures.

Tables of a row per entity and quarter that a query reads several times (fits, ranks, turnover) are persisted; a
lost executor's part is computed again from the sources.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarterdeck.functions import order
from quarterdeck.functions.stats import clipped, correlation, min_max, rounded
from quarterdeck.operators import evaluation, macro, mcda, portfolio, preprocess, stepwise
from quarterdeck.plans import selection_sql
from quarterdeck.plans.panel_queries import _macro, _quarterly_sql, r6
from quarterdeck.sources import panel as source
from quarterdeck.sources.panel import FACTORS, MACRO, MONTHLY_SQL, PANEL_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}

FEATURES = {"f_disc": -1, "f_unit": 1, "f_rshare": -1, "f_growth": 1, "f_acct": 1}
#: Factors of the selection: all but f_growth, which is the return ret_3m.
ELIGIBLE = tuple(f for f in FACTORS if f != "f_growth")
LABEL = "future_return_1q"
GRADES = portfolio.GRADES


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(rounded(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- the minimum slice -------------------------------------------------------------------------------------------------


@query(f"""WITH {PANEL_SQL}, s AS (SELECT *, (rank() OVER (PARTITION BY quarter_idx ORDER BY f_disc) + (count(*) OVER (PARTITION BY quarter_idx, f_disc) - 1) / 2.0) / count(f_disc) OVER (PARTITION BY quarter_idx) AS score FROM panel),
r AS (SELECT *, row_number() OVER (PARTITION BY quarter_idx ORDER BY score DESC, entity_id) AS k FROM s WHERE future_return_1q IS NOT NULL)
SELECT a.quarter_idx, {r6("a.portfolio_return")} AS portfolio_return, {r6("b.benchmark_return")} AS benchmark_return, {r6("a.portfolio_return - b.benchmark_return")} AS excess_return, holding_count
FROM (SELECT quarter_idx, avg(future_return_1q) AS portfolio_return, count(*) AS holding_count FROM r WHERE k <= 10 GROUP BY 1) a JOIN (SELECT quarter_idx, avg(future_return_1q) AS benchmark_return FROM panel GROUP BY 1) b USING (quarter_idx)""")
def topk_quarterly_returns_slice(spark: SparkSession, d: str) -> DataFrame:
    rows = order.with_average_rank(source.panel(spark, d).select("quarter_idx", "split", "entity_id", LABEL, "f_disc"), "f_disc", ["quarter_idx"], "score", pct=True)
    held = portfolio.holdings(rows, (("score", (10,)),))
    out = held.groupBy("quarter_idx").agg(F.avg(LABEL).alias("portfolio_return"), F.count(F.lit(1)).alias("holding_count")).join(portfolio.benchmark(rows), "quarter_idx")
    return _round_all(out.select("quarter_idx", "portfolio_return", "benchmark_return", (F.col("portfolio_return") - F.col("benchmark_return")).alias("excess_return"), "holding_count"))


# --- composites and selection ------------------------------------------------------------------------------------------


_JOINED = f"WITH {MONTHLY_SQL}, e AS ({_quarterly_sql(False)}), {PANEL_SQL}, j AS (SELECT panel.*, {', '.join(MACRO)} FROM panel JOIN e USING (quarter_idx)), t AS (SELECT * FROM j WHERE quarter_idx BETWEEN 1 AND 21)"

_CATALOG = " UNION ALL ".join(f"SELECT 'composite_{f}__{m}' AS composite_feature, '{f}' AS stock_factor, '{m}' AS macro_factor, 'z_{f}' AS stock_standardized_column, 'z_{m}' AS macro_standardized_column, 'z_{f} * z_{m}' AS formula, TRUE AS is_composite, count(*) FILTER ({f} IS NOT NULL AND {m} IS NOT NULL) AS n_values FROM j" for f in ELIGIBLE for m in MACRO)


@query(f"{_JOINED} {_CATALOG}")
def composite_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Every product of a factor and a macro series, with the rows of the panel that have both.

    Factors are counted by quarter before the macro series are joined, a row for each quarter."""
    entries = stepwise.catalogue(list(ELIGIBLE), list(MACRO))
    counts = source.panel(spark, d).groupBy("quarter_idx").agg(*(F.count(f).alias(f"n_{f}") for f in ELIGIBLE)).join(_macro(spark, d, "quarter_end").select("quarter_idx", *MACRO), "quarter_idx")
    both = counts.agg(*(F.coalesce(F.sum(F.when(F.col(m).isNotNull(), F.col(f"n_{f}"))), F.lit(0)).alias(c) for c, f, m in entries))
    return both.select(F.inline(F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(_ENTRY, (c, f, m, f"z_{f}", f"z_{m}", f"z_{f} * z_{m}", True), strict=True)), F.col(c).alias("n_values")) for c, f, m in entries))))


_ENTRY = ("composite_feature", "stock_factor", "macro_factor", "stock_standardized_column", "macro_standardized_column", "formula", "is_composite")



def _fit_sql(c: str) -> str:
    return f""", a_{c} AS (SELECT coalesce(median({c}), 0) AS med FROM t), b_{c} AS (SELECT med, quantile_cont(coalesce({c}, med), 0.01) AS lo, quantile_cont(coalesce({c}, med), 0.99) AS hi FROM t, a_{c} GROUP BY med),
p_{c} AS (SELECT med, lo, hi, avg(least(greatest(coalesce({c}, med), lo), hi)) AS mu, stddev_pop(least(greatest(coalesce({c}, med), lo), hi)) AS sd FROM t, b_{c} GROUP BY ALL)"""


def _z_sql(c: str) -> str:
    return f"(least(greatest(coalesce({c}, p_{c}.med), p_{c}.lo), p_{c}.hi) - p_{c}.mu) / CASE WHEN p_{c}.sd < 1e-12 THEN 1 ELSE p_{c}.sd END"


_PAIRS = [(f, m) for f in ELIGIBLE for m in MACRO]
_USED = sorted({x for p in _PAIRS for x in p})


@query(f"{_JOINED}{''.join(map(_fit_sql, _USED))} " + f"SELECT entity_id, quarter_idx, {', '.join(f'{r6(f'({_z_sql(a)}) * ({_z_sql(b)})')} AS composite_{a}__{b}' for a, b in _PAIRS)} FROM j, {', '.join(f'p_{c}' for c in _USED)}")
def composite_values(spark: SparkSession, d: str) -> DataFrame:
    rows = _with_macro(spark, d)
    out = preprocess.standardized(rows, preprocess.train_params(rows, _USED), _USED)
    return out.select("entity_id", "quarter_idx", *(rounded(F.col(f"z_{a}") * F.col(f"z_{b}")).alias(f"composite_{a}__{b}") for a, b in _PAIRS))


def _with_macro(spark: SparkSession, d: str) -> DataFrame:
    series = macro.quarterly(source.macro_monthly(spark, d), list(MACRO), "quarter_end")
    series = series.withColumns({m: rounded(F.col(m)) for m in MACRO})
    return macro.with_macro(source.panel(spark, d), series, list(MACRO))


def _standardized(spark: SparkSession, d: str) -> DataFrame:
    rows, columns = _with_macro(spark, d).persist(), [*ELIGIBLE, *MACRO]
    return preprocess.standardized(rows, preprocess.train_params(rows, columns), columns).persist()


_TARGETS = (13, 27)


def _known(small: DataFrame) -> DataFrame:
    """A table of a few rows for each quarter, computed once; the plan ends there."""
    return small.sparkSession.createDataFrame(small.collect(), small.schema)


def _selection(spark: SparkSession, d: str, knobs: stepwise.Knobs = stepwise.Knobs()) -> tuple[DataFrame, DataFrame]:
    """The standardised rows, and the fits of all windows and steps (15 steps of 15 terms a quarter at most)."""
    rows = _standardized(spark, d)
    z, m = [f"z_{f}" for f in ELIGIBLE], [f"z_{x}" for x in MACRO]
    targets = spark.range(_TARGETS[0], _TARGETS[1] + 1).select(F.col("id").cast("int").alias("quarter_idx"))
    return rows, _known(stepwise.fits(stepwise.moments(rows, z, m, LABEL), targets, z, m, knobs))


def _log(spark: SparkSession, d: str) -> DataFrame:
    return stepwise.log_of(_selection(spark, d)[1])


def _predicted(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    out = stepwise.predicted(rows, stepwise.models_of(fitted), [f"z_{f}" for f in ELIGIBLE], [f"z_{x}" for x in MACRO])
    return out.withColumn("prediction", rounded(F.col("prediction"), 9))


_ROLLED = f"{_JOINED}{''.join(map(_fit_sql, _USED))}, zed AS MATERIALIZED (SELECT entity_id, entity_name, quarter_idx, split, future_return_1q AS y, " + ", ".join(f"{_z_sql(c)} AS z_{c}" for c in _USED) + f" FROM j, {', '.join(f'p_{c}' for c in _USED)}), "
_ROLLED += selection_sql.rolling([f"composite_z_{a}__z_{b}" for a, b in _PAIRS], [f"z_{a} * z_{b}" for a, b in _PAIRS], stepwise.Knobs(), _TARGETS, stepwise.Knobs().max_features)
_ICS = """, pr AS (SELECT p.*, split, entity_name FROM predicted p JOIN zed USING (entity_id, quarter_idx)),
pk AS (SELECT quarter_idx, split, rank() OVER (PARTITION BY quarter_idx ORDER BY prediction) + (count(*) OVER (PARTITION BY quarter_idx, prediction) - 1) / 2.0 AS a, rank() OVER (PARTITION BY quarter_idx ORDER BY y) + (count(*) OVER (PARTITION BY quarter_idx, y) - 1) / 2.0 AS b FROM pr WHERE y IS NOT NULL),
ics AS (SELECT quarter_idx, split, CASE WHEN count(*) >= 3 THEN corr(a, b) END AS rankic FROM pk GROUP BY ALL)"""


def _log_sql(ctes: str) -> str:
    return f"""{ctes}{_ICS} SELECT quarter_idx, step, window_start, window_end, selected_feature, {", ".join(f"{r6(c)} AS {c}" for c in ("coefficient", "train_r2", "selection_abs_corr", "sse_improvement", "train_rankic"))}, {r6("rankic")} AS valid_rankic_if_available
FROM log LEFT JOIN train_ic USING (quarter_idx, step) LEFT JOIN (SELECT quarter_idx, rankic FROM ics WHERE split = 'valid') USING (quarter_idx)"""


@query(_log_sql(_ROLLED))
def stepwise_log(spark: SparkSession, d: str) -> DataFrame:
    """Every step of every window, with the rank correlation of its fit and that of the validation quarter's predictions."""
    rows, fitted = _selection(spark, d)
    predicted = _predicted(rows, fitted)
    quarterly = evaluation.rank_ic(predicted, "prediction", LABEL).join(F.broadcast(predicted.select("quarter_idx", "split").distinct()), "quarter_idx")
    train = stepwise.train_rank_ics(rows, fitted, [f"z_{f}" for f in ELIGIBLE], [f"z_{x}" for x in MACRO], LABEL, stepwise.Knobs().window)
    return _round_all(stepwise.log_with_rank_ics(stepwise.log_of(fitted), train, quarterly))


#: A factor with nulls and two others: their composites take each window's median.
_WITH_NULLS, _NULL_KNOBS = ("f_miss", "f_unit", "f_rshare"), stepwise.Knobs(max_features=3)
_NULL_PAIRS = [(f, m) for f in _WITH_NULLS for m in MACRO]


@query(f"""{_JOINED}, zed AS MATERIALIZED (SELECT entity_id, quarter_idx, split, future_return_1q AS y, {", ".join((*_WITH_NULLS, *MACRO))} FROM j),
{selection_sql.rolling([f"composite_{a}__{b}" for a, b in _NULL_PAIRS], [f"{a} * {b}" for a, b in _NULL_PAIRS], _NULL_KNOBS, _TARGETS, 3)}
SELECT quarter_idx, step, selected_feature, {", ".join(f"{r6(c)} AS {c}" for c in ("coefficient", "train_r2", "selection_abs_corr", "sse_improvement"))} FROM log""")
def stepwise_null_factors(spark: SparkSession, d: str) -> DataFrame:
    """Selection over factors with nulls, which take the medians of their windows."""
    rows, z, m = _with_macro(spark, d), list(_WITH_NULLS), list(MACRO)
    targets = spark.range(_TARGETS[0], _TARGETS[1] + 1).select(F.col("id").cast("int").alias("quarter_idx"))
    filled = stepwise.fills(rows, targets, z, m, LABEL, _NULL_KNOBS.window)
    log = stepwise.log_of(stepwise.fits(stepwise.moments(rows, z, m, LABEL), targets, z, m, _NULL_KNOBS, filled))
    return _round_all(log.drop("window_start", "window_end"))


@query(f"""{_ROLLED}{_ICS} SELECT quarter_idx, split, entity_id, entity_name, {r6("y")} AS future_return_1q, {r6("prediction")} AS prediction, CAST(row_number() OVER (PARTITION BY quarter_idx ORDER BY prediction DESC, entity_id) AS INTEGER) AS stagewise_rank,
{r6("(rank() OVER (PARTITION BY quarter_idx ORDER BY prediction) + (count(*) OVER (PARTITION BY quarter_idx, prediction) - 1) / 2.0) / count(*) OVER (PARTITION BY quarter_idx)")} AS stagewise_rank_pct, selected_feature_count, selected_features FROM pr""")
def stepwise_predictions(spark: SparkSession, d: str) -> DataFrame:
    out = _round_all(_ranked_predictions(spark, d))
    return out.withColumn("stagewise_rank", F.col("stagewise_rank").cast("int"))


def _ranked_predictions(spark: SparkSession, d: str) -> DataFrame:
    out = order.with_ordinal(_predicted(*_selection(spark, d)), "prediction", "entity_id", ["quarter_idx"], "stagewise_rank")
    return order.with_average_rank(out, "prediction", ["quarter_idx"], "stagewise_rank_pct", pct=True).select("quarter_idx", "split", "entity_id", "entity_name", LABEL, "prediction", "stagewise_rank", "stagewise_rank_pct", "selected_feature_count", "selected_features")


_FREQUENCY = f"{_ROLLED}, freq AS (SELECT selected_feature, count(*) AS selected_count, {r6('avg(abs(coefficient))')} AS avg_abs_coefficient, {r6('avg(step)')} AS avg_step FROM log GROUP BY 1)"


@query(f"{_FREQUENCY} SELECT * FROM freq")
def feature_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(stepwise.frequency(_log(spark, d)))


_RESIDUAL = "(y - prediction)"
_SUMMARY = [("mse", f"avg({_RESIDUAL} * {_RESIDUAL})"), ("rmse", f"sqrt(avg({_RESIDUAL} * {_RESIDUAL}))"), ("mae", f"avg(abs({_RESIDUAL}))"), ("r2", f"1 - avg({_RESIDUAL} * {_RESIDUAL}) / var_pop(y)")]


@query(f"""{_ROLLED}{_ICS}, top AS (SELECT *, row_number() OVER (PARTITION BY quarter_idx ORDER BY prediction DESC, entity_id) AS place FROM pr)
""" + " UNION ALL ".join([f"SELECT split, '{n}' AS metric, {r6(e)} AS value FROM pr WHERE y IS NOT NULL GROUP BY 1" for n, e in _SUMMARY] + [f"SELECT split, 'mean_rankic', {r6('avg(rankic)')} FROM ics GROUP BY 1"] + [f"SELECT split, 'top{k}_avg_return', {r6('avg(y)')} FROM top WHERE place <= {k} GROUP BY 1" for k in (10, 20, 30)]))
def stepwise_model_summary(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(evaluation.summary(_ranked_predictions(spark, d), "prediction", LABEL))


_STEP1 = "f_disc f_unit f_rshare f_acct".split()


@query(f"""WITH {PANEL_SQL}, long AS ({" UNION ALL ".join(f"SELECT quarter_idx, future_return_1q AS y, '{c}' AS feature, {k} AS ordinal, {c} AS x FROM panel" for k, c in enumerate(_STEP1))}),
c AS (SELECT q.t AS quarter_idx, feature, ordinal, CASE WHEN stddev_pop(x) * stddev_pop(y) > 1e-12 THEN abs(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y))) ELSE 0 END AS r FROM (SELECT CAST(i AS INTEGER) AS t FROM range(13, 28) r(i)) q JOIN long ON quarter_idx BETWEEN q.t - 12 AND q.t - 1 WHERE y IS NOT NULL GROUP BY ALL)
SELECT quarter_idx, arg_max(feature, r) AS feature, {r6("max(r)")} AS abs_corr FROM c GROUP BY 1""")
def selection_step1(spark: SparkSession, d: str) -> DataFrame:
    """The first step of each rolling window: the factor whose correlation with the label is largest in size."""
    rows = source.panel(spark, d).where(F.col(LABEL).isNotNull())
    y = F.col(LABEL)
    sums = rows.groupBy("quarter_idx").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("y"), F.sum(y * y).alias("yy"), *(f(F.col(c)).alias(f"{c}_{n}") for c in _STEP1 for n, f in (("x", F.sum), ("xx", lambda x: F.sum(x * x)), ("xy", lambda x: F.sum(x * y)))))
    targets = F.broadcast(spark.range(13, 28).select(F.col("id").cast("int").alias("target")))
    total = targets.join(sums, F.col("quarter_idx").between(F.col("target") - 12, F.col("target") - 1)).groupBy("target").agg(*(F.sum(c).alias(c) for c in sums.columns if c != "quarter_idx"))

    def corr(c: str):
        n = F.col("n")
        vx, vy = F.col(f"{c}_xx") / n - (F.col(f"{c}_x") / n) ** 2, F.col("yy") / n - (F.col("y") / n) ** 2
        scale = F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))
        return F.when(scale > 1e-12, F.abs(F.try_divide(F.col(f"{c}_xy") / n - F.col(f"{c}_x") / n * F.col("y") / n, scale))).otherwise(0.0)

    best = F.array_max(F.array(*(F.struct(corr(c).alias("r"), F.lit(-k).alias("first"), F.lit(c).alias("feature")) for k, c in enumerate(_STEP1))))
    return total.select(F.col("target").alias("quarter_idx"), best["feature"].alias("feature"), rounded(best["r"]).alias("abs_corr"))


_SCORED = f"""WITH {PANEL_SQL}, scored AS (SELECT quarter_idx, entity_id, split, future_return_1q, -f_growth AS prediction FROM panel WHERE quarter_idx >= 13)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return source.panel(spark, d).where("quarter_idx >= 13").withColumn("prediction", -F.col("f_growth"))


def _rank_sql(x: str, part: str = "quarter_idx") -> str:
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0)"


_PAIRED = f"{_SCORED}, k AS (SELECT quarter_idx, split, {_rank_sql('prediction')} AS a, {_rank_sql('future_return_1q')} AS b FROM scored WHERE prediction IS NOT NULL AND future_return_1q IS NOT NULL)"


@query(f"{_PAIRED} SELECT quarter_idx, {r6('CASE WHEN count(*) >= 3 THEN corr(a, b) END')} AS rankic, count(*) AS n_entities FROM k GROUP BY 1")
def rank_ic(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(evaluation.rank_ic(_scored(spark, d), "prediction", LABEL))


_ERR = "(future_return_1q - prediction)"


@query(f"{_SCORED} SELECT split, {r6(f'avg({_ERR} * {_ERR})')} AS mse, {r6(f'sqrt(avg({_ERR} * {_ERR}))')} AS rmse, {r6(f'avg(abs({_ERR}))')} AS mae, {r6(f'1 - avg({_ERR} * {_ERR}) / var_pop(future_return_1q)')} AS r2 FROM scored WHERE prediction IS NOT NULL AND future_return_1q IS NOT NULL GROUP BY 1")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(evaluation.regression(_scored(spark, d), "prediction", LABEL))


@query(f"""{_PAIRED}, ic AS (SELECT split, avg(r) AS v FROM (SELECT quarter_idx, split, corr(a, b) AS r FROM k GROUP BY 1, 2) GROUP BY 1),
top AS (SELECT *, row_number() OVER (PARTITION BY quarter_idx ORDER BY prediction DESC, entity_id) AS place FROM scored WHERE prediction IS NOT NULL),
base AS (SELECT * FROM scored WHERE prediction IS NOT NULL AND future_return_1q IS NOT NULL)
""" + " UNION ALL ".join([f"SELECT split, '{n}' AS metric, {r6(e)} AS value FROM base GROUP BY 1" for n, e in (("mse", f"avg({_ERR} * {_ERR})"), ("rmse", f"sqrt(avg({_ERR} * {_ERR}))"), ("mae", f"avg(abs({_ERR}))"), ("r2", f"1 - avg({_ERR} * {_ERR}) / var_pop(future_return_1q)"))] + [f"SELECT split, 'mean_rankic', {r6('v')} FROM ic"] + [f"SELECT split, 'top{k}_avg_return', {r6('avg(future_return_1q)')} FROM top WHERE place <= {k} GROUP BY 1" for k in (10, 20, 30)]))
def model_summary(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(evaluation.summary(_scored(spark, d), "prediction", LABEL))


# --- entropy weights and PROMETHEE -------------------------------------------------------------------------------------

_BENEFIT = f"""WITH {PANEL_SQL}, long AS ({" UNION ALL ".join(f"SELECT quarter_idx, entity_id, '{c}' AS feature, {'' if s >= 0 else '-'}{c} AS value FROM panel WHERE quarter_idx >= 13" for c, s in FEATURES.items())}),
filled AS (SELECT quarter_idx, entity_id, feature, coalesce(value, median(value) OVER (PARTITION BY quarter_idx, feature), 0) AS value FROM long),
ben AS (SELECT *, CASE WHEN max(value) OVER w - min(value) OVER w < 1e-12 THEN 0.5 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END AS benefit FROM filled WINDOW w AS (PARTITION BY quarter_idx, feature)),
sh AS (SELECT *, CASE WHEN sum(benefit) OVER (PARTITION BY quarter_idx, feature) > 0 THEN benefit / sum(benefit) OVER (PARTITION BY quarter_idx, feature) END AS p FROM ben),
en AS (SELECT quarter_idx, feature, count(*) AS n, coalesce(sum(CASE WHEN p > 0 THEN -p * ln(p) END) / ln(count(*)), 1) AS entropy FROM sh GROUP BY 1, 2),
we AS (SELECT quarter_idx, feature, entropy, CASE WHEN sum(greatest(0, 1 - entropy)) OVER (PARTITION BY quarter_idx) <= 1e-12 THEN 1.0 / count(*) OVER (PARTITION BY quarter_idx) ELSE greatest(0, 1 - entropy) / sum(greatest(0, 1 - entropy)) OVER (PARTITION BY quarter_idx) END AS weight FROM en WHERE n > 1)"""
_FLOWS = f"""{_BENEFIT}, fl0 AS (SELECT a.quarter_idx, a.entity_id, sum(weight * greatest(a.benefit - b.benefit, 0)) AS plus, sum(weight * greatest(b.benefit - a.benefit, 0)) AS minus, count(DISTINCT b.entity_id) AS others
FROM ben a JOIN ben b ON a.quarter_idx = b.quarter_idx AND a.feature = b.feature AND a.entity_id <> b.entity_id JOIN we ON we.quarter_idx = a.quarter_idx AND we.feature = a.feature GROUP BY 1, 2),
fl AS (SELECT quarter_idx, entity_id, plus / others AS phi_plus, minus / others AS phi_minus, plus / others - minus / others AS net_flow FROM fl0)"""


def _benefits(spark: SparkSession, d: str) -> DataFrame:
    rows = source.panel(spark, d).where("quarter_idx >= 13").select("quarter_idx", "entity_id", *FEATURES).persist()
    return mcda.benefits(mcda.long_form(rows, FEATURES)).persist()


@query(f"{_BENEFIT} SELECT quarter_idx, entity_id, feature, {r6('benefit')} AS benefit FROM ben")
def minmax_direction(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(_benefits(spark, d))


@query(f"{_BENEFIT} SELECT quarter_idx, feature, {r6('entropy')} AS entropy, {r6('weight')} AS weight FROM we")
def entropy_weights(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(mcda.entropy_weights(_benefits(spark, d)))


def _flows(spark: SparkSession, d: str) -> DataFrame:
    benefit = _benefits(spark, d)
    return mcda.flows(benefit, mcda.entropy_weights(benefit))


@query(f"{_FLOWS} SELECT quarter_idx, entity_id, {r6('phi_plus')} AS phi_plus, {r6('phi_minus')} AS phi_minus, {r6('net_flow')} AS net_flow FROM fl")
def promethee_flows(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(_flows(spark, d))


@query(f"{_FLOWS} SELECT quarter_idx, entity_id, CAST(row_number() OVER (PARTITION BY quarter_idx ORDER BY round(net_flow, 9) DESC, entity_id) AS INTEGER) AS promethee_rank FROM fl")
def promethee_rank(spark: SparkSession, d: str) -> DataFrame:
    ranked = order.with_ordinal(_round_all(_flows(spark, d), 9), "net_flow", "entity_id", ["quarter_idx"], "promethee_rank")
    return ranked.select("quarter_idx", "entity_id", F.col("promethee_rank").cast("int").alias("promethee_rank"))


#: Composites of a quarter that the net flows use at most, as published.
TOP_COMPOSITES = 20


def _picks(spark: SparkSession, log: DataFrame, last: int = _TARGETS[1]) -> DataFrame:
    chosen = log.select("quarter_idx", F.col("selected_feature").alias("feature"), "step", "coefficient")
    targets = spark.range(_TARGETS[0], last + 1).select(F.col("id").cast("int").alias("quarter_idx"))
    return mcda.selected_features(chosen, targets, TOP_COMPOSITES)


@query(f"""{_ROLLED}, past AS (SELECT t.q AS quarter_idx, selected_feature AS feature, count(*) AS n, avg(abs(coefficient)) AS strength, avg(coefficient) AS coefficient FROM (SELECT CAST(i AS INTEGER) AS q FROM range(28, 31) r(i)) t JOIN log ON quarter_idx < t.q GROUP BY ALL),
listed AS (SELECT quarter_idx, selected_feature AS feature, CAST(row_number() OVER (PARTITION BY quarter_idx ORDER BY step) AS INTEGER) AS place, coefficient FROM log
UNION ALL SELECT quarter_idx, feature, CAST(row_number() OVER (PARTITION BY quarter_idx ORDER BY n DESC, strength DESC, feature) AS INTEGER), coefficient FROM past)
SELECT quarter_idx, feature, place, {r6('coefficient')} AS coefficient FROM listed WHERE place <= {TOP_COMPOSITES}""")
def selected_features(spark: SparkSession, d: str) -> DataFrame:
    """Own picks of the quarters with a selection, and for 28 to 30, which have none, the composites picked most often before."""
    return _round_all(_picks(spark, _log(spark, d), 30))


@query(f"{_ROLLED} SELECT quarter_idx, selected_feature AS feature, CAST(row_number() OVER (PARTITION BY quarter_idx ORDER BY step) AS INTEGER) AS place, {r6('coefficient')} AS coefficient FROM log QUALIFY place <= {TOP_COMPOSITES}")
def selected_composites(spark: SparkSession, d: str) -> DataFrame:
    """The composites of each quarter's net flows, with the coefficient whose sign is their direction."""
    return _round_all(_picks(spark, _log(spark, d)))


def _composite_benefits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Benefits of each quarter's selected composites, and the picks."""
    rows, fitted = _selection(spark, d)
    names, picks = stepwise.catalogue([f"z_{f}" for f in ELIGIBLE], [f"z_{x}" for x in MACRO]), _picks(spark, stepwise.log_of(fitted))
    return mcda.benefits(mcda.composite_form(rows, picks, names)).persist(), picks


def _composite_flows(spark: SparkSession, d: str) -> DataFrame:
    """Net flows over each quarter's selected composites."""
    benefit, _ = _composite_benefits(spark, d)
    return mcda.flows(benefit, mcda.entropy_weights(benefit))


_PICKED = f"{_ROLLED}, {selection_sql.signed([f'composite_z_{a}__z_{b}' for a, b in _PAIRS])}, long AS (SELECT * FROM picked), filled AS ({_BENEFIT.split('filled AS (', 1)[1]}"


@query(f"{_PICKED} SELECT we.quarter_idx, feature, {r6('entropy')} AS entropy, {r6('weight')} AS weight, {r6('coefficient')} AS coefficient_for_direction, CASE WHEN coefficient >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM we JOIN log ON log.quarter_idx = we.quarter_idx AND selected_feature = feature")
def promethee_weight_log(spark: SparkSession, d: str) -> DataFrame:
    """Entropy, weight and direction of every selected composite of every quarter."""
    benefit, picks = _composite_benefits(spark, d)
    return _round_all(mcda.weight_log(mcda.entropy_weights(benefit), picks))


# --- hybrid scores, portfolios, ratings --------------------------------------------------------------------------------

_HYBRID = f"""{_FLOWS}, scored AS (SELECT quarter_idx, entity_id, split, future_return_1q, -f_growth AS prediction FROM panel WHERE quarter_idx >= 13), h0 AS (SELECT scored.*, round(net_flow, 9) AS net_flow FROM scored JOIN fl USING (quarter_idx, entity_id)),
h1 AS (SELECT *, CASE WHEN prediction IS NOT NULL THEN {_rank_sql("prediction")} / count(prediction) OVER (PARTITION BY quarter_idx) END AS pure_stagewise_score, {_rank_sql("net_flow")} / count(net_flow) OVER (PARTITION BY quarter_idx) AS pure_promethee_score FROM h0),
hybrid AS (SELECT *, round(0.5 * pure_promethee_score + 0.5 * pure_stagewise_score, 9) AS hybrid_score_50_50, round(0.7 * pure_promethee_score + 0.3 * pure_stagewise_score, 9) AS hybrid_score_70_30, round(0.3 * pure_promethee_score + 0.7 * pure_stagewise_score, 9) AS hybrid_score_30_70 FROM h1)"""
_SCORES = [name for name, _ in portfolio.TOPK_PLAN]
_PLAN = ", ".join(f"('{n}_top{k}', '{n}', {k})" for n, ks in portfolio.TOPK_PLAN for k in ks)
_HELD = f"""{_HYBRID}, scores AS ({" UNION ALL ".join(f"SELECT quarter_idx, split, entity_id, future_return_1q, '{n}' AS score_col, {n} AS score FROM hybrid" for n in _SCORES)}),
rk AS (SELECT *, row_number() OVER (PARTITION BY score_col, quarter_idx ORDER BY score DESC, entity_id) AS portfolio_rank FROM scores WHERE score IS NOT NULL AND future_return_1q IS NOT NULL),
held AS (SELECT strategy, rk.*, topk, 1.0 / count(*) OVER (PARTITION BY strategy, quarter_idx) AS weight FROM rk JOIN (VALUES {_PLAN}) p(strategy, sc, topk) ON sc = score_col AND portfolio_rank <= topk)"""
_RETURNS = f"""{_HELD}, per AS (SELECT strategy, quarter_idx, lag(quarter_idx) OVER (PARTITION BY strategy ORDER BY quarter_idx) AS prev FROM (SELECT DISTINCT strategy, quarter_idx FROM held)),
chg AS (SELECT per.strategy, per.quarter_idx, coalesce(n.entity_id, o.entity_id) AS e, coalesce(n.weight, 0) - coalesce(o.weight, 0) AS dw FROM per JOIN held n ON n.strategy = per.strategy AND n.quarter_idx = per.quarter_idx LEFT JOIN held o ON o.strategy = per.strategy AND o.quarter_idx = per.prev AND o.entity_id = n.entity_id
UNION ALL SELECT per.strategy, per.quarter_idx, o.entity_id, -o.weight FROM per JOIN held o ON o.strategy = per.strategy AND o.quarter_idx = per.prev WHERE NOT EXISTS (SELECT 1 FROM held n WHERE n.strategy = per.strategy AND n.quarter_idx = per.quarter_idx AND n.entity_id = o.entity_id)),
turn AS (SELECT strategy, quarter_idx, 0.5 * sum(abs(dw)) AS turnover FROM chg GROUP BY 1, 2),
bench AS (SELECT quarter_idx, avg(future_return_1q) AS benchmark_return FROM hybrid GROUP BY 1),
ret AS (SELECT strategy, score_col, topk, quarter_idx, split, sum(weight * future_return_1q) AS portfolio_return, count(*) AS holding_count FROM held GROUP BY ALL),
q AS (SELECT ret.*, benchmark_return, portfolio_return - benchmark_return AS excess_return, turnover FROM ret JOIN bench USING (quarter_idx) JOIN turn USING (strategy, quarter_idx))"""


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _blended(_scored(spark, d), _flows(spark, d))


def _blended(scored: DataFrame, flows: DataFrame) -> DataFrame:
    """Hybrid scores of predictions and net flows, rounded so that ties are ties."""
    out = portfolio.hybrid_scores(scored, _round_all(flows, 9))
    return out.withColumns({c: rounded(F.col(c), 9) for c in out.columns if c.startswith("hybrid")}).persist()


@query(f"{_HYBRID} SELECT quarter_idx, split, entity_id, net_flow, {', '.join(f'{r6(c)} AS {c}' for c in ('future_return_1q', 'prediction', *_SCORES))} FROM hybrid")
def hybrid_scores(spark: SparkSession, d: str) -> DataFrame:
    out = _hybrid(spark, d)  # net flows are rounded already
    return out.withColumns({c: rounded(F.col(c)) for c in (LABEL, "prediction", *_SCORES)})


@query(f"{_HELD} SELECT strategy, score_col, topk, quarter_idx, split, entity_id, {r6('score')} AS score, portfolio_rank, {r6('weight')} AS weight FROM held")
def topk_holdings(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(portfolio.holdings(_hybrid(spark, d)).select("strategy", "score_col", "topk", "quarter_idx", "split", "entity_id", "score", F.col("portfolio_rank").cast("long").alias("portfolio_rank"), "weight"))


def _returns(spark: SparkSession, d: str) -> DataFrame:
    scores = _hybrid(spark, d)
    return portfolio.returns(scores, portfolio.holdings(scores))


@query(f"{_RETURNS} SELECT strategy, score_col, topk, quarter_idx, split, {r6('portfolio_return')} AS portfolio_return, {r6('benchmark_return')} AS benchmark_return, {r6('excess_return')} AS excess_return, {r6('turnover')} AS turnover, holding_count FROM q")
def topk_quarterly_returns(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(_returns(spark, d).select("strategy", "score_col", "topk", "quarter_idx", "split", "portfolio_return", "benchmark_return", "excess_return", "turnover", "holding_count"))


@query(f"{_RETURNS} SELECT strategy, quarter_idx, {r6('turnover')} AS turnover FROM turn")
def topk_turnover(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(portfolio.turnover(portfolio.holdings(_hybrid(spark, d))))


_PERF = f"""{_RETURNS}, sc AS (SELECT 'all' AS scope, *, portfolio_return / 100 AS r, benchmark_return / 100 AS b FROM q UNION ALL SELECT split, *, portfolio_return / 100, benchmark_return / 100 FROM q),
eq AS (SELECT scope, strategy, quarter_idx, product(1 + r) OVER (PARTITION BY scope, strategy ORDER BY quarter_idx ROWS UNBOUNDED PRECEDING) AS equity FROM sc),
dd AS (SELECT scope, strategy, min(equity / peak - 1) AS max_drawdown FROM (SELECT *, max(equity) OVER (PARTITION BY scope, strategy ORDER BY quarter_idx ROWS UNBOUNDED PRECEDING) AS peak FROM eq) GROUP BY 1, 2),
pm AS (SELECT scope, strategy, count(*) AS period_count, avg(portfolio_return) AS holding_period_avg_return, product(1 + r) - 1 AS cumulative_return, stddev_samp(r) * 2 AS annualized_volatility, avg(r) AS mr, avg(b) AS mb, covar_samp(r, b) / var_samp(b) AS beta, avg(CASE WHEN r > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS win_rate, avg(turnover) AS average_turnover FROM sc GROUP BY 1, 2)"""


@query(f"""{_PERF} SELECT scope, strategy, period_count, {", ".join(f"{r6(e)} AS {n}" for n, e in (("holding_period_avg_return", "holding_period_avg_return"), ("cumulative_return", "cumulative_return"), ("annualized_volatility", "annualized_volatility"), ("beta", "beta"), ("win_rate", "win_rate"), ("average_turnover", "average_turnover"), ("annualized_return", "pow(1 + cumulative_return, 4.0 / period_count) - 1"), ("sharpe_ratio", "(pow(1 + cumulative_return, 4.0 / period_count) - 1) / annualized_volatility"), ("alpha", "(mr - beta * mb) * 4"), ("max_drawdown", "max_drawdown")))} FROM pm JOIN dd USING (scope, strategy)""")
def perf_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(portfolio.performance(_returns(spark, d)))


@query(f"{_PERF} SELECT scope, strategy, {r6('max_drawdown')} AS max_drawdown FROM dd")
def max_drawdown(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(portfolio.drawdowns(portfolio.scoped(_returns(spark, d))))


_RATED = f"""{_HYBRID}, rated0 AS (SELECT *, row_number() OVER (PARTITION BY quarter_idx ORDER BY hybrid_score_50_50 DESC, entity_id) AS rating_rank, count(*) OVER (PARTITION BY quarter_idx) AS n FROM hybrid WHERE hybrid_score_50_50 IS NOT NULL),
rated AS (SELECT *, CAST(least(floor((rating_rank - 1) * 13.0 / n), 12) AS INTEGER) + 1 AS g, [{", ".join(f"'{g}'" for g in GRADES)}][CAST(least(floor((rating_rank - 1) * 13.0 / n), 12) AS INTEGER) + 1] AS rating FROM rated0)"""


def _rated(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.ratings(_hybrid(spark, d), "hybrid_score_50_50")


@query(f"{_RATED} SELECT quarter_idx, split, entity_id, rating, CAST(rating_rank AS BIGINT) AS rating_rank, {r6('hybrid_score_50_50')} AS hybrid_score_50_50 FROM rated")
def rating_panel(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(_rated(spark, d).select("quarter_idx", "split", "entity_id", "rating", F.col("rating_rank").cast("long").alias("rating_rank"), "hybrid_score_50_50"))


@query(f"{_RATED} SELECT split, rating, {r6('avg(future_return_1q)')} AS avg_future_return, {r6('median(future_return_1q)')} AS median_future_return, count(entity_id) AS stock_count, {r6('avg(CASE WHEN future_return_1q > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)')} AS positive_rate, CAST(max(g) AS BIGINT) AS rating_order FROM rated GROUP BY 1, 2")
def rating_performance(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(portfolio.rating_performance(_rated(spark, d)))


# --- tables behind the figures -----------------------------------------------------------------------------------------


@query(f"{_RETURNS} SELECT quarter_idx, {', '.join(f'{r6(f'avg(excess_return) FILTER (strategy = {chr(39)}{n}_top10{chr(39)})')} AS {n}_top10' for n in _SCORES)} FROM q GROUP BY 1")
def excess_return_pivot(spark: SparkSession, d: str) -> DataFrame:
    names = [f"{n}_top10" for n in _SCORES]
    return _round_all(_returns(spark, d).where(F.col("strategy").isin(names)).groupBy("quarter_idx").pivot("strategy", names).agg(F.avg("excess_return")))


@query(f"{_RETURNS} SELECT strategy, quarter_idx, {r6('product(1 + portfolio_return / 100) OVER (PARTITION BY strategy ORDER BY quarter_idx ROWS UNBOUNDED PRECEDING)')} AS equity FROM q")
def cumulative_curves(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("strategy").orderBy("quarter_idx").rowsBetween(Window.unboundedPreceding, 0)
    return _returns(spark, d).select("strategy", "quarter_idx", rounded(F.product(1 + F.col("portfolio_return") / 100).over(order)).alias("equity"))


@query(f"{_HYBRID} SELECT split, {r6('corr(pure_stagewise_score, pure_promethee_score)')} AS score_correlation, count(*) AS n FROM hybrid WHERE pure_stagewise_score IS NOT NULL GROUP BY 1")
def score_agreement_corr(spark: SparkSession, d: str) -> DataFrame:
    rows = _hybrid(spark, d).where("pure_stagewise_score IS NOT NULL")
    return rows.groupBy("split").agg(rounded(correlation(F.col("pure_stagewise_score"), F.col("pure_promethee_score"))).alias("score_correlation"), F.count(F.lit(1)).alias("n"))


@query(f"{_RATED}, l AS (SELECT unnest([{', '.join(f'{chr(39)}{g}{chr(39)}' for g in (*GRADES, 'NR'))}]) AS rating) SELECT l.rating, count(entity_id) AS stock_count FROM l LEFT JOIN rated ON rated.rating = l.rating GROUP BY 1")
def grade_counts(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.createDataFrame([(g,) for g in (*GRADES, "NR")], "rating string")
    return labels.join(_rated(spark, d).groupBy("rating").agg(F.count("entity_id").alias("n")), "rating", "left").select("rating", F.coalesce("n", F.lit(0)).alias("stock_count"))


@query(f"{_RATED} SELECT quarter_idx, " + ", ".join(f"{r6(f'avg(future_return_1q) FILTER (rating = {chr(39)}{g}{chr(39)})')} AS \"{g}\"" for g in GRADES) + " FROM rated GROUP BY 1")
def grade_quarter_pivot(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(_rated(spark, d).groupBy("quarter_idx").pivot("rating", list(GRADES)).agg(F.avg(LABEL)).select("quarter_idx", *(F.col(f"`{g}`") for g in GRADES)))


_PROFILE = ("annualized_return", "annualized_volatility", "sharpe_ratio", "max_drawdown", "win_rate", "average_turnover")


def _profile_sql() -> str:
    scaled = ", ".join(f"{r6(f'CASE WHEN max({c}) OVER () - min({c}) OVER () < 1e-12 THEN 0.5 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END')} AS {c}" for c in _PROFILE)
    return f"""{_PERF}, m AS (SELECT strategy, pow(1 + cumulative_return, 4.0 / period_count) - 1 AS annualized_return, annualized_volatility, (pow(1 + cumulative_return, 4.0 / period_count) - 1) / annualized_volatility AS sharpe_ratio, max_drawdown, win_rate, average_turnover FROM pm JOIN dd USING (scope, strategy) WHERE scope = 'all')
SELECT strategy, {scaled} FROM m"""


@query(_profile_sql())
def metric_profile(spark: SparkSession, d: str) -> DataFrame:
    """Six measures of each strategy on a common scale; a row for each strategy, so one window over all is small."""
    rows = portfolio.performance(_returns(spark, d)).where("scope = 'all'")
    return rows.select("strategy", *(rounded(min_max(F.col(c), Window.partitionBy())).alias(c) for c in _PROFILE))


@query(f"{_PERF} SELECT strategy, {r6('annualized_volatility')} AS annualized_volatility, {r6('pow(1 + cumulative_return, 4.0 / period_count) - 1')} AS annualized_return FROM pm WHERE scope = 'all'")
def risk_return_points(spark: SparkSession, d: str) -> DataFrame:
    """A point for each strategy, over all quarters."""
    return _round_all(portfolio.performance(_returns(spark, d)).where("scope = 'all'").select("strategy", "annualized_volatility", "annualized_return"))


@query(f"{_RETURNS} SELECT quarter_idx, {', '.join(f'{r6(f'avg(turnover) FILTER (strategy = {chr(39)}{n}_top10{chr(39)})')} AS {n}_top10' for n in _SCORES)} FROM q GROUP BY 1")
def turnover_series(spark: SparkSession, d: str) -> DataFrame:
    """Turnover of the ten best by each score, a column for each strategy."""
    names = [f"{n}_top10" for n in _SCORES]
    return _round_all(_returns(spark, d).where(F.col("strategy").isin(names)).groupBy("quarter_idx").pivot("strategy", names).agg(F.avg("turnover")))


@query(f"{_JOINED}, c AS ({_CATALOG}) SELECT 'stock_factor' AS kind, count(DISTINCT stock_factor) AS n FROM c WHERE n_values > 0 UNION ALL SELECT 'macro_factor', count(DISTINCT macro_factor) FROM c WHERE n_values > 0 UNION ALL SELECT 'composite', count(*) FROM c WHERE n_values > 0")
def factor_counts(spark: SparkSession, d: str) -> DataFrame:
    """Factors, macro series and composites of the catalogue that have values."""
    catalogue = composite_catalog(spark, d).where("n_values > 0")
    counts = catalogue.agg(F.countDistinct("stock_factor").alias("a"), F.countDistinct("macro_factor").alias("b"), F.count(F.lit(1)).alias("c"))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(n).alias("n")) for k, n in (("stock_factor", "a"), ("macro_factor", "b"), ("composite", "c"))))))


@query(f"{_ROLLED} SELECT selected_feature, {', '.join(f'{r6(f'coalesce(avg(coefficient) FILTER (quarter_idx = {q}), 0)')} AS \"{q}\"' for q in range(_TARGETS[0], _TARGETS[1] + 1))} FROM log GROUP BY 1")
def coef_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """Mean coefficient by feature and quarter, 0 where a feature was not selected."""
    return _round_all(_log(spark, d).groupBy("selected_feature").pivot("quarter_idx", list(range(13, 28))).agg(F.avg("coefficient")).fillna(0.0))


@query(f"{_FREQUENCY} SELECT * FROM freq ORDER BY selected_count DESC, selected_feature LIMIT 20")
def top_selected_features(spark: SparkSession, d: str) -> DataFrame:
    return feature_frequency(spark, d).orderBy(F.desc("selected_count"), "selected_feature").limit(20)


@query()
def score_sample(spark: SparkSession, d: str) -> DataFrame:
    """Rows for the scatter of the two scores, coloured by the label: all that have the three, or a seeded sample of 6000, as the figure shows.

    colour is the label within its 2 and 98 % bounds."""
    rows = _sampled(_hybrid(spark, d), 6000)
    bounds = rows.agg(F.percentile(LABEL, F.array(F.lit(0.02), F.lit(0.98))).alias("_bounds"))  # of 6000 values at most
    return rows.crossJoin(F.broadcast(bounds)).withColumn("colour", clipped(F.col(LABEL), F.get("_bounds", F.lit(0)), F.get("_bounds", F.lit(1)))).drop("_bounds")


def _sampled(scores: DataFrame, most: int) -> DataFrame:
    rows = scores.select("quarter_idx", "entity_id", "pure_stagewise_score", "pure_promethee_score", LABEL).dropna(subset=["pure_stagewise_score", "pure_promethee_score", LABEL])
    return rows.orderBy(F.xxhash64(F.lit(7), "quarter_idx", "entity_id"), "quarter_idx", "entity_id").limit(most)


def _mainline_sql() -> str:
    """The SQL of perf_metrics, with the selected composites for its factors and the rolling predictions for its scores."""
    _, after = SQL["perf_metrics"].split("filled AS (", 1)
    own = after.replace("scored AS (SELECT quarter_idx, entity_id, split, future_return_1q, -f_growth AS prediction FROM panel WHERE quarter_idx >= 13)", "scored AS (SELECT quarter_idx, entity_id, split, y AS future_return_1q, prediction FROM pr)")
    names = [f"composite_z_{a}__z_{b}" for a, b in _PAIRS]
    return f"{_ROLLED}{_ICS}, {selection_sql.signed(names)}, long AS (SELECT * FROM picked), filled AS ({own}"


@query(_mainline_sql())
def mainline_performance(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain: rolling selection, predictions, entropy-weighted flows of the selected composites, hybrid scores, portfolios, measures."""
    scores = _blended(_ranked_predictions(spark, d), _composite_flows(spark, d))
    return _round_all(portfolio.performance(portfolio.returns(scores, portfolio.holdings(scores))))
