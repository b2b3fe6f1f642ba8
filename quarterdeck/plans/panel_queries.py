"""Queries on the panel and the macro series: profiles, labels, alignment, preprocessing, schema and audits."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarterdeck.functions import order
from quarterdeck.functions.stats import rounded
from quarterdeck.operators import audit, labels, macro, preprocess, profile, scalers, schema
from quarterdeck.sources import files
from quarterdeck.sources import panel as source
from quarterdeck.sources.panel import FACTORS, MACRO, MONTHLY_SQL, PANEL_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}

PROFILED = (*FACTORS, "f_miss")
KEYWORDS = ("license", "the", "que", "und")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def union(template: str, names) -> str:
    return " UNION ALL ".join(template.replace("$c", n) for n in names)


@query(f"""WITH {PANEL_SQL} SELECT quarter_idx, entity_id, {r6("(rank() OVER (PARTITION BY quarter_idx ORDER BY f_growth) + (count(*) OVER (PARTITION BY quarter_idx, f_growth) - 1) / 2.0) / count(f_growth) OVER (PARTITION BY quarter_idx)")} AS rank_pct
FROM panel WHERE f_growth IS NOT NULL""")
def avg_rank_pct(spark: SparkSession, d: str) -> DataFrame:
    rows = order.with_average_rank(source.panel(spark, d).select("quarter_idx", "entity_id", "f_growth"), "f_growth", ["quarter_idx"], "rank_pct", pct=True)
    return rows.where("f_growth IS NOT NULL").select("quarter_idx", "entity_id", rounded(F.col("rank_pct")).alias("rank_pct"))


@query(f"WITH {PANEL_SQL} SELECT quarter_idx, {r6('avg(future_return_1q)')} AS benchmark_return, count(future_return_1q) AS n FROM panel GROUP BY 1")
def benchmark_return(spark: SparkSession, d: str) -> DataFrame:
    return source.panel(spark, d).groupBy("quarter_idx").agg(rounded(F.avg("future_return_1q")).alias("benchmark_return"), F.count("future_return_1q").alias("n"))


_PROFILE = f"""SELECT '$c' AS "column", CAST(count($c) AS DOUBLE) AS n, {r6("avg(CASE WHEN $c IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)")} AS missing_rate,
{", ".join(f"{r6(f'quantile_cont($c, {q})')} AS q{n}" for n, q in (("01", 0.01), ("05", 0.05), ("50", 0.5), ("95", 0.95), ("99", 0.99)))},
{r6("avg($c)")} AS mean, {r6("stddev_samp($c)")} AS std, {r6("skewness($c)")} AS skew, {r6("kurtosis($c)")} AS kurtosis,
{r6("avg(CASE WHEN $c IS NULL THEN NULL WHEN $c = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)")} AS zero_rate, {r6("avg(CASE WHEN $c IS NULL THEN NULL WHEN $c < 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)")} AS negative_rate FROM panel"""


@query(f"WITH {PANEL_SQL} {union(_PROFILE, PROFILED)}")
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.profiled(source.panel(spark, d), list(PROFILED))


@query(f"WITH {PANEL_SQL} SELECT * FROM ({union(f'''SELECT '$c' AS "column", {r6("avg(CASE WHEN $c IS NULL OR trim(CAST($c AS VARCHAR)) = '' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)")} AS missing_rate FROM panel''', FACTORS + ('f_miss', 'entity_name'))}) WHERE missing_rate > 0")
def missingness(spark: SparkSession, d: str) -> DataFrame:
    return profile.missingness(source.panel(spark, d), [*FACTORS, "f_miss", "entity_name"])


_OUTLIERS = f"""SELECT '$c' AS "column", {r6("max(q1)")} AS q1, {r6("max(q3)")} AS q3, {r6("avg(CASE WHEN $c IS NULL THEN NULL WHEN $c < q1 - 3 * (q3 - q1) OR $c > q3 + 3 * (q3 - q1) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)")} AS outlier_rate
FROM panel, (SELECT quantile_cont($c, 0.25) AS q1, quantile_cont($c, 0.75) AS q3 FROM panel)"""


@query(f"WITH {PANEL_SQL} {union(_OUTLIERS, PROFILED)}")
def iqr_outliers(spark: SparkSession, d: str) -> DataFrame:
    return profile.outliers(source.panel(spark, d), list(PROFILED))


@query("SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS all_members, CAST(sum(n - 1) AS BIGINT) AS extras FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return profile.duplicate_keys(source.table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query(f"WITH {PANEL_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS check_name, {r6(f'avg(CASE WHEN {c} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)')} AS rate FROM panel" for n, c in (("negative_growth", "f_growth < 0"), ("growth_over_100", "abs(f_growth) > 100"), ("negative_balance", "f_acct < 0"))))
def conditional_rates(spark: SparkSession, d: str) -> DataFrame:
    return profile.conditional_rates(source.panel(spark, d), {"negative_growth": F.col("f_growth") < 0, "growth_over_100": F.abs("f_growth") > 100, "negative_balance": F.col("f_acct") < 0})


@query("SELECT quarter(o_orderdate) AS sheet, count(*) AS row_count, count(DISTINCT o_custkey) AS unique_keys, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_rows FROM (SELECT o_orderdate, o_custkey, count(*) OVER (PARTITION BY quarter(o_orderdate), o_custkey) AS n FROM orders) GROUP BY 1")
def sheet_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = source.table(spark, d, "orders").select(F.quarter("o_orderdate").cast("long").alias("sheet"), "o_custkey")
    return profile.sheet_summary(rows, "sheet", "o_custkey")


_BESIDE = """, beside AS (SELECT a.entity_id, a.quarter_idx, a.future_return_1q AS label_value, b.ret_3m AS next_value, b.entity_id IS NOT NULL AS has_next
FROM panel a LEFT JOIN panel b ON b.entity_id = a.entity_id AND b.quarter_idx = a.quarter_idx + 1)"""
_HIT = "abs(label_value - next_value) <= 1e-8 + 1e-6 * abs(next_value)"


@query(f"""WITH {PANEL_SQL}{_BESIDE}, g AS (SELECT quarter_idx, count(*) AS row_count, count(*) FILTER (has_next) AS overlap_count, count(label_value - next_value) AS valid_pairs,
count(*) FILTER ({_HIT}) AS match_count, count(*) FILTER (NOT ({_HIT})) AS mismatch_count, {r6("coalesce(max(abs(label_value - next_value)), 0)")} AS max_abs_error FROM beside GROUP BY 1)
SELECT *, CASE WHEN valid_pairs > 0 THEN match_count / valid_pairs END AS match_rate,
CASE WHEN overlap_count = 0 THEN 'tail_without_t_plus_1' WHEN valid_pairs = 0 THEN 'no_valid_pairs' WHEN match_count / valid_pairs >= 0.99 THEN 'pass' ELSE 'fail' END AS status FROM g""")
def label_shift_report(spark: SparkSession, d: str) -> DataFrame:
    out = labels.shift_report(source.panel(spark, d), "future_return_1q", "ret_3m")
    return out.withColumn("max_abs_error", rounded(F.col("max_abs_error")))


@query(f"""WITH {PANEL_SQL}, shifted AS (SELECT entity_id, quarter_idx, CASE WHEN entity_id % 10 = 3 THEN ret_3m ELSE future_return_1q END AS label_value FROM panel), beside AS (SELECT a.*, b.ret_3m AS next_value
FROM shifted a JOIN panel b ON b.entity_id = a.entity_id AND b.quarter_idx = a.quarter_idx + 1)
SELECT entity_id, quarter_idx, {r6("label_value")} AS label_value, {r6("next_value")} AS next_value, CASE WHEN label_value IS NULL THEN 'label_missing' WHEN next_value IS NULL THEN 'next_missing' ELSE 'value_mismatch' END AS error_type
FROM beside WHERE (label_value IS NULL) <> (next_value IS NULL) OR NOT ({_HIT}) ORDER BY quarter_idx, entity_id LIMIT 200""")
def label_shift_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """A label that a tenth of the entities carry unshifted; the first 200 anomalies."""
    rows = source.panel(spark, d).withColumn("bad", F.when(F.col("entity_id") % 10 == 3, F.col("ret_3m")).otherwise(F.col("future_return_1q")))
    out = labels.anomalies(rows, "bad", "ret_3m", 200)
    return out.select("entity_id", "quarter_idx", rounded(F.col("label_value")).alias("label_value"), rounded(F.col("next_value")).alias("next_value"), "error_type")


@query(f"WITH {PANEL_SQL} SELECT a.entity_id, a.quarter_idx, {r6('b.ret_3m')} AS rebuilt_label FROM panel a LEFT JOIN panel b ON b.entity_id = a.entity_id AND b.quarter_idx = a.quarter_idx + 1")
def label_rebuild(spark: SparkSession, d: str) -> DataFrame:
    return labels.rebuilt(source.panel(spark, d), "ret_3m").withColumn("rebuilt_label", rounded(F.col("rebuilt_label")))


@query(f"""WITH {PANEL_SQL}{_BESIDE} SELECT entity_id, quarter_idx, {r6("label_value")} AS label, 'supplied_label' AS label_source,
CASE WHEN label_value IS NOT NULL THEN 'available' WHEN quarter_idx = (SELECT max(quarter_idx) FROM panel) THEN 'tail' ELSE 'missing' END AS label_status, quarter_idx = (SELECT max(quarter_idx) FROM panel) AS is_tail_quarter FROM beside""")
def model_ready_panel(spark: SparkSession, d: str) -> DataFrame:
    return labels.model_ready(source.panel(spark, d), "future_return_1q", "ret_3m", trusted=True).withColumn("label", rounded(F.col("label")))


def _quarterly_sql(mean: bool) -> str:
    values = ", ".join(f"{r6(f'avg({m})' if mean else f'arg_max({m}, month_start) FILTER ({m} IS NOT NULL)')} AS {m}" for m in MACRO)
    return f"""SELECT quarter_period, {values}, count(*) AS months, CAST(last_day(max(date_trunc('quarter', month_start)) + INTERVAL 2 MONTH) AS DATE) AS date,
CAST(row_number() OVER (ORDER BY quarter_period) AS INTEGER) AS quarter_idx FROM monthly GROUP BY quarter_period"""


def _macro(spark: SparkSession, d: str, how: str) -> DataFrame:
    out = macro.quarterly(source.macro_monthly(spark, d), list(MACRO), how)
    return out.withColumns({m: rounded(F.col(m)) for m in MACRO})


@query(f"WITH {MONTHLY_SQL} {_quarterly_sql(False)}")
def macro_quarter_end(spark: SparkSession, d: str) -> DataFrame:
    return _macro(spark, d, "quarter_end")


@query(f"WITH {MONTHLY_SQL} {_quarterly_sql(True)}")
def macro_quarter_mean(spark: SparkSession, d: str) -> DataFrame:
    return _macro(spark, d, "quarter_mean")


@query(f"WITH {MONTHLY_SQL}, e AS ({_quarterly_sql(False)}) SELECT quarter_idx, quarter_period, date, {', '.join(MACRO)} FROM e")
def macro_source(spark: SparkSession, d: str) -> DataFrame:
    """Key, period, date and series of a macro table that has other columns and no number of its quarters."""
    return macro.projected(_macro(spark, d, "quarter_end").drop("quarter_idx"), list(MACRO))


_DUAL = f"WITH {MONTHLY_SQL}, e AS ({_quarterly_sql(False)}), m AS ({_quarterly_sql(True)})"


@query(f"""{_DUAL} SELECT coalesce(a.quarter_period, b.quarter_period) AS quarter_period, a.avg_price AS quarterly_avg_price, a.date AS quarterly_date, b.avg_price AS monthly_agg_avg_price, b.ordgr AS monthly_agg_ordgr, b.date AS monthly_agg_date
FROM (SELECT * FROM e WHERE quarter_idx <= 20) a FULL JOIN (SELECT * FROM m WHERE quarter_idx > 3) b ON a.quarter_period = b.quarter_period""")
def macro_dual_track(spark: SparkSession, d: str) -> DataFrame:
    native = _macro(spark, d, "quarter_end").where("quarter_idx <= 20").select("quarter_period", "avg_price", "date")
    return macro.aligned(native, _macro(spark, d, "quarter_mean").where("quarter_idx > 3").select("quarter_period", "avg_price", "ordgr", "date"), "dual_track")


@query(f"{_DUAL} SELECT a.quarter_period, a.avg_price, b.ordgr, b.fshare FROM e a LEFT JOIN (SELECT * FROM m WHERE quarter_idx > 3) b USING (quarter_period)")
def macro_prefer_quarterly(spark: SparkSession, d: str) -> DataFrame:
    native = _macro(spark, d, "quarter_end").select("quarter_period", "avg_price")
    return macro.aligned(native, _macro(spark, d, "quarter_mean").where("quarter_idx > 3").select("quarter_period", "ordgr", "fshare"), "prefer_quarterly")


@query(f"{_DUAL} SELECT q.quarter_idx, quarter_period, quarter_period IS NOT NULL AS covered FROM (SELECT CAST(i AS INTEGER) AS quarter_idx FROM range(1, 31) t(i)) q LEFT JOIN e ON e.quarter_idx = q.quarter_idx")
def macro_mapping(spark: SparkSession, d: str) -> DataFrame:
    return macro.mapping(spark.range(1, 31).select(F.col("id").cast("int").alias("quarter_idx")), _macro(spark, d, "quarter_end"))


@query(f"{_DUAL} SELECT CAST(i AS INTEGER) AS quarter_idx FROM range(1, 31) t(i) WHERE i NOT IN (SELECT quarter_idx FROM e)")
def quarter_coverage_anti(spark: SparkSession, d: str) -> DataFrame:
    return audit.uncovered_quarters(spark.range(1, 31).select(F.col("id").cast("int").alias("quarter_idx")), _macro(spark, d, "quarter_end"))


@query(f"{_DUAL}, {PANEL_SQL} SELECT entity_id, quarter_idx, f_disc, avg_price, ordgr FROM panel JOIN e USING (quarter_idx)")
def macro_join(spark: SparkSession, d: str) -> DataFrame:
    return macro.with_macro(source.panel(spark, d), _macro(spark, d, "quarter_end"), list(MACRO)).select("entity_id", "quarter_idx", "f_disc", "avg_price", "ordgr")


#: The sheet of definitions: acronym, variable, definition, frequency.
DEFINED = (("avg_price", "price", "mean order total", "quarterly"), (" fshare ", "share of closed orders", " ", "monthly"), ("ordgr", "growth", "growth of orders", "quarterly"), ("svar", "variance", "variance", "monthly"), ("pch", "change", "change of the mean order total", "quarterly"), (" ", "notes", "see the annex", None))
_CATALOGUE = f"""{_DUAL}, n AS (SELECT *, avg_price - lag(avg_price) OVER (ORDER BY quarter_period) AS pch FROM e),
cm AS ({" UNION ALL ".join(f"SELECT '{m}' AS series, count({m}) AS n FROM monthly" for m in MACRO)}), cq AS ({" UNION ALL ".join(f"SELECT '{m}' AS series, count({m}) AS n FROM n" for m in ("avg_price", "ordgr", "pch"))}),
df AS (SELECT * FROM (VALUES ('avg_price', 'mean order total'), ('fshare', 'share of closed orders'), ('ordgr', 'growth of orders'), ('svar', 'variance'), ('pch', 'change of the mean order total')) t(series, definition)),
cat0 AS (SELECT series, definition, coalesce(cm.n, 0) AS n_monthly, coalesce(cq.n, 0) AS n_quarterly FROM cm FULL JOIN cq USING (series) FULL JOIN df USING (series)),
cat AS (SELECT *, n_monthly > 0 AS in_monthly, n_quarterly > 0 AS in_quarterly, CASE WHEN n_monthly = 0 AND n_quarterly = 0 THEN 'defined_no_data' WHEN definition IS NULL THEN 'data_no_definition'
WHEN n_quarterly = 0 THEN 'monthly_only' WHEN n_monthly = 0 THEN 'quarterly_only' ELSE 'ok' END AS status FROM cat0)"""


@query(f"{_CATALOGUE} SELECT * FROM cat")
def macro_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Series of the monthly table and of a quarterly one (with the change of a price, without the other two), against the definitions."""
    native = _macro(spark, d, "quarter_end").select("quarter_period", "avg_price", "ordgr")
    native = native.withColumn("pch", F.col("avg_price") - F.lag("avg_price").over(Window.orderBy("quarter_period")))  # a row per quarter
    defined = macro.definitions(spark.createDataFrame(list(DEFINED), "acronym string, variable string, definition string, frequency string"))
    return macro.catalogue(source.macro_monthly(spark, d), native, list(MACRO), ["avg_price", "ordgr", "pch"], defined)


@query(f"""{_CATALOGUE} SELECT series, status AS conflict, 'monthly=' || n_monthly || '; quarterly=' || n_quarterly AS detail FROM cat WHERE status <> 'ok'
UNION ALL SELECT '*', 'series_count', 'present=' || count(*) || '; documented=12' FROM cat WHERE in_monthly OR in_quarterly HAVING count(*) <> 12""")
def macro_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return macro.conflicts(macro_catalogue(spark, d), 12)


@query(f"""{_CATALOGUE} SELECT series, CASE WHEN in_quarterly THEN 'use_quarterly' ELSE 'aggregate_monthly' END AS resolution FROM cat WHERE in_monthly OR in_quarterly
UNION ALL SELECT 'missing_' || i, 'documented_missing' FROM range(1, 13) t(i) WHERE i <= 12 - (SELECT count(*) FROM cat WHERE in_monthly OR in_quarterly)""")
def macro_resolution(spark: SparkSession, d: str) -> DataFrame:
    return audit.macro_resolution(macro_catalogue(spark, d), 12)


_K1 = """, t AS (SELECT * FROM panel WHERE quarter_idx BETWEEN 1 AND 21)""" + "".join(
    f""", a_{c} AS (SELECT coalesce(median({c}), 0) AS med FROM t), b_{c} AS (SELECT med, quantile_cont(coalesce({c}, med), 0.01) AS lo, quantile_cont(coalesce({c}, med), 0.99) AS hi FROM t, a_{c} GROUP BY med),
p_{c} AS (SELECT med, lo, hi, avg(least(greatest(coalesce({c}, med), lo), hi)) AS mu, stddev_pop(least(greatest(coalesce({c}, med), lo), hi)) AS sd FROM t, b_{c} GROUP BY ALL)"""
    for c in PROFILED
)


@query(f"WITH {PANEL_SQL}{_K1} " + " UNION ALL ".join(f"SELECT '{c}' AS source_column, {r6('med')} AS median_train, {r6('lo')} AS winsor_p01_train, {r6('hi')} AS winsor_p99_train, {r6('mu')} AS mean_train, {r6('CASE WHEN sd < 1e-12 THEN 1 ELSE sd END')} AS std_train FROM p_{c}" for c in PROFILED))
def train_standardize_params(spark: SparkSession, d: str) -> DataFrame:
    return preprocess.params_table(preprocess.train_params(source.panel(spark, d), list(PROFILED)), list(PROFILED))


@query(f"WITH {PANEL_SQL}{_K1} SELECT entity_id, quarter_idx, " + ", ".join(f"{r6(f'(least(greatest(coalesce({c}, p_{c}.med), p_{c}.lo), p_{c}.hi) - p_{c}.mu) / CASE WHEN p_{c}.sd < 1e-12 THEN 1 ELSE p_{c}.sd END')} AS z_{c}" for c in PROFILED) + " FROM panel, " + ", ".join(f"p_{c}" for c in PROFILED))
def train_standardize_values(spark: SparkSession, d: str) -> DataFrame:
    rows = source.panel(spark, d)
    out = preprocess.standardized(rows, preprocess.train_params(rows, list(PROFILED)), list(PROFILED))
    return out.select("entity_id", "quarter_idx", *(rounded(F.col(f"z_{c}")).alias(f"z_{c}") for c in PROFILED))


_FITS = """, q AS (SELECT quarter_idx, median(f_miss) AS m, quantile_cont(f_miss, 0.01) AS lo, quantile_cont(f_miss, 0.99) AS hi FROM panel WHERE quarter_idx BETWEEN 1 AND 21 GROUP BY 1),
g AS (SELECT median(f_miss) AS m, quantile_cont(f_miss, 0.01) AS lo, quantile_cont(f_miss, 0.99) AS hi FROM panel WHERE quarter_idx BETWEEN 1 AND 21),
w AS (SELECT p.entity_id, p.quarter_idx, coalesce(f_miss, q.m, g.m, 0) AS v, coalesce(q.lo, g.lo) AS lo, coalesce(q.hi, g.hi) AS hi FROM panel p LEFT JOIN q USING (quarter_idx), g)"""


@query(f"WITH {PANEL_SQL}{_FITS} SELECT entity_id, quarter_idx, {r6('v')} AS f_miss FROM w")
def impute_by_quarter(spark: SparkSession, d: str) -> DataFrame:
    return preprocess.imputed(source.panel(spark, d), ["f_miss"]).select("entity_id", "quarter_idx", rounded(F.col("f_miss")).alias("f_miss"))


@query(f"WITH {PANEL_SQL}{_FITS} SELECT entity_id, quarter_idx, round(least(greatest(v, lo), hi), 9) + 0.0 AS f_miss FROM w")
def winsorize_by_quarter(spark: SparkSession, d: str) -> DataFrame:
    return preprocess.winsorised(source.panel(spark, d), ["f_miss"])[0].select("entity_id", "quarter_idx", rounded(F.col("f_miss"), 9).alias("f_miss"))


@query(f"""WITH {PANEL_SQL}{_FITS} SELECT 'f_miss' AS "column", quarter_idx, count(*) FILTER (v < lo) AS below_low_count, count(*) FILTER (v > hi) AS above_high_count, round(max(lo), 9) + 0.0 AS low, round(max(hi), 9) + 0.0 AS high
FROM w GROUP BY quarter_idx HAVING count(*) FILTER (v < lo OR v > hi) > 0""")
def winsor_log(spark: SparkSession, d: str) -> DataFrame:
    return preprocess.winsorised(source.panel(spark, d), ["f_miss"])[1]


@query(f"WITH {PANEL_SQL} SELECT entity_id, quarter_idx, {r6('sign(f_acct) * ln(1 + abs(f_acct))')} AS f_acct, {r6('ln(1 + f_qty)')} AS f_qty FROM panel")
def signed_log_transform(spark: SparkSession, d: str) -> DataFrame:
    out = preprocess.transformed(source.panel(spark, d), ["f_acct", "f_qty"])
    return out.select("entity_id", "quarter_idx", rounded(F.col("f_acct")).alias("f_acct"), rounded(F.col("f_qty")).alias("f_qty"))


_SCALED = {
    "standard": ("avg({c})", "stddev_pop({c})"),
    "robust": ("median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
    "minmax": ("min({c})", "max({c}) - min({c})"),
}


def _scale_sql(how: str) -> str:
    centre, scale = _SCALED[how]
    fits = ", ".join(f"{centre.format(c=c)} AS {c}_c, {scale.format(c=c)} AS {c}_w" for c in PROFILED)
    out = ", ".join(f"{r6(f'({c} - {c}_c) / CASE WHEN {c}_w = 0 THEN 1 ELSE {c}_w END')} AS {c}" for c in PROFILED)
    return f"WITH {PANEL_SQL}, s AS (SELECT {fits} FROM panel WHERE quarter_idx BETWEEN 1 AND 21) SELECT entity_id, quarter_idx, {out} FROM panel, s"


# Yeo-Johnson by the same search over powers, in passes
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS f, {c} AS x FROM panel WHERE quarter_idx BETWEEN 1 AND 21 AND {c} IS NOT NULL" for c in PROFILED) + ")"


def _power_sql(x: str, p: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN CASE WHEN {p} = 0 THEN ln(1 + {x}) ELSE (pow(1 + {x}, {p}) - 1) / {p} END WHEN {x} < 0 THEN -CASE WHEN {p} = 2 THEN ln(1 - {x}) ELSE (pow(1 - {x}, 2 - {p}) - 1) / (2 - {p}) END END"


def _powers_sql() -> str:
    parts, step, before = [], scalers.STEP, "SELECT f, CAST(0 AS DOUBLE) AS p FROM (SELECT DISTINCT f FROM long)"
    k = 0
    while step >= scalers.FINEST:
        parts.append(f"""t{k} AS MATERIALIZED (SELECT f, p + i * {step!r} AS p FROM ({before}), range(-{scalers.REACH}, {scalers.REACH} + 1) r(i)),
l{k} AS MATERIALIZED (SELECT f, p, CASE WHEN sqrt(v) > {scalers.NOISE!r} * abs(m) THEN -n / 2.0 * ln(v) + (p - 1) * s END AS fit FROM (SELECT f, p, count(*) AS n, avg(y) AS m, var_pop(y) AS v, sum(s) AS s FROM (SELECT f, p, {_power_sql("x", "p")} AS y, sign(x) * ln(1 + abs(x)) AS s FROM long JOIN t{k} USING (f)) GROUP BY ALL))""")
        before, last = f"SELECT f, arg_max(p, fit) AS p FROM l{k} GROUP BY 1", step
        step, k = step / scalers.REACH, k + 1
    parts.append(f"""w AS (SELECT f, p, fit, lag(fit) OVER o AS a, lead(fit) OVER o AS b, row_number() OVER (PARTITION BY f ORDER BY fit DESC) AS place FROM l{k - 1} WINDOW o AS (PARTITION BY f ORDER BY p)),
powers AS (SELECT f, p + {last!r} * (a - b) / (2 * (a - 2 * fit + b)) AS p FROM w WHERE place = 1)""")
    return ", ".join(parts)


def _power_scale_sql() -> str:
    one = "SELECT " + ", ".join(f"max(p) FILTER (f = '{c}') AS {c}_p" for c in PROFILED) + " FROM powers"
    fits = ", ".join(f"avg({_power_sql(c, f'{c}_p')}) AS {c}_c, stddev_pop({_power_sql(c, f'{c}_p')}) AS {c}_w" for c in PROFILED)
    out = ", ".join(f"{r6(f'(({_power_sql(c, f'{c}_p')}) - {c}_c) / {c}_w')} AS {c}" for c in PROFILED)
    return f"WITH {PANEL_SQL}, {_LONG}, {_powers_sql()}, p1 AS ({one}), s AS (SELECT {fits} FROM panel, p1 WHERE quarter_idx BETWEEN 1 AND 21) SELECT entity_id, quarter_idx, {out} FROM panel, p1, s"


def _horner(row: tuple, r: str) -> str:
    out = repr(row[0])
    for c in row[1:]:
        out = f"({out} * {r} + {c!r})"
    return out


def _quantile_scale_sql() -> str:
    """Landmarks from each column's sorted list; a value's places among them by counting."""
    ratio = {n: f"{_horner(getattr(scalers, n)[0], 'r')} / {_horner(getattr(scalers, n)[1], 'r')}" for n in ("CENTRAL", "MIDDLE", "FAR")}
    edge = scalers.EDGE
    return f"""WITH {PANEL_SQL}, {_LONG}, size AS (SELECT count(*) AS rows, least(greatest({scalers.LEAST_LANDMARKS}, least({scalers.MOST_LANDMARKS}, count(*))), count(*)) AS n FROM panel WHERE quarter_idx BETWEEN 1 AND 21),
lists AS (SELECT f, list(x ORDER BY x) AS s, count(*) AS m FROM long GROUP BY 1),
spots AS (SELECT f, s, i, (i / (n - 1)::DOUBLE) * (m - 1) AS pos FROM lists, size, range(0, {scalers.MOST_LANDMARKS}) r(i) WHERE i < n),
edges AS (SELECT f, i, pos, s[CAST(floor(pos) AS BIGINT) + 1] AS a, s[CAST(ceil(pos) AS BIGINT) + 1] AS b FROM spots),
marks AS MATERIALIZED (SELECT f, i, CASE WHEN a = b THEN a ELSE (ceil(pos) - pos) * a + (pos - floor(pos)) * b END AS q FROM edges),
ends AS (SELECT f, min(q) AS q0, max(q) AS q1 FROM marks GROUP BY 1),
given AS ({" UNION ALL ".join(f"SELECT '{c}' AS f, entity_id, quarter_idx, {c} AS x FROM panel" for c in PROFILED)}),
vals AS (SELECT DISTINCT f, x FROM given WHERE x IS NOT NULL),
upto AS (SELECT v.f, v.x, m.i + 1 AS upto, m.q AS low FROM vals v ASOF JOIN (SELECT f, q, max(i) AS i FROM marks GROUP BY 1, 2) m ON v.f = m.f AND v.x >= m.q),
below AS (SELECT v.f, v.x, m.i AS below, m.q AS high FROM vals v ASOF JOIN (SELECT f, q, min(i) AS i FROM marks GROUP BY 1, 2) m ON v.f = m.f AND v.x <= m.q),
shares AS (SELECT f, x, CASE WHEN x - {edge!r} < q0 THEN 0.0 WHEN x + {edge!r} > q1 THEN 1.0 WHEN low = high THEN (below + upto - 1) / 2.0 / (n - 1) ELSE (upto - 1 + (x - low) / (high - low)) / (n - 1) END AS share FROM vals JOIN ends USING (f) LEFT JOIN upto USING (f, x) LEFT JOIN below USING (f, x), size),
clipped AS (SELECT f, x, least(greatest(share, {edge!r}), {1 - edge!r}) AS p FROM shares),
scores AS (SELECT f, x, CASE WHEN abs(p - 0.5) <= 0.425 THEN (p - 0.5) * (SELECT {ratio["CENTRAL"]} FROM (SELECT 0.180625 - (p - 0.5) * (p - 0.5) AS r))
ELSE sign(p - 0.5) * CASE WHEN sqrt(-ln(least(p, 1 - p))) <= 5 THEN (SELECT {ratio["MIDDLE"]} FROM (SELECT sqrt(-ln(least(p, 1 - p))) - 1.6 AS r)) ELSE (SELECT {ratio["FAR"]} FROM (SELECT sqrt(-ln(least(p, 1 - p))) - 5 AS r)) END END AS z FROM clipped)
SELECT entity_id, quarter_idx, {", ".join(f"{r6(f'max(z) FILTER (f = {chr(39)}{c}{chr(39)})')} AS {c}" for c in PROFILED)} FROM given LEFT JOIN scores USING (f, x) GROUP BY 1, 2"""


def _scale(how: str, sql: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return preprocess.rescaled(source.panel(spark, d).select("entity_id", "quarter_idx", *PROFILED), list(PROFILED), how).select("entity_id", "quarter_idx", *(rounded(F.col(c)).alias(c) for c in PROFILED))

    run.__name__ = f"{how}_scale"
    query(sql)(run)


for _how in _SCALED:
    _scale(_how, _scale_sql(_how))
_scale("power", _power_scale_sql())
_scale("quantile_normal", _quantile_scale_sql())


@query(f"""WITH {PANEL_SQL}{_FITS}, a AS (SELECT f_miss AS x FROM panel), b AS (SELECT least(greatest(v, lo), hi) AS x FROM w)
SELECT 'f_miss' AS "column", """ + ", ".join(f"(SELECT {r6(e)} FROM {t}) AS {m}_{n}" for t, n in (("a", "before"), ("b", "after")) for m, e in (("missing_rate", "avg(CASE WHEN x IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"), ("q01", "quantile_cont(x, 0.01)"), ("q99", "quantile_cont(x, 0.99)"), ("mean", "avg(x)"), ("std", "stddev_samp(x)"), ("skew", "skewness(x)"), ("kurtosis", "kurtosis(x)"))))
def profile_before_after(spark: SparkSession, d: str) -> DataFrame:
    rows = source.panel(spark, d)
    return profile.before_after(rows, preprocess.winsorised(rows, ["f_miss"])[0], ["f_miss"])


_SHAPE = f"""SELECT '$c' AS "column", coalesce(abs(skewness($c)), 0) AS sk, coalesce(kurtosis($c), 0) AS ku, avg(CASE WHEN $c IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS mi,
coalesce(avg(CASE WHEN $c < 0 THEN CAST(1 AS DOUBLE) WHEN $c IS NOT NULL THEN CAST(0 AS DOUBLE) END), 0) AS ne, coalesce(avg(CASE WHEN $c = 0 THEN CAST(1 AS DOUBLE) WHEN $c IS NOT NULL THEN CAST(0 AS DOUBLE) END), 0) AS ze FROM panel WHERE quarter_idx BETWEEN 1 AND 21"""


_CHOSEN = """CASE WHEN sk > 5 OR ku > 20 THEN 'QuantileTransformer(candidate) / RobustScaler(baseline)' WHEN sk > 2 OR ku > 10 THEN 'RobustScaler' ELSE 'StandardScaler' END AS scaling_strategy,
CASE WHEN ze > 0.25 AND ne = 0 AND sk > 2 THEN 'log1p' WHEN sk > 5 OR ku > 20 THEN 'signed_log1p' WHEN sk > 2 OR ku > 10 THEN CASE WHEN ne > 0 THEN 'signed_log1p' ELSE 'log1p' END ELSE 'none' END AS transform_strategy,
concat_ws(';', CASE WHEN mi > 0.4 THEN 'missing_too_high' END, CASE WHEN sk > 5 THEN 'extreme_skew' WHEN sk > 2 THEN 'high_skew' END, CASE WHEN ku > 20 THEN 'heavy_tail' END) AS risk_flags"""


@query(f"""WITH {PANEL_SQL}, s AS ({union(_SHAPE, PROFILED)})
SELECT "column", 'factor' AS role, 'transform_as_factor' AS feature_action,
{_CHOSEN} FROM s""")
def strategy_table(spark: SparkSession, d: str) -> DataFrame:
    return preprocess.strategies(profile.shapes(source.panel(spark, d).where("quarter_idx BETWEEN 1 AND 21"), list(PROFILED)))


@query(f"WITH {PANEL_SQL} SELECT count(*) AS outside_train, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT DISTINCT quarter_idx FROM panel WHERE quarter_idx <= 21) WHERE quarter_idx > 18")
def fit_scope(spark: SparkSession, d: str) -> DataFrame:
    """Parameters fitted on quarters 1 to 21, against the first .7 of 27 quarters (1 to 18)."""
    rows = source.panel(spark, d)
    return preprocess.fit_scope(rows.where("quarter_idx <= 21"), preprocess.train_quarters(rows, 0.7))


@query(f"WITH {PANEL_SQL} SELECT split, min(quarter_idx) AS start_quarter, max(quarter_idx) AS end_quarter, count(*) AS row_count, count(DISTINCT entity_id) AS unique_entities FROM panel GROUP BY 1")
def split_manifest(spark: SparkSession, d: str) -> DataFrame:
    return audit.split_manifest(source.panel(spark, d))


@query("SELECT CAST(i AS INTEGER) AS quarter_idx, CASE WHEN i <= 18 THEN 'train' WHEN i <= 22 THEN 'valid' ELSE 'test' END AS split FROM range(1, 28) t(i)")
def ratio_split(spark: SparkSession, d: str) -> DataFrame:
    return audit.ratio_split(source.panel(spark, d), 0.70, 0.15)


@query("SELECT TRUE AS order_ok, TRUE AS rows_ok, TRUE AS tail_ok")
def split_assertions(spark: SparkSession, d: str) -> DataFrame:
    rows = source.panel(spark, d)
    return audit.split_assertions(audit.split_manifest(rows), rows, 27)


@query("""WITH c AS (SELECT CAST(date_diff('minute', TIMESTAMP '2024-01-01', date_trunc('minute', ts)) // 15 AS VARCHAR) || '季' AS sheet_name, event_type AS "column", min(ts) AS place FROM events GROUP BY 1, 2),
h AS (SELECT sheet_name, list("column" ORDER BY place, "column") AS columns FROM c GROUP BY 1), b AS (SELECT columns AS baseline FROM h ORDER BY sheet_name LIMIT 1)
SELECT sheet_name, array_to_string(list_filter(baseline, lambda x: NOT list_contains(columns, x)), ';') AS missing_columns, array_to_string(list_filter(columns, lambda x: NOT list_contains(baseline, x)), ';') AS extra_columns,
list_sort(columns) = list_sort(baseline) AND columns <> baseline AS order_drift FROM h, b""")
def schema_drift(spark: SparkSession, d: str) -> DataFrame:
    """A sheet for every quarter of an hour of events, headed by the kinds of event in the order in which they come first."""
    sheet = F.concat(F.floor((F.unix_seconds("ts") - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))) / 900).cast("string"), F.lit("季"))
    cells = source.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type").select(sheet.alias("sheet_name"), F.col("event_type").alias("column"), F.col("ts").alias("place"))
    return schema.drift(schema.headed(cells))


#: Columns of the panel in its order, with the names and roles that they get.
_SAFE = (("entity_id", "security_code", "id"), ("quarter_idx", "quarter_idx", "meta"), ("revenue", "factor_001", "factor"), *((f, f"factor_{k:03d}", "factor") for k, f in enumerate(FACTORS[:8], 2)), ("ret_3m", "factor_010", "factor"),
         ("future_return_1q", "label", "label"), ("entity_name", "security_name", "meta"), ("f_acct", "factor_011", "factor"), ("f_growth", "factor_012", "factor"), ("f_miss", "factor_013", "factor"), ("split", "factor_014", "factor"))


@query(f"WITH {PANEL_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS original_column, '{s}' AS safe_column, '{r}' AS role, count({n}) AS n_values FROM panel" for n, s, r in _SAFE))
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    """The columns of the panel with safe name, role and the values that they hold."""
    rows = source.panel(spark, d)
    names = schema.normalized_names(rows.columns)
    roles = {n: schema.role(n, "entity_id", "entity_name", "future_return_1q") for n in names}
    safe = schema.safe_names(names, {"entity_id": "security_code", "entity_name": "security_name", "quarter_idx": "quarter_idx", "future_return_1q": "label"}, roles)
    named = spark.createDataFrame([(n, safe[n], roles[n]) for n in names], "original_column string, safe_column string, role string")
    return named.join(profile.filled(rows, names).withColumnRenamed("column", "original_column"), "original_column")


@query(f"WITH {PANEL_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS column_name, {str(r == 'included').upper()} AS included, '{r}' AS reason, count({n}) AS n_values FROM panel" for n, r in [("entity_id", "meta_or_return"), ("quarter_idx", "meta_or_return"), ("revenue", "included"), *((f, "included") for f in FACTORS[:8]), ("ret_3m", "return_like"), ("future_return_1q", "meta_or_return"), ("entity_name", "non_numeric"), ("f_acct", "included"), ("f_growth", "included"), ("f_miss", "included"), ("split", "meta_or_return")]))
def factor_eligibility(spark: SparkSession, d: str) -> DataFrame:
    rows = source.panel(spark, d)
    found = schema.eligibility(rows, {"entity_id", "quarter_idx", "split", "future_return_1q"}, set(MACRO))
    return spark.createDataFrame(found, "column_name string, included boolean, reason string").join(profile.filled(rows, rows.columns).withColumnRenamed("column", "column_name"), "column_name")


@query("SELECT s_suppkey, CASE WHEN length(CAST(s_suppkey AS VARCHAR)) < 6 THEN lpad(CAST(s_suppkey AS VARCHAR), 6, '0') ELSE CAST(s_suppkey AS VARCHAR) END AS plain, CAST(s_suppkey AS VARCHAR) || '.SZ' AS suffixed_raw, CASE WHEN length(CAST(s_suppkey AS VARCHAR) || '.SZ') < 6 THEN lpad(CAST(s_suppkey AS VARCHAR) || '.SZ', 6, '0') ELSE CAST(s_suppkey AS VARCHAR) || '.SZ' END AS suffixed FROM supplier")
def normalize_id(spark: SparkSession, d: str) -> DataFrame:
    rows = source.table(spark, d, "supplier").select("s_suppkey")
    suffixed = F.concat(F.col("s_suppkey").cast("string"), F.lit(".SZ"))
    return rows.select("s_suppkey", schema.padded_id(F.concat(F.col("s_suppkey").cast("string"), F.lit(".0"))).alias("plain"), suffixed.alias("suffixed_raw"), schema.padded_id(suffixed).alias("suffixed"))


@query("SELECT p_partkey, trim(regexp_replace(p_name || ' (x, %)', '[^\\p{L}\\p{N}]+', '_', 'g'), '_') AS safe_name FROM part")
def safe_feature_names(spark: SparkSession, d: str) -> DataFrame:
    return source.table(spark, d, "part").select("p_partkey", schema.safe_feature_name(F.concat("p_name", F.lit(" (x, %)"))).alias("safe_name"))


@query("""SELECT 'o_orderpriority' AS "column", count(*) AS non_missing, count(*) AS failed, CAST(0 AS BIGINT) AS success, CAST(0 AS DOUBLE) AS ratio, (SELECT string_agg(x, ';' ORDER BY x) FROM (SELECT DISTINCT o_orderpriority AS x FROM orders ORDER BY 1 LIMIT 5)) AS examples, 'string' AS action FROM orders
UNION ALL SELECT 'o_custkey', count(*), 0, count(*), 1, '', 'numeric' FROM orders""")
def conversion_log(spark: SparkSession, d: str) -> DataFrame:
    return schema.conversion_log(source.table(spark, d, "orders"), ["o_orderpriority", "o_custkey"])


@query("SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 3 = 2")
def yyyymm_parse(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.date_format("o_orderdate", "yyyyMM")
    text = F.when(F.col("o_orderkey") % 3 == 0, stamp).when(F.col("o_orderkey") % 3 == 1, F.concat(stamp, F.lit(".0"))).otherwise(F.concat(F.lit("x"), stamp))
    return source.table(spark, d, "orders").select("o_orderkey", macro.parse_yyyymm(text).alias("month_start"))


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS keyword, substr(replace(text, ' ', ''), greatest(instr(replace(text, ' ', ''), '{k}') - 40, 1), instr(replace(text, ' ', ''), '{k}') - greatest(instr(replace(text, ' ', ''), '{k}') - 40, 1) + {len(k)} + 40) AS snippet FROM documents WHERE instr(replace(text, ' ', ''), '{k}') > 0" for k in KEYWORDS))
def keyword_snippets(spark: SparkSession, d: str) -> DataFrame:
    docs = source.table(spark, d, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", F.inline(F.array(*(F.struct(F.lit(k).alias("keyword"), files.keyword_snippet(F.col("text"), k).alias("snippet")) for k in KEYWORDS))))
    return rows.where("snippet IS NOT NULL")


@query()
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    return files.inventory(spark, d)


_META = ("revenue",)
_FEATURES = f"""WITH {PANEL_SQL}, s AS ({union(_SHAPE, (*PROFILED, "ret_3m", *_META))}), st AS (
SELECT "column", CASE WHEN "column" IN ({", ".join(f"'{m}'" for m in _META)}) THEN 'meta' ELSE 'factor' END AS role, {_CHOSEN} FROM s), ft AS (
SELECT "column", role, CASE role WHEN 'meta' THEN 'preserve_unmodified' ELSE 'transform_as_factor' END AS feature_action, CASE role WHEN 'meta' THEN 'none' ELSE scaling_strategy END AS scaling_strategy,
CASE role WHEN 'meta' THEN 'none' ELSE transform_strategy END AS transform_strategy, CASE role WHEN 'meta' THEN '' ELSE risk_flags END AS risk_flags, role <> 'meta' AND "column" NOT IN ('f_miss', 'ret_3m') AS included_in_X,
"column" = 'ret_3m' AS is_return_like, "column" = 'f_miss' AS is_prohibited,
CASE "column" WHEN 'f_miss' THEN 'prohibited_or_leakage_guard' WHEN 'ret_3m' THEN 'return_like_excluded' ELSE CASE role WHEN 'meta' THEN 'feature_action=preserve_unmodified' ELSE '' END END AS exclusion_reason FROM st)"""


@query(f"{_FEATURES} SELECT * FROM ft")
def final_feature_list(spark: SparkSession, d: str) -> DataFrame:
    """The strategies of the training quarters' factors, a return and a column that is only carried along, with f_miss prohibited."""
    measured = profile.shapes(source.panel(spark, d).where("quarter_idx BETWEEN 1 AND 21"), [*PROFILED, "ret_3m", *_META])
    return audit.final_features(preprocess.strategies(measured, dict.fromkeys(_META, "meta")), ["f_miss"])


@query(f"""{_FEATURES} SELECT count_if(included_in_X) AS x_columns, count_if(included_in_X AND is_prohibited) AS prohibited_in_x, count_if(included_in_X AND is_return_like) AS return_like_in_x,
CASE WHEN count_if(included_in_X AND (is_prohibited OR is_return_like)) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ft""")
def leakage_assertion(spark: SparkSession, d: str) -> DataFrame:
    return audit.leakage_report(final_feature_list(spark, d))


@query(f"""WITH {PANEL_SQL}, m AS (SELECT avg(CASE WHEN f_miss IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS x FROM panel), k AS (SELECT count(*) - count(DISTINCT (entity_id, quarter_idx)) AS x FROM panel), g AS (SELECT avg(CASE WHEN abs(f_growth) > 100 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS x FROM panel)
SELECT 'label must be proved' AS issue, 'label_leakage_risk' AS category, 'high' AS severity, 'P0' AS priority, 'label_shift_match_rate > 0.99' AS assertion, 'non_null_rate=' || CAST(round(avg(CASE WHEN future_return_1q IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END), 4) AS VARCHAR) AS evidence FROM panel
UNION ALL SELECT 'values are missing', 'missing_values', 'medium', 'P1', 'missing_rate <= 0.01', 'f_miss=' || CAST(round(x, 4) AS VARCHAR) FROM m WHERE x > 0.01
UNION ALL SELECT 'keys repeat', 'duplicate_key', 'critical', 'P0', 'duplicates == 0', 'duplicates=' || CAST(x AS VARCHAR) FROM k WHERE x > 0
UNION ALL SELECT 'growth is extreme', 'growth_anomaly', 'medium', 'P1', 'rate <= 0.001', 'rate=' || CAST(round(x, 4) AS VARCHAR) FROM g WHERE x > 0.001""")
def problem_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = source.panel(spark, d)
    share = lambda c: rows.agg(F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias("x"))
    text = F.round("x", 4).cast("string")
    keys = rows.agg((F.count(F.lit(1)) - F.countDistinct("entity_id", "quarter_idx")).alias("x"))
    return audit.issues(spark, [
        (share(F.col("future_return_1q").isNotNull()), F.lit(True), ("label must be proved", "label_leakage_risk", "high", "P0", "label_shift_match_rate > 0.99"), F.concat(F.lit("non_null_rate="), text)),
        (share(F.col("f_miss").isNull()), F.col("x") > 0.01, ("values are missing", "missing_values", "medium", "P1", "missing_rate <= 0.01"), F.concat(F.lit("f_miss="), text)),
        (keys, F.col("x") > 0, ("keys repeat", "duplicate_key", "critical", "P0", "duplicates == 0"), F.concat(F.lit("duplicates="), F.col("x").cast("string"))),
        (share(F.abs("f_growth") > 100), F.col("x") > 0.001, ("growth is extreme", "growth_anomaly", "medium", "P1", "rate <= 0.001"), F.concat(F.lit("rate="), text)),
    ])


@query("""WITH l AS (SELECT CASE WHEN l_partkey = 1 THEN 2 ELSE l_partkey END AS k, l_quantity, l_returnflag FROM lineitem),
o AS (SELECT CAST(k AS VARCHAR) AS item, CAST(CAST(max(l_quantity) AS INTEGER) AS VARCHAR) AS value FROM l WHERE l_returnflag = 'R' AND l_quantity >= 48 GROUP BY 1),
s AS (SELECT CAST(k AS VARCHAR) AS item, CAST(CAST(min(l_quantity) AS INTEGER) AS VARCHAR) AS value FROM l WHERE l_quantity >= 44 GROUP BY 1),
f AS (SELECT CASE WHEN p_partkey = 1 THEN '2' ELSE CAST(p_partkey AS VARCHAR) END AS item, max(CAST(p_size AS VARCHAR)) AS value FROM part WHERE p_size > 5 GROUP BY 1)
SELECT item, coalesce(o.value, s.value, f.value) AS value, CASE WHEN o.value IS NOT NULL THEN 'override' WHEN s.value IS NOT NULL THEN 'seed' ELSE 'default' END AS source_type,
CASE WHEN f.value IS NULL THEN 'unknown_item' WHEN o.value IS NOT NULL THEN 'confirmed' ELSE 'assumed' END AS status FROM o FULL JOIN s USING (item) FULL JOIN f USING (item)""")
def assumption_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Assumed order size of each part: its largest returned order of 48 or more, else its smallest of 44 or more, else its listed size; part 1 is sold as part 2."""
    lines = source.table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("item"), F.col("l_quantity").cast("int").alias("n"), "l_returnflag")
    lines = lines.withColumn("item", F.when(F.col("item") == "1", "2").otherwise(F.col("item")))  # the same part, before its orders are compared
    overrides = lines.where("l_returnflag = 'R' AND n >= 48").groupBy("item").agg(F.max("n").cast("string").alias("value"))
    seeds = lines.where("n >= 44").groupBy("item").agg(F.min("n").cast("string").alias("value"))
    defaults = source.table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").cast("string").alias("item"), F.col("p_size").cast("string").alias("value"))
    return audit.ledger(overrides, seeds, defaults, {"1": "2"})


@query("SELECT * FROM (VALUES ('nations', CAST(25 AS BIGINT), CAST(25 AS BIGINT), 'PASS'), ('regions', 6, 5, 'FAIL'), ('sheets', 30, NULL, 'MISSING')) t(item, expected, found, status)")
def inventory_expectations(spark: SparkSession, d: str) -> DataFrame:
    count = lambda item, name: source.table(spark, d, name).agg(F.lit(item).alias("item"), F.count(F.lit(1)).alias("found"))
    expected = spark.createDataFrame([("nations", 25), ("regions", 6), ("sheets", 30)], "item string, expected long")
    return audit.expectations(count("nations", "nation").unionByName(count("regions", "region")), expected)
