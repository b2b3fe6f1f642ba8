"""Queries of the audits: label proof and decision, faults of raw macro sheets, basis points, fit windows, and the problem scanner's checks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck.functions.stats import rounded
from quarterdeck.operators import audit, labels, macro, portfolio, profile, schema
from quarterdeck.plans.panel_queries import _BESIDE, _HIT, PROFILED, r6
from quarterdeck.sources import panel as source
from quarterdeck.sources.panel import MACRO, MONTHLY_SQL, PANEL_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


_PROOF = f"""WITH {PANEL_SQL}{_BESIDE}, c AS (SELECT quarter_idx, count(*) AS left_rows, count(*) FILTER (n > 1) AS dup, count(*) FILTER (l IS NULL) AS missing FROM (SELECT quarter_idx, future_return_1q AS l, count(*) OVER (PARTITION BY quarter_idx, entity_id) AS n FROM panel) GROUP BY 1),
g AS (SELECT quarter_idx, count(*) AS joined_rows, count(label_value - next_value) AS valid_compare_rows, count(*) FILTER ({_HIT}) AS matched_rows, max(abs(label_value - next_value)) AS max_abs_error, avg(abs(label_value - next_value)) AS mean_abs_error, count(*) FILTER (label_value IS NULL) AS missing_label_rows, count(*) FILTER (next_value IS NULL) AS missing_next FROM beside GROUP BY 1),
r AS (SELECT c.quarter_idx, c.quarter_idx + 1 AS next_quarter_idx, c.left_rows, coalesce(n.left_rows, 0) AS right_rows, n.quarter_idx IS NULL AS tail, CASE WHEN n.quarter_idx IS NULL THEN 0 ELSE joined_rows END AS joined_rows, CASE WHEN n.quarter_idx IS NULL THEN 0 ELSE valid_compare_rows END AS valid_compare_rows, CASE WHEN n.quarter_idx IS NULL THEN 0 ELSE matched_rows END AS matched_rows,
CASE WHEN n.quarter_idx IS NOT NULL AND valid_compare_rows > 0 THEN matched_rows / valid_compare_rows END AS match_rate, CASE WHEN n.quarter_idx IS NOT NULL THEN {r6("max_abs_error")} END AS max_abs_error, CASE WHEN n.quarter_idx IS NOT NULL THEN {r6("mean_abs_error")} END AS mean_abs_error,
CASE WHEN n.quarter_idx IS NULL THEN c.missing ELSE missing_label_rows END AS missing_label_rows, CASE WHEN n.quarter_idx IS NULL THEN 0 ELSE missing_next END AS missing_next_return_rows, c.dup AS duplicate_left_ids, coalesce(n.dup, 0) AS duplicate_right_ids
FROM c LEFT JOIN c n ON n.quarter_idx = c.quarter_idx + 1 JOIN g ON g.quarter_idx = c.quarter_idx),
p AS (SELECT * EXCLUDE (tail), CASE WHEN tail THEN 'tail_without_t_plus_1' WHEN valid_compare_rows = 0 THEN 'no_valid_pairs' WHEN match_rate >= 0.99 THEN 'pass' ELSE 'fail' END AS assertion, CASE WHEN tail THEN 'no later quarter to compare with' ELSE '' END AS note FROM r)"""


def _proof(spark: SparkSession, d: str) -> DataFrame:
    out = labels.proof(source.panel(spark, d), "future_return_1q", "ret_3m")
    return out.withColumns({c: rounded(F.col(c)) for c in ("max_abs_error", "mean_abs_error")})


@query(f"{_PROOF} SELECT * FROM p")
def label_proof(spark: SparkSession, d: str) -> DataFrame:
    return _proof(spark, d)


@query(f"""{_PROOF} SELECT sum(matched_rows) / sum(valid_compare_rows) AS overall_match_rate, CAST(sum(valid_compare_rows) AS BIGINT) AS total_valid_compare_rows, CAST(sum(matched_rows) AS BIGINT) AS total_matched_rows, max(max_abs_error) AS global_max_abs_error,
count(match_rate) AS comparable_quarter_count, count(*) FILTER (assertion = 'pass') AS quarter_pass_count, max(quarter_idx) AS tail_quarter, sum(matched_rows) / sum(valid_compare_rows) >= 0.99 AS label_already_shifted FROM p""")
def label_decision(spark: SparkSession, d: str) -> DataFrame:
    return labels.decision(_proof(spark, d))


_SHEET_SQL = """WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN 'x' || strftime(o_orderdate, '%Y%m') WHEN o_orderkey % 7 = 2 THEN strftime(o_orderdate, '%Y%m') || '.0' ELSE strftime(o_orderdate, '%Y%m') END AS t,
CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE o_orderstatus END AS v, o_orderdate FROM orders)"""


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    """A raw sheet of an order a row: times that are blank or broken, and a column that holds no numbers."""
    stamp, key = F.date_format("o_orderdate", "yyyyMM"), F.col("o_orderkey")
    time = F.when(key % 7 == 0, F.lit(None)).when(key % 7 == 1, F.concat(F.lit("x"), stamp)).when(key % 7 == 2, F.concat(stamp, F.lit(".0"))).otherwise(stamp)
    return source.table(spark, d, "orders").select(key.alias("k"), time.alias("t"), F.when(key % 5 == 0, "n/a").otherwise(F.col("o_orderstatus")).alias("v"))


@query(f"""{_SHEET_SQL} SELECT 'orders' AS sheet_name, k AS row_index, '' AS raw_time, 'explanation_row_removed' AS issue, v AS row_preview FROM s WHERE t IS NULL
UNION ALL SELECT 'orders', k, t, 'time_parse_failed', t FROM s WHERE t LIKE 'x%' UNION ALL SELECT 'orders', k, t, 'numeric_conversion_failed', 'v=' || v FROM s WHERE t IS NOT NULL
UNION ALL SELECT 'orders', k, t, 'non_quarter_observation_in_quarter_sheet', 'month_period=' || strftime(o_orderdate, '%Y-%m') FROM s WHERE t NOT LIKE 'x%' AND month(o_orderdate) NOT IN (1, 4, 7, 10)""")
def macro_exceptions(spark: SparkSession, d: str) -> DataFrame:
    """Every fault of a sheet: remarks, times, values, months."""
    return macro.exceptions(_sheet(spark, d), "orders", "k", "t", ["v"], quarterly_sheet=True)


@query("""SELECT o_orderkey AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, o_totalprice AS v FROM orders WHERE month(o_orderdate) IN (1, 4, 7, 10)""")
def macro_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """A sheet that passes the gate on times and months."""
    rows = source.table(spark, d, "orders").where(F.month("o_orderdate").isin(*macro.QUARTER_MONTHS)).select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyyMM").alias("t"), F.col("o_totalprice").alias("v"))
    remark = rows.select("k", F.lit(None).cast("string").alias("t"), "v").where("k % 3 = 0")
    return macro.cleaned(rows.unionByName(remark), "orders", "k", "t", ["v"], quarterly_sheet=True)


@query("""SELECT item, value, CASE WHEN item NOT LIKE '%bps%' THEN 'not_in_bps' WHEN value = 'none' THEN 'error_not_a_number' WHEN CAST(value AS DOUBLE) > 0 AND CAST(value AS DOUBLE) < 1 THEN 'error_looks_like_a_fraction' ELSE 'ok' END AS status
FROM (SELECT (CASE WHEN p_partkey % 2 = 0 THEN 'cost_bps_' ELSE 'cost_' END) || p_partkey AS item, CASE WHEN p_partkey % 3 = 0 THEN 'none' WHEN p_partkey % 3 = 1 THEN '0.' || p_size ELSE CAST(p_size AS VARCHAR) END AS value FROM part)""")
def bps_check(spark: SparkSession, d: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    value = F.when(key % 3 == 0, "none").when(key % 3 == 1, F.concat(F.lit("0."), size)).otherwise(size)
    return audit.basis_points(source.table(spark, d, "part").select(F.concat(F.when(key % 2 == 0, "cost_bps_").otherwise("cost_"), key.cast("string")).alias("item"), value.alias("value")))


@query(f"""WITH {PANEL_SQL}, t AS (SELECT min(quarter_idx) AS first, max(quarter_idx) AS last FROM panel WHERE split = 'train'),
f AS (SELECT 'parameters' AS fit, 'f_miss' AS "column", min(quarter_idx) AS fit_start, max(quarter_idx) AS fit_end FROM panel WHERE f_miss IS NOT NULL AND quarter_idx <= 21 UNION ALL SELECT 'scaler', 'f_disc', min(quarter_idx), max(quarter_idx) FROM panel WHERE quarter_idx <= 21 UNION ALL SELECT 'scaler', 'f_unit', min(quarter_idx), max(quarter_idx) FROM panel)
SELECT f.*, CASE WHEN fit_start >= first AND fit_end <= last THEN 'PASS' ELSE 'FAIL' END AS status FROM f, t""")
def fit_window_audit(spark: SparkSession, d: str) -> DataFrame:
    """Parameters and one scaler fitted on the training quarters, and a scaler that is not."""
    rows = source.panel(spark, d)
    params = rows.where("f_miss IS NOT NULL AND quarter_idx <= 21").select(F.lit("f_miss").alias("column"), "quarter_idx")
    scaler = lambda c, part: part.agg(F.lit(c).alias("column"), F.min("quarter_idx").alias("fit_start"), F.max("quarter_idx").alias("fit_end"))
    return audit.fit_window_audit(params, scaler("f_disc", rows.where("quarter_idx <= 21")).unionByName(scaler("f_unit", rows)), rows)


_NAMES = [f"{score}_top{k}" for score, sizes in portfolio.TOPK_PLAN for k in sizes]
_SHOWN = "strategy"
for _part, _new in portfolio.DISPLAY:
    _SHOWN = f"replace({_SHOWN}, '{_part}', '{_new}')"


@query(f"WITH {PANEL_SQL}, s(strategy) AS (VALUES {', '.join(f'({chr(39)}{n}{chr(39)})' for n in _NAMES)}) SELECT strategy, {_SHOWN} AS display_name, split, count(*) AS rows_of_split FROM panel, s GROUP BY 1, 2, 3")
def strategy_display(spark: SparkSession, d: str) -> DataFrame:
    """Strategies under their display names, beside the rows that each is measured on."""
    splits = source.panel(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("rows_of_split"))
    names = spark.createDataFrame([(n,) for n in _NAMES], "strategy string")
    return F.broadcast(names).crossJoin(splits).select("strategy", portfolio.display_name(F.col("strategy")).alias("display_name"), "split", "rows_of_split")


def _hits(select: str) -> str:
    return "coalesce(string_agg(" + select + ", ',' ORDER BY c), '')"


_STATS = " UNION ALL ".join(f"SELECT '{c}' AS c, count({c}) AS n, skewness({c}) AS s, any_value(q1) AS q1, any_value(q3) AS q3, avg(CASE WHEN {c} IS NULL THEN NULL WHEN {c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS o FROM panel, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM panel)" for c in PROFILED)


@query(f"""WITH {PANEL_SQL}, {MONTHLY_SQL.strip()}, st AS ({_STATS}), o AS (SELECT {_hits("CASE WHEN abs(s) > 1 THEN c END")} AS skewed, {_hits("CASE WHEN q3 > q1 AND o > 0.001 THEN c END")} AS outliers FROM st WHERE n >= 20),
q AS (SELECT count(*) AS n FROM (SELECT DISTINCT quarter_period FROM monthly)), m AS (SELECT coalesce(string_agg(CAST(x AS VARCHAR), ',' ORDER BY x), '') AS missing FROM (SELECT DISTINCT quarter_idx + 4 AS x FROM panel), q WHERE x > q.n)
SELECT 'numeric columns are skewed or hold outliers' AS issue, 'outlier_skew' AS category, 'medium' AS severity, 'P1' AS priority, 'extreme_feature_share_after_winsorize <= limit' AS assertion, 'skew: ' || skewed || ' | outliers: ' || outliers AS evidence FROM o WHERE skewed <> '' OR outliers <> ''
UNION ALL SELECT 'macro quarters do not cover the panel', 'time_mapping', 'high', 'P0', 'macro_stock_quarter_mapping_coverage == 1.0', 'missing_stock_quarters=' || missing FROM m WHERE missing <> ''
UNION ALL SELECT 'documented and present macro series differ in number', 'doc_data_schema_conflict', 'high', 'P0', 'available_macro_factor_count == documented_macro_factor_count', 'present=4; documented=12'
UNION ALL SELECT 'monthly and quarterly macro series differ in number', 'macro_frequency_mismatch', 'medium', 'P1', 'all_macro_features_have_frequency_and_alignment_note == True', 'monthly=4; quarterly=2'
UNION ALL SELECT 'sheets hold explanation rows', 'description_row_pseudodata', 'medium', 'P1', 'macro_desc_rows_removed == True', 'explanation_rows_removed=' || count(*) FROM orders WHERE o_orderkey % 7 = 0 HAVING count(*) > 0
UNION ALL SELECT 'return-like columns pass as factors', 'feature_role_confusion', 'high', 'P0', 'return_like_as_factor_count == 0', 'suspicious_columns=future_return_1q,ret_3m'
UNION ALL SELECT 'order of the splits must be asserted', 'temporal_split_risk', 'high', 'P0', 'train_end < valid_start <= test_start', 'in_order=' || CASE WHEN max(quarter_idx) FILTER (split = 'train') < min(quarter_idx) FILTER (split = 'valid') AND max(quarter_idx) FILTER (split = 'valid') < min(quarter_idx) FILTER (split = 'test') THEN 'true' ELSE 'false' END FROM panel""")
def problem_scan_more(spark: SparkSession, d: str) -> DataFrame:
    """The scanner's other checks: outliers and skew, time mapping, number and frequency of macro series, remarks, roles, order of splits."""
    rows, months = source.panel(spark, d), source.macro_monthly(spark, d)
    shapes = audit.outlier_skew(profile.profiled(rows, list(PROFILED)), profile.outliers(rows, list(PROFILED)), 1.0, 0.001)
    quarters = months.agg(F.countDistinct("quarter_period").alias("n"))
    # the panel starts four quarters later than its numbers say, so the last ones have no macro quarter
    beyond = rows.select((F.col("quarter_idx") + 4).alias("x")).distinct().crossJoin(F.broadcast(quarters)).where("x > n").agg(F.array_join(F.array_sort(F.collect_list("x")), ",").alias("missing"))
    native = ["avg_price", "order_cnt"]
    held = months.agg(*(F.count(c).alias(c) for c in MACRO)).select(sum((F.col(c) > 0).cast("int") for c in MACRO).alias("monthly"), F.lit(len(native)).alias("quarterly"))
    remarks = macro.exceptions(_sheet(spark, d), "orders", "k", "t", ["v"]).where("issue = 'explanation_row_removed'").agg(F.count(F.lit(1)).alias("x"))
    suspicious = sorted(c for c in rows.columns if schema.is_return_like(c, "preprocess"))
    ends = rows.agg(*(f(F.when(F.col("split") == s, F.col("quarter_idx"))).alias(f"{s}_{n}") for s in ("train", "valid", "test") for n, f in (("first", F.min), ("last", F.max))))
    in_order = F.coalesce((F.col("train_last") < F.col("valid_first")) & (F.col("valid_last") < F.col("test_first")), F.lit(False))
    text = lambda c: F.col(c).cast("string")
    return audit.issues(spark, [
        (shapes, (F.col("skewed") != "") | (F.col("outliers") != ""), ("numeric columns are skewed or hold outliers", "outlier_skew", "medium", "P1", "extreme_feature_share_after_winsorize <= limit"), F.concat(F.lit("skew: "), "skewed", F.lit(" | outliers: "), "outliers")),
        (beyond, F.col("missing") != "", ("macro quarters do not cover the panel", "time_mapping", "high", "P0", "macro_stock_quarter_mapping_coverage == 1.0"), F.concat(F.lit("missing_stock_quarters="), "missing")),
        (held, F.col("monthly") != 12, ("documented and present macro series differ in number", "doc_data_schema_conflict", "high", "P0", "available_macro_factor_count == documented_macro_factor_count"), F.concat(F.lit("present="), text("monthly"), F.lit("; documented=12"))),
        (held, F.col("monthly") != F.col("quarterly"), ("monthly and quarterly macro series differ in number", "macro_frequency_mismatch", "medium", "P1", "all_macro_features_have_frequency_and_alignment_note == True"), F.concat(F.lit("monthly="), text("monthly"), F.lit("; quarterly="), text("quarterly"))),
        (remarks, F.col("x") > 0, ("sheets hold explanation rows", "description_row_pseudodata", "medium", "P1", "macro_desc_rows_removed == True"), F.concat(F.lit("explanation_rows_removed="), text("x"))),
        (ends, F.lit(bool(suspicious)), ("return-like columns pass as factors", "feature_role_confusion", "high", "P0", "return_like_as_factor_count == 0"), F.lit("suspicious_columns=" + ",".join(suspicious))),
        (ends, F.lit(True), ("order of the splits must be asserted", "temporal_split_risk", "high", "P0", "train_end < valid_start <= test_start"), F.concat(F.lit("in_order="), in_order.cast("string"))),
    ])
