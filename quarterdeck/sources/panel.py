"""The entity by quarter panel and the macro series, built from the line and order tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarterdeck.functions.stats import rounded, split_name, steady_avg, steady_stddev, steady_sum

FACTORS = ("f_disc", "f_tax", "f_qty", "f_unit", "f_rshare", "f_pstd", "f_lines", "f_parts", "f_acct", "f_growth")
MACRO = ("avg_price", "order_cnt", "fshare", "ordgr")
FIRST_YEAR = 1995
LAST_QUARTER = 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quarter_of(date: str):
    return ((F.year(date) - FIRST_YEAR) * 4 + F.quarter(date)).cast("int")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier and ship quarter (1 to 28).

    Sums don't depend on the order in which the lines arrive, so that the cells are the same each time they are computed. The lines themselves
    are shuffled, once, since they are smaller than the sums of their parts."""
    price = F.col("l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity_id"), quarter_of("l_shipdate").alias("quarter_idx"), price, "l_discount", "l_tax", "l_quantity", (F.col("l_returnflag") == "R").cast("double").alias("returned"), "l_partkey",
    )
    return lines.repartition("entity_id", "quarter_idx").groupBy("entity_id", "quarter_idx").agg(
        rounded(steady_sum(price * (1 - F.col("l_discount")))).alias("revenue"),
        rounded(steady_avg(F.col("l_discount")), 9).alias("f_disc"),
        rounded(steady_avg(F.col("l_tax")), 9).alias("f_tax"),
        rounded(steady_avg(F.col("l_quantity")), 9).alias("f_qty"),
        rounded(steady_avg(price / F.col("l_quantity")), 9).alias("f_unit"),
        rounded(F.avg("returned"), 9).alias("f_rshare"),
        rounded(steady_stddev(price), 9).alias("f_pstd"),
        F.count(F.lit(1)).cast("double").alias("f_lines"),
        F.countDistinct("l_partkey").cast("double").alias("f_parts"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters 1 to 27 with factors, ret_3m (growth on the quarter before) and future_return_1q (that of the next quarter).

    Quarters before and after are joined on their number, so a gap gives null and not a neighbour's value.
    """
    base = cells(spark, sf_dir)
    by_entity = Window.partitionBy("entity_id").orderBy("quarter_idx")

    def beside(column: str, step: int):
        value = F.lag(column, 1) if step < 0 else F.lead(column, 1)
        number = F.lag("quarter_idx", 1) if step < 0 else F.lead("quarter_idx", 1)
        return F.when(number.over(by_entity) == F.col("quarter_idx") + step, value.over(by_entity))

    base = base.withColumn("_before", beside("revenue", -1))
    base = base.withColumn("ret_3m", rounded(100 * F.try_divide(F.col("revenue") - F.col("_before"), F.col("_before")), 9)).drop("_before")
    base = base.withColumn("future_return_1q", beside("ret_3m", 1)).where(F.col("quarter_idx").between(1, LAST_QUARTER))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("entity_name"), F.col("s_acctbal").alias("f_acct"))
    out = base.join(suppliers, "entity_id")
    missing = (F.col("entity_id") * 7 + F.col("quarter_idx")) % 23 == 0
    return out.withColumns({"f_growth": F.col("ret_3m"), "f_miss": F.when(~missing, F.col("f_disc")), "split": split_name(F.col("quarter_idx"))})


#: DuckDB common table expressions for the same panel.
PANEL_SQL = """
cells AS (
  SELECT l_suppkey AS entity_id, CAST((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) AS INTEGER) AS quarter_idx,
    round(sum(l_extendedprice * (1 - l_discount)), 6) + 0.0 AS revenue, round(avg(l_discount), 9) + 0.0 AS f_disc,
    round(avg(l_tax), 9) + 0.0 AS f_tax, round(avg(l_quantity), 9) + 0.0 AS f_qty,
    round(avg(l_extendedprice / l_quantity), 9) + 0.0 AS f_unit,
    round(avg(CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 9) + 0.0 AS f_rshare,
    round(stddev_samp(l_extendedprice), 9) + 0.0 AS f_pstd, CAST(count(*) AS DOUBLE) AS f_lines,
    CAST(count(DISTINCT l_partkey) AS DOUBLE) AS f_parts
  FROM lineitem GROUP BY 1, 2),
grown AS (
  SELECT a.*, round(100 * (a.revenue - b.revenue) / b.revenue, 9) + 0.0 AS ret_3m
  FROM cells a LEFT JOIN cells b ON b.entity_id = a.entity_id AND b.quarter_idx = a.quarter_idx - 1),
panel AS (
  SELECT a.*, c.ret_3m AS future_return_1q, s_name AS entity_name, s_acctbal AS f_acct, a.ret_3m AS f_growth,
    CASE WHEN (a.entity_id * 7 + a.quarter_idx) % 23 <> 0 THEN a.f_disc END AS f_miss,
    CASE WHEN a.quarter_idx BETWEEN 1 AND 21 THEN 'train' WHEN a.quarter_idx BETWEEN 22 AND 25 THEN 'valid' WHEN a.quarter_idx BETWEEN 26 AND 30 THEN 'test' ELSE 'unknown' END AS split
  FROM grown a LEFT JOIN grown c ON c.entity_id = a.entity_id AND c.quarter_idx = a.quarter_idx + 1
  JOIN supplier ON s_suppkey = a.entity_id WHERE a.quarter_idx BETWEEN 1 AND 27)"""


def macro_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order statistics: month_start, month_period, quarter_period and four series."""
    orders = table(spark, sf_dir, "orders").withColumn("month_start", F.to_date(F.trunc("o_orderdate", "MM")))
    monthly = orders.groupBy("month_start").agg(
        rounded(steady_avg(F.col("o_totalprice")), 6).alias("avg_price"),
        F.count(F.lit(1)).cast("double").alias("order_cnt"),
        rounded(F.avg((F.col("o_orderstatus") == "F").cast("double")), 9).alias("fshare"),
    )
    before = F.lag("order_cnt").over(Window.orderBy("month_start"))  # a row for each month
    monthly = monthly.withColumn("ordgr", rounded(100 * (F.col("order_cnt") - before) / before, 9))
    return monthly.withColumns({"month_period": F.date_format("month_start", "yyyy-MM"), "quarter_period": quarter_period("month_start")})


def quarter_period(date: str):
    return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))


MONTHLY_SQL = """
monthly0 AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, round(avg(o_totalprice), 6) + 0.0 AS avg_price,
    CAST(count(*) AS DOUBLE) AS order_cnt, round(avg(CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 9) + 0.0 AS fshare
  FROM orders GROUP BY 1),
monthly AS (
  SELECT *, round(100 * (order_cnt - lag(order_cnt) OVER (ORDER BY month_start)) / lag(order_cnt) OVER (ORDER BY month_start), 9) + 0.0 AS ordgr,
    strftime(month_start, '%Y-%m') AS month_period, CAST(year(month_start) AS VARCHAR) || 'Q' || CAST(quarter(month_start) AS VARCHAR) AS quarter_period
  FROM monthly0)"""
