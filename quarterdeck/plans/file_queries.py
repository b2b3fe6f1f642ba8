"""Queries that write tables with the file sinks and return what the file sources read back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck.functions.stats import rounded
from quarterdeck.operators import schema
from quarterdeck.plans.panel_queries import r6
from quarterdeck.sources import files
from quarterdeck.sources import panel as source
from quarterdeck.sources.panel import FACTORS, MACRO, MONTHLY_SQL, PANEL_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


@query(f"WITH {PANEL_SQL} SELECT entity_id, quarter_idx, quarter_idx || '季' AS sheet_name, split, {', '.join((*FACTORS, 'f_miss', 'ret_3m', 'future_return_1q'))} FROM panel")
def panel_files(spark: SparkSession, d: str) -> DataFrame:
    """The panel written by quarter, a folder each, and united again from the folders, whose names give the quarter."""
    columns = ["entity_id", "split", *FACTORS, "f_miss", "ret_3m", "future_return_1q"]
    path = files.scratch(spark, "panel")
    files.write_panel(source.panel(spark, d).select("quarter_idx", *columns), path)
    back = files.read_quarters(spark, path, "parquet", r"quarter_idx=([0-9]+)$", source.LAST_QUARTER)
    return back.select("entity_id", "quarter_idx", "sheet_name", *columns[1:])


@query("""SELECT 'supplier' AS kind, s_suppkey AS id, s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment, CAST(NULL AS VARCHAR) AS remark FROM supplier
UNION ALL SELECT 'customer', c_custkey, c_name, c_acctbal, c_mktsegment, NULL FROM customer""")
def records_files(spark: SparkSession, d: str) -> DataFrame:
    """Records of two kinds in one CSV with a byte-order mark and fixed columns: what a kind lacks is blank, what is not asked for is left out; beside a table that is not there."""
    suppliers = source.table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("left_out"))
    customers = source.table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    path, form = files.scratch(spark, "records"), "kind string, id long, name string, balance double, segment string, remark string"
    files.write_records([suppliers, customers], ["kind", "id", "name", "balance", "segment", "remark"], path, mark=True)
    return files.read_if_exists(spark, path, form).unionByName(files.read_if_exists(spark, f"{path}-absent", form))


@query(f"WITH {MONTHLY_SQL} SELECT month_period, {', '.join(f'{r6(m)} AS {m}' for m in MACRO)} FROM monthly")
def macro_files(spark: SparkSession, d: str) -> DataFrame:
    """The monthly series as CSV, projected to the key and those of the series that its header names, each once."""
    path = files.scratch(spark, "macro")
    rows = source.macro_monthly(spark, d)
    files.write_records([rows], ["month_period", "quarter_period", *MACRO], path, mark=True)
    there = files.columns_of(spark, path)
    wanted = [c for c in schema.ordered(["month_period"], list(MACRO), there) if c in there and c != "quarter_period"]
    back = files.read_csv(spark, path)
    return back.select(*(rounded(F.col(c).cast("double")).alias(c) if c in MACRO else F.col(c) for c in wanted))


@query(f"WITH {PANEL_SQL} SELECT quarter_idx, count(*) AS row_count, {r6('avg(f_disc)')} AS mean_disc, list(DISTINCT split ORDER BY split)[1] AS split, count(ret_3m) AS n_returns FROM panel GROUP BY 1")
def summary_files(spark: SparkSession, d: str) -> DataFrame:
    """A summary of each quarter as JSON lines, read under its schema."""
    path = files.scratch(spark, "summary")
    rows = source.panel(spark, d).groupBy("quarter_idx").agg(F.count(F.lit(1)).alias("row_count"), rounded(F.avg("f_disc")).alias("mean_disc"), F.min("split").alias("split"), F.count("ret_3m").alias("n_returns"))
    files.write_json(rows, path)
    return files.read_json(spark, path, rows.schema)


@query("SELECT '| ' || p_partkey || ' | ' || p_name || '\\| ' || p_brand || ' | ' || p_size || ' |' AS line FROM part")
def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    """A line of a Markdown table for every part; a name that holds | or a line end stays one cell."""
    parts = source.table(spark, d, "part")
    return files.markdown_lines(parts.select("p_partkey", F.concat("p_name", F.lit("|\n"), "p_brand").alias("name"), "p_size"))


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def resolved_file(spark: SparkSession, d: str) -> DataFrame:
    """A table by a path that is no longer right: found by its name below the folder."""
    return spark.read.parquet(files.resolved(spark, "moved/elsewhere/supplier.parquet", d)).select("s_suppkey", "s_name", "s_nationkey")
