"""File sources and sinks: one table per quarter in a folder, CSV with a byte-order mark, optional tables, inventory, keyword search, reports."""

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the name of a quarter.
SHEET = r"([0-9]+)季(?:\.[a-z]+)?$"
#: Fixed value: quarters that a folder must have.
LEAST = 30
CSV = {"header": True, "encoding": "UTF-8"}


def read_quarters(spark: SparkSession, folder: str, kind: str = "parquet", pattern: str = SHEET, least: int = LEAST) -> DataFrame:
    """A folder of one table per quarter (named <n>季), united by column name, with quarter_idx and sheet_name from the name."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)]
    found = sorted((int(m[1]), n) for n in names if (m := re.search(pattern, n)))
    if len(found) < least:
        raise ValueError(f"{folder} has {len(found)} quarters, fewer than {least}")
    out = None
    for quarter, name in found:
        one = spark.read.parquet(f"{folder}/{name}") if kind == "parquet" else spark.read.options(**CSV).csv(f"{folder}/{name}")
        one = one.withColumns({"quarter_idx": F.lit(quarter), "sheet_name": F.lit(f"{quarter}季")})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_quarters_loosely(spark: SparkSession, folder: str, kind: str = "csv") -> DataFrame:
    """Every table with digits in its name, from one on; a column without a name, or named as pandas does, is row_id_raw."""
    rows = read_quarters(spark, folder, kind, r"([0-9]+)", 1)
    unnamed = next((c for c in rows.columns if c in ("_c0", "Unnamed: 0")), None)
    return rows.withColumnRenamed(unnamed, "row_id_raw") if unnamed else rows


def resolved(spark: SparkSession, path: str, root: str) -> str:
    """The path where it is there, else the one file below root of its name; none or several raise."""
    if exists(spark, path):
        return path
    name = path.rstrip("/").rsplit("/", 1)[-1]
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    listed = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(fs_path, True)
    found = []
    while listed.hasNext():
        here = listed.next().getPath()
        if here.getName() == name:
            found.append(here.toString())
    if len(found) != 1:
        raise FileNotFoundError(f"{name}: {len(found)} files below {root}: {sorted(found)[:5]}")
    return found[0]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.options(**CSV)
    return (reader.schema(schema) if schema else reader).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines under a schema, so that no pass over the data infers one; an empty table where the path is not there."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_if_exists(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "csv") -> DataFrame:
    """An empty table of the schema where the path is not there."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return read_csv(spark, path, schema) if kind == "csv" else spark.read.schema(schema).parquet(path)


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header alone."""
    return spark.read.options(**CSV).csv(path).columns


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """name, bytes and suffix of every file below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), "bytes", F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("suffix"))


def keyword_snippet(text: Column, keyword: str, around: int = 40) -> Column:
    """The first place of the keyword in the text without spaces, with the characters around it; null if it is not there."""
    flat = F.replace(text, F.lit(" "), F.lit(""))
    at = F.instr(flat, keyword)
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(flat, start, at - start + len(keyword) + around))


#: Rows of a file of a panel, and of a writer.
FILE_ROWS = 5_000_000


def write_panel(df: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Parquet by quarter, so that a later filter on quarter_idx reads those folders alone.

    A quarter is dealt to writers by its number of rows, so that none writes much more than file_rows and no file holds more."""
    counts = df.groupBy(F.col("quarter_idx").alias("_q")).agg(F.ceil(F.count(F.lit(1)) / file_rows).cast("int").alias("_writers"))
    writers = counts.agg(F.sum("_writers")).first()[0] or 1
    dealt = df.join(F.broadcast(counts), F.col("quarter_idx").eqNullSafe(F.col("_q"))).drop("_q")  # a row per quarter
    dealt = dealt.withColumn("_writer", F.pmod(F.xxhash64(*df.columns), F.col("_writers"))).repartition(int(writers), "quarter_idx", "_writer")
    dealt.select(df.columns).write.mode("overwrite").option("maxRecordsPerFile", file_rows).partitionBy("quarter_idx").parquet(path)


def write_records(frames: list[DataFrame], order: list[str], path: str, mark: bool = False) -> None:
    """Records of several kinds as one CSV: columns in the given order, blank where a kind lacks one, others left out.

    mark: each part starts with a byte-order mark, before its header."""
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    out = out.select(*(F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in order))
    if mark and order:
        out = out.withColumnRenamed(order[0], f"\ufeff{order[0]}")  # the header's first name carries it
    out.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown_lines(df: DataFrame) -> DataFrame:
    """line: the row of a Markdown table for every row, cells as text with | escaped and line ends as blanks, nulls empty."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |")).alias("line"))


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A table of at most limit rows, with | escaped."""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + [r["line"] for r in markdown_lines(df.limit(limit)).collect()])


_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir); in a folder of our own only where that is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="quarterdeck-files-")
        _own[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
