import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarterdeck.sources import files, panel
from quarterdeck.streaming import windows


def test_quarter_folder_byte_order_mark_and_optional(spark, tmp_path):
    (tmp_path / "1季.csv").write_text("﻿code,x\na,1\n", encoding="utf-8")
    (tmp_path / "10季.csv").write_text("code,y\nb,2\n", encoding="utf-8")
    (tmp_path / "notes.csv").write_text("z\n1\n")
    rows = files.read_quarters(spark, str(tmp_path), "csv", least=2).orderBy("quarter_idx").collect()
    assert [(r["code"], r["x"], r["y"], r["quarter_idx"], r["sheet_name"]) for r in rows] == [("a", "1", None, 1, "1季"), ("b", None, "2", 10, "10季")]
    assert files.columns_of(spark, str(tmp_path / "1季.csv")) == ["code", "x"]
    assert files.read_if_exists(spark, str(tmp_path / "none.csv"), "a string").count() == 0
    assert files.inventory(spark, str(tmp_path)).where("suffix = '.csv'").count() == 3


def test_records_of_several_kinds_and_markdown(spark, tmp_path):
    a, b = spark.createDataFrame([("x", 1)], "kind string, n int"), spark.createDataFrame([("y", "t|u")], "kind string, note string")
    files.write_records([a, b], ["kind", "note", "n", "other"], str(tmp_path / "out"))
    back = files.read_csv(spark, str(tmp_path / "out")).orderBy("kind").collect()
    assert [tuple(r) for r in back] == [("x", None, "1", None), ("y", "t|u", None, None)]
    assert "t\\|u" in files.markdown(b)


def test_snippet_of_first_hit(spark):
    df = spark.createDataFrame([("ab cd key ef key",), ("none",)], "t string").select(files.keyword_snippet(F.col("t"), "key", 2).alias("s"))
    assert [r["s"] for r in df.collect()] == ["cdkeyef", None]


def test_panel_is_pruned_by_quarter(spark, tmp_path):
    files.write_panel(spark.range(10).select((F.col("id") % 3).cast("int").alias("quarter_idx"), "id"), str(tmp_path / "p"))
    plan = spark.read.parquet(str(tmp_path / "p")).where("quarter_idx = 1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(quarter_idx" in plan


def test_loose_names_and_search_by_name(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "q3 table.csv").write_text("Unnamed: 0,x\n7,1\n")
    (tmp_path / "a" / "notes.csv").write_text("x\n1\n")
    assert [(r["row_id_raw"], r["x"], r["quarter_idx"]) for r in files.read_quarters_loosely(spark, str(tmp_path / "a")).collect()] == [("7", "1", 3)]
    with pytest.raises(ValueError):
        files.read_quarters(spark, str(tmp_path / "a"), "csv")
    assert files.resolved(spark, "elsewhere/notes.csv", str(tmp_path)).endswith("a/notes.csv")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "notes.csv").write_text("x\n1\n")
    for path in ("elsewhere/notes.csv", "none.csv"):
        with pytest.raises(FileNotFoundError):
            files.resolved(spark, path, str(tmp_path))


def test_mark_on_write(spark, tmp_path):
    files.write_records([spark.createDataFrame([("x", 1)], "kind string, n int")], ["kind", "n"], str(tmp_path / "out"), mark=True)
    part = next((tmp_path / "out").glob("part-*.csv"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfkind,n\n")


def test_windowed_counts_drop_late_events(spark, tmp_path):
    schema = "at timestamp, k string"
    for i, rows in enumerate([[("2026-01-01 01:00:00", "a"), ("2026-01-01 02:00:00", "a")], [("2026-01-09 00:00:00", "b")], [("2026-01-09 01:00:00", "b")], [("2026-01-01 03:00:00", "a")], [("2026-01-19 00:00:00", "b")]]):
        spark.createDataFrame(rows, "at string, k string").select(F.col("at").cast("timestamp").alias("at"), "k").coalesce(1).write.json(str(tmp_path / f"in/{i}"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "in/*"))
    stream = windows.windowed_counts(events, "at", "k").writeStream.format("memory").queryName("windowed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert sorted((r["k"], r["events"]) for r in spark.table("windowed").collect()) == [("a", 2), ("b", 2)]  # a batch uses the watermark of the batch before last


def test_a_large_quarter_has_several_writers(spark, tmp_path):
    df = spark.range(3000).select(F.when(F.col("id") < 2000, 1).when(F.col("id") < 2900, 2).when(F.col("id") < 2990, 3).alias("quarter_idx"), "id")
    files.write_panel(df, str(tmp_path / "p"), file_rows=200)
    folders = {q: [len(pq.read_table(f, partitioning=None)) for f in (tmp_path / "p" / f"quarter_idx={q}").glob("*.parquet")] for q in ("1", "2", "3", "__HIVE_DEFAULT_PARTITION__")}
    assert {q: sum(n) for q, n in folders.items()} == {"1": 2000, "2": 900, "3": 90, "__HIVE_DEFAULT_PARTITION__": 10}
    assert max(map(max, folders.values())) <= 200 and len(folders["1"]) >= 10 and len(folders["3"]) == 1
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "p")).select("quarter_idx", "id").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    files.write_panel(df.limit(0), str(tmp_path / "none"))


def test_cells_do_not_depend_on_the_order_of_lines(spark, tmp_path):
    lines = panel.table(spark, "/root/testdata/sf0.01", "lineitem")
    found = []
    for k in range(2):
        lines.orderBy(F.xxhash64(F.lit(k), *lines.columns)).coalesce(1 + k).write.parquet(str(tmp_path / f"{k}/lineitem.parquet"))
        found.append(panel.cells(spark, str(tmp_path / f"{k}")))
    assert found[0].count() > 2000
    assert found[0].exceptAll(found[1]).count() == 0
