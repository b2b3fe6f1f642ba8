from pyspark.sql import functions as F

from quarterdeck.operators import audit, macro, profile, schema
from quarterdeck.sources import files


def test_drift_against_the_first_sheet_by_name(spark):
    cells = [("1季", "a", 1), ("1季", "b", 2), ("10季", "a", 1), ("10季", "b", 2), ("10季", "c", 3), ("10季", "a", 9), ("2季", "c", 1), ("2季", "b", 2), ("2季", "a", 3), ("3季", "d", 5), ("3季", "b", 5)]
    out = schema.drift(schema.headed(spark.createDataFrame(cells, "sheet_name string, column string, place int")))
    assert sorted(map(tuple, out.collect())) == [("10季", "", "", False), ("1季", "c", "", False), ("2季", "", "", True), ("3季", "a;c", "d", False)]
    assert schema.drift(schema.headed(spark.createDataFrame([], "sheet_name string, column string, place int"))).count() == 0


def test_names_are_normalized_and_projected_once():
    assert schema.normalized_names([" ", "a ", "", "a", None, "a"]) == ["row_id_raw", "a", "empty_col_2", "a__dup1", "empty_col_4", "a__dup2"]
    assert schema.ordered(["b", "a"], ["a", "c", "b"]) == ["b", "a", "c"]


def test_catalogue_and_its_conflicts(spark):
    months = spark.createDataFrame([(1.0, None, 2.0), (2.0, None, None)], "x double, none double, only double")
    quarters = spark.createDataFrame([(1.0, 5.0)], "x double, new double")
    sheet = spark.createDataFrame([(" x ", "v", "the x", "m"), ("new", "a new one", " ", "q"), (None, "remark", "r", None), ("gone", "g", "gone", "m")], "acronym string, variable string, definition string, frequency string")
    defined = macro.definitions(sheet)
    assert sorted(map(tuple, defined.collect())) == [("gone", "gone", "m"), ("new", "a new one", "q"), ("x", "the x", "m")]
    entries = macro.catalogue(months, quarters, ["x", "none", "only"], ["x", "new"], defined)
    assert {r["series"]: (r["n_monthly"], r["n_quarterly"], r["status"]) for r in entries.collect()} == {
        "x": (2, 1, "ok"), "none": (0, 0, "defined_no_data"), "only": (1, 0, "data_no_definition"), "new": (0, 1, "quarterly_only"), "gone": (0, 0, "defined_no_data"),
    }
    assert {(r["series"], r["conflict"], r["detail"]) for r in macro.conflicts(entries, 12).collect()} >= {("*", "series_count", "present=3; documented=12"), ("new", "quarterly_only", "monthly=0; quarterly=1")}
    assert macro.conflicts(entries, 3).where("series = '*'").count() == 0


def test_return_like_and_prohibited_features_stay_out(spark):
    rows = [("f", "factor", "transform_as_factor"), ("My_Return_3", "factor", "transform_as_factor"), ("区间涨跌幅(1月)", "factor", "transform_as_factor"), ("leak", "factor", "transform_as_factor"), ("split", "meta", "preserve_unmodified")]
    out = audit.final_features(spark.createDataFrame(rows, "column string, role string, feature_action string"), ["leak"])
    assert {r["column"]: (r["included_in_X"], r["exclusion_reason"]) for r in out.collect()} == {
        "f": (True, ""), "My_Return_3": (False, "return_like_excluded"), "区间涨跌幅(1月)": (False, "return_like_excluded"), "leak": (False, "prohibited_or_leakage_guard"), "split": (False, "feature_action=preserve_unmodified"),
    }
    assert tuple(audit.leakage_report(out).first()) == (1, 0, 0, "PASS")


def test_shapes_are_the_sums_of_the_profile(spark):
    df = spark.range(50).select(F.when(F.col("id") % 7 > 0, F.col("id") - 5.0).alias("a"), F.lit(None).cast("double").alias("b"))
    full = {r["column"]: r for r in profile.profiled(df, ["a", "b"]).collect()}
    for r in profile.shapes(df, ["a", "b"]).collect():
        assert all(r[m] == full[r["column"]][m] for m in profile.SHAPES)
    assert full["a"]["q50"] == df.agg(F.percentile("a", 0.5)).first()[0] and full["b"]["q50"] is None and full["b"]["missing_rate"] == 1.0
    assert {r["column"]: r["n_values"] for r in profile.filled(df, ["a", "b"]).collect()} == {"a": 42, "b": 0}
    assert [r["n"] for r in profile.profiled(df.limit(0), ["a"]).collect()] == [0.0]


def test_json_and_markdown_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b\nc"), (None, None)], "n int, t string")
    files.write_json(df, str(tmp_path / "j"))
    assert sorted(map(tuple, files.read_json(spark, str(tmp_path / "j"), df.schema).collect()), key=str) == [(1, "a|b\nc"), (None, None)]
    assert files.read_json(spark, str(tmp_path / "none"), df.schema).count() == 0
    assert {r["line"] for r in files.markdown_lines(df).collect()} == {"| 1 | a\\|b c |", "|  |  |"}
