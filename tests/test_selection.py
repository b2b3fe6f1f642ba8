import pytest

import __spark_entry__ as entry
from quarterdeck.operators import mcda
from quarterdeck.plans import selection_queries

SF = "/root/testdata/sf0.001"


def test_selection_takes_up_to_fifteen_of_all_factors(spark):
    rows = entry.queries()["stepwise_log"](spark, SF).collect()
    assert 6 < max(r["step"] for r in rows) <= 15
    assert {"f_lines", "f_parts"} <= {r["selected_feature"].split("z_")[1].rstrip("_") for r in rows}


def test_flows_use_the_composites_of_the_quarter(spark):
    panel = spark.createDataFrame([(1, 1, 2.0, 3.0, 5.0), (1, 2, -1.0, 4.0, 5.0), (2, 1, 2.0, 3.0, 7.0)], "quarter_idx int, entity_id int, a double, b double, m double")
    picks = spark.createDataFrame([(1, "am", 0.5), (1, "bm", -0.1), (2, "bm", 0.0)], "quarter_idx int, feature string, coefficient double")
    got = sorted(tuple(r) for r in mcda.composite_form(panel, picks, [("am", "a", "m"), ("bm", "b", "m")]).collect())
    assert got == [(1, 1, "am", 10.0), (1, 1, "bm", -15.0), (1, 2, "am", -5.0), (1, 2, "bm", -20.0), (2, 1, "bm", 21.0)]


def test_chain_goes_by_the_selection(spark, monkeypatch):
    """The chain's flows are those of the picks: fixed factors are not read."""
    picks = entry.queries()["selected_composites"](spark, SF).collect()
    log = {(r["quarter_idx"], r["selected_feature"]): r["coefficient"] for r in entry.queries()["stepwise_log"](spark, SF).collect()}
    assert {(r["quarter_idx"], r["feature"]): pytest.approx(r["coefficient"]) for r in picks} == log
    monkeypatch.setattr(selection_queries, "_flows", None)
    assert entry.queries()["mainline_performance"](spark, SF).count() == 4 * 13


def test_score_sample_is_whole_or_uniform(spark):
    rows = [(k % 15, k, 0.5, None if k == 3 else 0.1, None if k == 4 else 1.0) for k in range(2000)]
    df = spark.createDataFrame(rows, "quarter_idx int, entity_id int, pure_stagewise_score double, pure_promethee_score double, future_return_1q double")
    assert {r["entity_id"] for r in selection_queries._sampled(df, 6000).collect()} == set(range(2000)) - {3, 4}
    some = [r["entity_id"] for r in selection_queries._sampled(df, 500).collect()]
    assert len(set(some)) == 500 and 0.4 < sum(k < 1000 for k in some) / 500 < 0.6
    assert some == [r["entity_id"] for r in selection_queries._sampled(df.repartition(7), 500).collect()]


def test_conversion_log_keeps_examples_whole(spark):
    from quarterdeck.operators import schema

    long = "x" * 45
    rows = [(long + "b", "1"), (long + "a", " 2.0 "), (None, ""), ("7", None), *((f"y{k}", "3") for k in range(9))] * 2
    got = {r["column"]: r for r in schema.conversion_log(spark.createDataFrame(rows, "t string, n string"), ["t", "n"]).collect()}
    assert (got["t"]["non_missing"], got["t"]["failed"], got["t"]["examples"], got["t"]["action"]) == (24, 22, f"{long}a;{long}b;y0;y1;y2", "numeric")
    assert (got["n"]["failed"], got["n"]["examples"], got["n"]["ratio"]) == (0, "", 1.0)
    none = schema.conversion_log(spark.createDataFrame([], "t string"), ["t"]).first()
    assert (none["non_missing"], none["failed"], none["ratio"], none["examples"]) == (0, 0, None, "")
