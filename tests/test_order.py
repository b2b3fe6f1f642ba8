"""Ranks, prefix sums and quantiles over cells against pandas, on ties, hot values, nulls, null groups and empty tables."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarterdeck.functions import order

SCHEMA = "g int, e long, x double"


def _rows(seed: int):
    rng = random.Random(seed)
    out = []
    for e in range(3000):
        g = rng.choice((1, 1, 1, 2, None))
        x = rng.choice((0.25, rng.gauss(0, 1), rng.gauss(0, 1), None if rng.random() < 0.1 else round(rng.random(), 2)))
        out.append((g, e, x))
    return out + [(5, 9000, 1.5), (6, 9001, None)]


@pytest.fixture(params=[0, 10**9], ids=["cells", "task"])
def in_task(request, monkeypatch):
    monkeypatch.setattr(order, "ROWS_IN_TASK", request.param)
    monkeypatch.setattr(order, "CUTS", 16)
    monkeypatch.setattr(order, "_GRID", [i / 16 for i in range(17)])


def _pandas(rows):
    out = pd.DataFrame(rows, columns=["g", "e", "x"], dtype=object)
    return out.assign(g=out.g.map(lambda g: -1 if g is None else g).astype(int), e=out.e.astype(int), x=out.x.astype(float)).sort_values("e").reset_index(drop=True)


def test_ranks_and_ordinals(spark, in_task):
    rows = _rows(1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = order.with_average_rank(df, "x", ["g"], "r")
    got = order.with_ordinal(order.with_average_rank(got, "x", ["g"], "p", pct=True), "x", "e", ["g"], "o", size="n").toPandas().sort_values("e").reset_index(drop=True)
    want = _pandas(rows)
    assert list(got.columns) == ["g", "e", "x", "r", "p", "o", "n"]
    assert got.r.astype(float).round(9).fillna(-1).tolist() == want.groupby("g").x.rank().fillna(-1).tolist()
    assert got.p.astype(float).round(9).fillna(-1).tolist() == want.groupby("g").x.rank(pct=True).round(9).fillna(-1).tolist()
    want["o"] = want.sort_values(["g", "x", "e"], ascending=[True, False, True], na_position="last").groupby("g").cumcount() + 1
    assert got.o.tolist() == want.o.tolist()
    assert got.n.tolist() == want.groupby("g").x.transform("count").tolist()


def test_prefix_sums(spark, in_task):
    rows = [r for r in _rows(2) if r[2] is not None]
    got = order.with_prefix(spark.createDataFrame(rows, SCHEMA), "x", ["g"], "lower", "before").toPandas()
    by = {}
    for g, _, x in rows:
        by.setdefault(-1 if g is None else g, []).append(x)
    for r in got.itertuples():
        own = by[-1 if math.isnan(r.g) else int(r.g)]
        assert r.x * r.lower - r.before == pytest.approx(sum(r.x - y for y in own if y < r.x), abs=1e-6)
    assert {"_n", "_total"} <= set(got.columns)


def test_quantiles(spark, in_task):
    rows = _rows(3)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("y y", -2 * F.col("x"))
    fractions = (0.0, 0.01, 0.25, 0.5, 0.99, 1.0)
    for group in ((), ("g",)):
        got = order.quantiles(df, ["x", "y y"], fractions, group)
        want = df.groupBy(*group).agg(*(F.percentile(f"`{c}`", F.array(*map(F.lit, fractions))).alias(c) for c in ("x", "y y")))
        key = lambda r: str(r[0]) if group else ""
        assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_quantiles_of_filled_columns(spark, in_task):
    rows = [*_rows(5), (7, 1, 1.0), (7, 2, None), (7, 3, 4.0), (7, 4, None), (8, 1, float("nan")), (8, 2, 2.0), (8, 3, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("y", F.when(F.col("e") % 3 > 0, F.col("x") * 1e9))
    fractions = (0.0, 0.01, 0.3, 0.5, 0.99, 1.0)
    asked = F.array(*map(F.lit, fractions))
    got = order.quantiles(df, ["x", "y"], (0.25,), ("g",), filled=fractions)
    middle = df.groupBy("g").agg(F.median("x").alias("mx"), F.median("y").alias("my")).withColumnRenamed("g", "h")
    full = df.join(middle, F.col("g").eqNullSafe(F.col("h"))).withColumns({"fx": F.coalesce("x", "mx"), "fy": F.coalesce("y", "my")})
    quarter = F.array(F.lit(0.25))
    want = full.groupBy("g").agg(*(F.concat(F.percentile(c, quarter), F.percentile(f"f{c}", asked)).alias(c) for c in ("x", "y")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_quantiles_run_no_job_while_the_plan_is_built(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.assert_true(F.lit(False) & (F.col("id") < 0)).isNull().cast("double").alias("x"))
    order.quantiles(df, ["x"], (0.5,), ("g",), filled=(0.1,))  # the rows raise when they are read
    with pytest.raises(Exception, match="ASSERT|assert|false"):
        order.quantiles(df, ["x"], (0.5,)).collect()


def test_many_quantiles_of_a_constant(spark):
    df = spark.range(5000).select(F.lit(2.5).alias("x"), F.col("id").cast("double").alias("y"))
    got = order.quantiles(df, ["x", "y"], tuple(k / 999 for k in range(1000))).first()
    assert got["x"] == [2.5] * 1000
    assert got["y"] == df.agg(F.percentile("y", F.expr(f"array({', '.join(f'{k / 999!r}D' for k in range(1000))})"))).first()[0]


def test_empty(spark, in_task):
    none = spark.createDataFrame([], SCHEMA)
    assert order.with_average_rank(none, "x", ["g"], "r").count() == 0
    assert order.with_ordinal(none, "x", "e", ["g"], "o").count() == 0
    assert [tuple(r) for r in order.quantiles(none, ["x"], (0.5,)).collect()] == [(None,)]
    assert order.quantiles(none, ["x"], (0.5,), ("g",)).count() == 0


def test_equal_scores_under_text_ids_are_split(spark, monkeypatch):
    monkeypatch.setattr(order, "ROWS_IN_TASK", 0)
    ids = [f"SH{k:06d}" for k in range(6000)]
    random.Random(4).shuffle(ids)
    df = spark.createDataFrame([(1, e, 0.5) for e in ids] + [(2, "é", 0.5), (2, "", 0.5), (2, None, 0.5), (3, "a", None)], "g int, e string, x double")
    cells = order.celled(df, ["g"], "x", "e").groupBy("g", "_cell", "_sub").count()
    assert cells.agg(F.max("count")).first()[0] < 100
    got = {(r["g"], r["e"]): r["o"] for r in order.with_ordinal(df, "x", "e", ["g"], "o").collect()}
    assert [got[1, e] for e in sorted(ids)] == list(range(1, 6001))
    assert (got[2, None], got[2, ""], got[2, "é"]) == (1, 2, 3)


def test_quantiles_do_not_depend_on_where_the_cuts_fall(spark, monkeypatch):
    """Approximate percentiles may differ each time they are computed, as the order of their parts does."""
    given = F.percentile_approx
    moved = F.udf(lambda cuts: cuts and sorted(c + random.uniform(-0.2, 0.2) for c in cuts), "array<double>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda *x: moved(given(*x)))
    draw = random.Random(3)
    values = {g: [draw.gauss(0, 1) for _ in range(2000)] for g in (1, 2)}
    rows = spark.createDataFrame([(g, x) for g, xs in values.items() for x in xs], "g int, x double")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {r["g"]: r["x"] for r in order.quantiles(rows, ["x"], (0.01, 0.5, 0.99), ("g",), filled=(0.25,)).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    for g, xs in values.items():
        assert got[g] == pytest.approx([pd.Series(xs).quantile(q) for q in (0.01, 0.5, 0.99, 0.25)], abs=1e-12)
