"""Power and quantile scalers against direct versions on numpy."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterdeck.operators import preprocess, scalers


def yeo_johnson(x, p):
    up = np.log1p(x) if p == 0 else (np.power(1 + x, p, where=x >= 0, out=np.zeros_like(x)) - 1) / p
    down = np.log1p(-x) if p == 2 else (np.power(1 - x, 2 - p, where=x < 0, out=np.zeros_like(x)) - 1) / (2 - p)
    return np.where(x >= 0, up, -down)


def best_power(x):
    """Golden-section search of the likelihood."""
    logs = (np.sign(x) * np.log1p(np.abs(x))).sum()

    def loss(p):
        return len(x) / 2 * math.log(yeo_johnson(x, p).var()) - (p - 1) * logs

    a, b, g = -25.0, 25.0, (math.sqrt(5) - 1) / 2
    while b - a > 1e-9:
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return (a + b) / 2


def columns(seed, n):
    rng = np.random.default_rng(seed)
    return {"skew": np.exp(rng.standard_normal(n)), "both": rng.standard_normal(n) ** 3, "far": rng.standard_normal(n) ** 2 * -50, "steep": rng.random(n) ** (1 / 9), "ties": rng.integers(0, 4, n).astype(float), "same": np.full(n, 7.5)}


def panel(spark, data, n):
    names = list(data)
    rows = [(1 + 2 * (k % 14), *(None if (k + j) % 17 == 0 and c != "same" else float(data[c][k]) for j, c in enumerate(names)), None) for k in range(n)]
    frame = spark.createDataFrame(rows, "quarter_idx int, " + ", ".join(f"{c} double" for c in names) + ", nothing double")
    return rows, frame, [*names, "nothing"]


def test_power_scaling(spark):
    rows, frame, names = panel(spark, columns(1, 700), 700)
    train = frame.where("quarter_idx <= 21")
    fitted = scalers.powers(train, names)
    assert fitted["same"] is None and fitted["nothing"] is None
    got = preprocess.rescaled(frame, names, "power").collect()
    for j, c in enumerate(names[:-2]):
        x = np.array([np.nan if r[1 + j] is None else r[1 + j] for r in rows])
        known = x[(np.array([r[0] for r in rows]) <= 21) & ~np.isnan(x)]
        power = best_power(known)
        assert fitted[c] == pytest.approx(power, abs=1e-6)
        y, base = yeo_johnson(np.nan_to_num(x), power), yeo_johnson(known, power)
        want = np.where(np.isnan(x), np.nan, (y - base.mean()) / base.std())
        assert np.array([np.nan if r[c] is None else r[c] for r in got]) == pytest.approx(want, abs=1e-5, nan_ok=True)
    assert {(r["same"], r["nothing"]) for r in got} == {(0.0, 0.0)}


def test_power_beyond_the_first_grid(spark):
    x = (1 - np.random.default_rng(2).random(400) ** 2 * 0.2) * 3
    frame = spark.createDataFrame([(float(v),) for v in x], "x double")
    power = best_power(x)
    assert abs(power) > scalers.STEP * scalers.REACH
    assert scalers.powers(frame, ["x"])["x"] == pytest.approx(power, abs=1e-5)


def normal_scores(x, known, rows):
    n = max(1, min(max(10, min(1000, rows)), rows))
    shares = np.linspace(0, 1, n)
    marks = np.percentile(known, shares * 100)
    p = 0.5 * (np.interp(x, marks, shares) - np.interp(-x, -marks[::-1], -shares[::-1]))
    p = np.where(x + 1e-7 > marks[-1], 1, p)
    p = np.where(x - 1e-7 < marks[0], 0, p)
    return [NormalDist().inv_cdf(min(max(v, 1e-7), 1 - 1e-7)) for v in p.tolist()]


@pytest.mark.parametrize("n", [12, 150, 2100])
def test_quantile_scaling(spark, n):
    rows, frame, names = panel(spark, columns(3, n), n)
    got = preprocess.rescaled(frame, names, "quantile_normal").collect()
    quarter = np.array([r[0] for r in rows])
    for j, c in enumerate(names[:-2]):
        x = np.array([np.nan if r[1 + j] is None else r[1 + j] for r in rows])
        known = x[(quarter <= 21) & ~np.isnan(x)]
        own = ~np.isnan(x)
        assert [r[c] for r, k in zip(got, own) if k] == pytest.approx(normal_scores(x[own], known, int((quarter <= 21).sum())), abs=1e-6)
        assert all(r[c] is None for r, k in zip(got, own) if not k)
    assert {(r["same"], r["nothing"]) for r in got} == {(0.0, 0.0)}


def test_normal_scores(spark):
    random.seed(1)
    shares = [1e-7, 1e-5, 0.001, 0.0749, 0.075, 0.5, 0.925, 0.93, 1 - 1e-7, *(random.random() for _ in range(200))]
    got = spark.createDataFrame([(p,) for p in shares], "p double").select(scalers.normal_score(F.col("p"))).collect()
    assert [r[0] for r in got] == pytest.approx([NormalDist().inv_cdf(p) for p in shares], rel=1e-12, abs=1e-14)
    far = spark.createDataFrame([(1e-20,)], "p double").select(scalers.normal_score(F.col("p"))).first()[0]
    assert far == pytest.approx(NormalDist().inv_cdf(1e-20), rel=1e-12)


def test_empty_and_named_strategies(spark):
    none = spark.createDataFrame([], "quarter_idx int, x double")
    assert preprocess.rescaled(none, ["x"], "power").count() == 0
    assert preprocess.rescaled(none, ["x"], "quantile_normal").count() == 0
    assert [scalers.chosen(s) for s in ("StandardScaler", "RobustScaler", "QuantileTransformer(candidate) / RobustScaler(baseline)", "PowerTransformer", "QuantileTransformer", "MinMaxScaler")] == ["standard", "robust", "robust", "power", "quantile_normal", "minmax"]


def test_power_scaling_computes_its_panel_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    rows = [(1 + k % 20, float(k * k)) for k in range(200)]
    panel = spark.createDataFrame(rows, "quarter_idx int, x double").mapInPandas(counted, "quarter_idx int, x double")
    assert preprocess.rescaled(panel, ["x"], "power").count() == 200
    assert preprocess.rescaled(panel, ["x"], "power").agg(F.sum("x")).first()[0] == pytest.approx(0, abs=1e-8)
    assert seen.value == 400
