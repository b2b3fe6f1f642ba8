import numpy as np
import pandas as pd
import pytest

from quarterdeck.operators import evaluation, stepwise

Z, M = ["a", "b", "c", "d"], ["m1", "m2", "m3"]


def direct(c, y, knobs):
    """Selection on the rows themselves."""
    mean, std = c.mean(0), c.std(0)
    x = (c - mean) / np.where(std < 1e-12, 1, std)
    picks, residual, out = [], y - y.mean(), []
    sse = (residual**2).sum()
    while len(picks) < knobs.max_features:
        r = np.array([0 if k in picks else abs((x[:, k] * (residual - residual.mean())).mean()) / max(x[:, k].std() * residual.std(), 1e-12) for k in range(x.shape[1])])
        r[picks] = -1
        best = int(r.argmax())
        if r[best] < knobs.min_abs_corr:
            break
        a = np.c_[np.ones(len(y)), x[:, [*picks, best]]]
        beta = np.linalg.lstsq(a, y, rcond=None)[0]
        left = y - a @ beta
        if picks and (sse - (left**2).sum()) / sse < knobs.min_improvement:
            break
        picks.append(best)
        residual, sse = left, (left**2).sum()
        out.append((best, beta[-1]))
    return out, a, beta, mean, std, picks


def test_moments_give_the_same_selection_as_rows(spark):
    rng = np.random.default_rng(3)
    macro = {q: rng.standard_normal(3) for q in range(1, 16)}
    rows = []
    for q in macro:
        for e in range(40):
            z = rng.standard_normal(4)
            y = 2 * z[0] * macro[q][1] - z[2] * macro[q][0] + 0.5 * z[3] * macro[q][2] + rng.standard_normal()
            rows.append((q, e, "train", *map(float, z), *map(float, macro[q]), float(y) if (q + e) % 11 else None))
    df = spark.createDataFrame(rows, "quarter_idx int, entity_id int, split string, a double, b double, c double, d double, m1 double, m2 double, m3 double, y double")
    knobs = stepwise.Knobs(window=12, max_features=5)
    targets = spark.createDataFrame([(13,), (14,), (15,), (1,)], "quarter_idx int")
    sums = stepwise.moments(df, Z, M, "y")
    fitted = stepwise.fits(sums, targets, Z, M, knobs)
    log, models = stepwise.log_of(fitted).orderBy("quarter_idx", "step").collect(), stepwise.models_of(fitted)
    predicted = {(r["quarter_idx"], r["entity_id"]): r for r in stepwise.predicted(df, models, Z, M).collect()}
    names = [c for c, _, _ in stepwise.catalogue(Z, M)]
    assert {r["quarter_idx"] for r in log} == {13, 14, 15}
    for target in (13, 14, 15):
        window = [r for r in rows if target - 12 <= r[0] < target and r[-1] is not None]
        c = np.array([np.kron(r[3:7], r[7:10]) for r in window])
        found, _, beta, mean, std, picks = direct(c, np.array([r[-1] for r in window]), knobs)
        own = [r for r in log if r["quarter_idx"] == target]
        assert [r["selected_feature"] for r in own] == [names[k] for k, _ in found]
        assert [r["coefficient"] for r in own] == pytest.approx([b for _, b in found], abs=1e-9)
        for r in (x for x in rows if x[0] == target):
            x = (np.kron(r[3:7], r[7:10]) - mean) / std
            got = predicted[target, r[1]]
            assert got["selected_features"] == ";".join(names[k] for k in picks)
            assert got["selected_feature_count"] == len(picks)


def test_null_factors_take_the_window_s_median(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for q in range(1, 10):
        macro = rng.standard_normal(3)
        for e in range(40):
            z = rng.standard_normal(4)
            y = 2 * z[0] * macro[1] - z[2] * macro[0] + z[1] * macro[2] + rng.standard_normal()
            z = [None if (k == 1 and rng.random() < 0.5) or rng.random() < 0.05 else float(x) for k, x in enumerate(z)]
            rows.append((q, e, "valid", *z, *map(float, macro), float(y) if (q + e) % 9 else None))
    df = spark.createDataFrame(rows, "quarter_idx int, entity_id int, split string, a double, b double, c double, d double, m1 double, m2 double, m3 double, y double")
    knobs, targets = stepwise.Knobs(window=8, max_features=4), spark.createDataFrame([(9,)], "quarter_idx int")
    sums, filled = stepwise.moments(df, Z, M, "y"), stepwise.fills(df, targets, Z, M, "y", 8)
    with pytest.raises(Exception, match="fills"):
        stepwise.fits(sums, targets, Z, M, knobs).collect()
    steps = stepwise.fits(sums, targets, Z, M, knobs, filled)
    log, models = stepwise.log_of(steps), stepwise.models_of(steps)
    value = np.array([[np.nan if x is None else x for x in r[3:]] for r in rows])
    quarter, y = np.array([r[0] for r in rows]), value[:, 7]
    c = (value[:, :4, None] * value[:, None, 4:7]).reshape(len(rows), -1)
    train = (quarter < 9) & np.isfinite(y)
    c = np.where(np.isnan(c), np.nanmedian(c[train], axis=0), c)
    found, design, beta, mean, std, picks = direct(c[train], y[train], knobs)
    names = [x for x, _, _ in stepwise.catalogue(Z, M)]
    predicted = stepwise.predicted(df, models, Z, M)
    expected = np.c_[np.ones(40), ((c[quarter == 9] - mean) / std)[:, picks]] @ beta
    got = {r["entity_id"]: r["prediction"] for r in predicted.collect()}
    assert [got[e] for e in range(40)] == pytest.approx(expected, abs=1e-9)
    own = evaluation.rank_ic(predicted, "prediction", "y").crossJoin(spark.createDataFrame([("valid",)], "split string"))
    out = stepwise.log_with_rank_ics(log, stepwise.train_rank_ics(df, steps, Z, M, "y", 8), own).orderBy("step").collect()
    assert [(r["selected_feature"], r["coefficient"]) for r in out] == [(names[k], pytest.approx(b, abs=1e-9)) for k, b in found]
    for k, r in enumerate(out):
        a = design[:, : k + 2]
        fit = a @ np.linalg.lstsq(a, y[train], rcond=None)[0]
        assert r["train_rankic"] == pytest.approx(np.corrcoef(pd.Series(fit).rank(), pd.Series(y[train]).rank())[0, 1], abs=1e-9)
    monkeypatch.setattr(stepwise, "ROWS_IN_TASK", 0)
    by_cells = {r["step"]: r["train_rankic"] for r in stepwise.train_rank_ics(df, steps, Z, M, "y", 8).collect()}
    assert by_cells == pytest.approx({r["step"]: r["train_rankic"] for r in out}, abs=1e-9)
    both = np.isfinite(y[quarter == 9])
    valid = np.corrcoef(pd.Series(expected[both]).rank(), pd.Series(y[quarter == 9][both]).rank())[0, 1]
    assert [r["valid_rankic_if_available"] for r in out] == pytest.approx([valid] * len(out), abs=1e-9)


def test_nothing_to_select_predicts_the_mean(spark):
    rows = [(q, e, 0.0, 1.0, float(e)) for q in range(1, 4) for e in range(10)]
    df = spark.createDataFrame(rows, "quarter_idx int, entity_id int, a double, m1 double, y double")
    targets = spark.createDataFrame([(3,)], "quarter_idx int")
    knobs = stepwise.Knobs(window=2, min_abs_corr=0.1)
    models = stepwise.models_of(stepwise.fits(stepwise.moments(df, ["a"], ["m1"], "y"), targets, ["a"], ["m1"], knobs))
    got = stepwise.predicted(df, models, ["a"], ["m1"]).collect()
    assert {r["prediction"] for r in got} == {4.5} and {r["selected_feature_count"] for r in got} == {0}


def test_large_means_and_nearly_equal_composites(spark):
    """Means of a million and two factors that differ in the eighth digit, against least squares on the rows in extended precision."""
    rng = np.random.default_rng(8)
    rows = []
    for q in range(1, 5):
        for e in range(200):
            a, b, c = rng.standard_normal(3)
            rows.append((q, 1e6 + a, 1e6 + a + 1e-3 * b, 1e6 + c, 2.0, 3 * a + 1e-3 * b - c + 0.1 * rng.standard_normal()))
    df = spark.createDataFrame([tuple(map(float, r[1:])) + (r[0],) for r in rows], "a double, b double, c double, m1 double, y double, quarter_idx int")
    targets, knobs = spark.createDataFrame([(5,)], "quarter_idx int"), stepwise.Knobs(window=4, max_features=3)
    fitted = stepwise.fits(stepwise.moments(df, ["a", "b", "c"], ["m1"], "y"), targets, ["a", "b", "c"], ["m1"], knobs)
    got = {r["stock_factor"]: r for r in stepwise.models_of(fitted).collect()}
    x = np.array([[v * r[4] for v in r[1:4]] for r in rows], np.longdouble)
    y = np.array([r[5] for r in rows], np.longdouble)
    mean, std = x.mean(0), x.std(0)
    q = []  # Gram-Schmidt, twice, in extended precision
    z, coefficients = (x - mean) / std, np.zeros(3)
    for k in range(3):
        own = z[:, k].copy()
        for _ in range(2):
            own -= sum((own @ u) * u for u in q) if q else 0
        q.append(own / np.sqrt(own @ own))
    upper = np.array([[z[:, j] @ q[i] for j in range(3)] for i in range(3)], float)
    coefficients = np.linalg.solve(np.triu(upper), np.array([(y - y.mean()) @ u for u in q], float))
    assert [got[f]["beta"] for f in "abc"] == pytest.approx(coefficients.tolist(), rel=1e-5)
    assert [got[f]["mean"] for f in "abc"] == pytest.approx(mean.astype(float).tolist(), rel=1e-14)


def test_a_composite_that_the_picks_explain_adds_nothing(spark):
    rng = np.random.default_rng(9)
    rows = [(q, float(a), 2 * float(a) + 5, float(b), 1.0, float(a + 0.5 * b + 0.1 * e)) for q in (1, 2) for a, b, e in rng.standard_normal((100, 3))]
    df = spark.createDataFrame(rows, "quarter_idx int, a double, b double, c double, m1 double, y double")
    targets = spark.createDataFrame([(3,)], "quarter_idx int")
    fitted = stepwise.fits(stepwise.moments(df, ["a", "b", "c"], ["m1"], "y"), targets, ["a", "b", "c"], ["m1"], stepwise.Knobs(window=2))
    assert [r["selected_feature"] for r in stepwise.log_of(fitted).orderBy("step").collect()] == ["composite_a__m1", "composite_c__m1"]
