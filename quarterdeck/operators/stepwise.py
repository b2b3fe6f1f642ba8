"""Rolling forward stepwise regression on macro by micro composites, from mergeable moments per quarter.

Within a quarter a macro value is constant, so every moment of a composite z_i * m_j is a moment of the z
times products of the m. One aggregation over the entity factors alone (not over their composites) gives all
that the selection needs: means and centred co-moments, which Spark merges pairwise. A window's are merged from its
quarters' in the same way, so large means cost no digits. The solve for each target quarter is small and of a size that
does not depend on the number of entities; it factorises step by step and squares no condition number.

A composite that is null takes the window's median of that composite: moments of the null marks, which merge
too, let the moments be corrected for any fill, and only the medians (fills()) need another pass, where there are nulls.

A target quarter is solved once: fits() has every step's terms, and the log and the final models are rows of it.
"""

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.functions.order import ROWS_IN_TASK, quantiles, with_average_rank
from quarterdeck.functions.stats import average_rank, correlation

TERM = "feature string, place int, stock_factor string, macro_factor string, mean double, std double, fill double, beta double, intercept double"
STEP = "train_r2 double, selection_abs_corr double, sse_improvement double"
#: A row for each target quarter, step and term of its fit; last marks the final step (0 where nothing was selected).
FITS = f"quarter_idx int, window_start int, window_end int, step int, last boolean, {TERM}, {STEP}"
#: Share of a composite's variance that must be left beside those selected; below, it is theirs, and is null to the fit.
INDEPENDENT = 1e-10


@dataclass(frozen=True)
class Knobs:
    window: int = 12
    max_features: int = 15
    min_improvement: float = 1e-6
    min_abs_corr: float = 0.0
    least_rows: int = 20


def catalogue(factors: list[str], macro: list[str]) -> list[tuple[str, str, str]]:
    """(composite, factor, macro series), in order."""
    return [(f"composite_{f}__{m}", f, m) for f in factors for m in macro]


def moments(panel: DataFrame, factors: list[str], macro: list[str], label: str) -> DataFrame:
    """One row per quarter, over labelled rows: n, means of y and v, population covariances of v with y and with each other, variance of y,
    where v are the factors (0 for null) and, after them, their null marks; and the quarter's macro values."""
    rows = panel.where(F.col(label).isNotNull())
    y = F.col(label).cast("double")
    v = [*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in factors), *(F.col(f).isNull().cast("double") for f in factors)]
    upper = [(i, j) for i in range(len(v)) for j in range(i, len(v))]
    return rows.groupBy("quarter_idx").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(y).alias("my"), F.var_pop(y).alias("cyy"), F.array(*(F.avg(x) for x in v)).alias("mv"), F.array(*(F.covar_pop(x, y) for x in v)).alias("cvy"),
        F.array(*(F.covar_pop(v[i], v[j]) for i, j in upper)).alias("cvv"), F.array(*(F.first(m) for m in macro)).alias("m"),
    )


def fills(panel: DataFrame, targets: DataFrame, factors: list[str], macro: list[str], label: str, window: int) -> DataFrame:
    """(target, fill): the median of each composite over the labelled rows of the target's window; 0 if all are null.

    The medians are ranks over cells of values, so that no window is sorted in one task when it is large."""
    names = [x for x, _, _ in catalogue(factors, macro)]
    values = {n: F.col(f) * F.col(m) for n, f, m in catalogue(factors, macro)}
    rows = _windows(panel.where(F.col(label).isNotNull()), targets, window).select("target", *(values[n].alias(n) for n in names))
    medians = quantiles(rows, names, (0.5,), ("target",))
    return medians.select("target", F.array(*(F.coalesce(F.get(n, F.lit(0)), F.lit(0.0)) for n in names)).alias("fill"))


@dataclass
class Sums:
    """n, means of all composites and of y, and centred sums: of composites with each other and with y, and of y."""

    n: float
    mean: np.ndarray
    my: float
    cc: np.ndarray
    cy: np.ndarray
    yy: float

    def merged(self, other: "Sums") -> "Sums":
        n, dc, dy = self.n + other.n, other.mean - self.mean, other.my - self.my
        share = self.n * other.n / n
        return Sums(n, self.mean + dc * other.n / n, self.my + dy * other.n / n, self.cc + other.cc + np.outer(dc, dc) * share, self.cy + other.cy + dc * dy * share, self.yy + other.yy + dy * dy * share)


def expanded(row: pd.Series, p: int, fill: np.ndarray) -> Sums:
    """A quarter's moments of all composites, filled where null: z * m + u * fill for factor z, its null mark u, and macro value m."""
    m, n = np.asarray(row["m"], float), row["n"]
    mean, cy, cc = np.asarray(row["mv"], float), np.asarray(row["cvy"], float), np.zeros((2 * p, 2 * p))
    cc[np.triu_indices(2 * p)] = row["cvv"]
    cc = cc + np.triu(cc, 1).T
    one = np.ones(len(m))

    def composites(z: np.ndarray, u: np.ndarray) -> np.ndarray:
        return np.kron(z, m) + fill * np.kron(u, one)

    square = np.kron(cc[:p, :p], np.outer(m, m))
    if np.any(mean[p:]):
        cross = fill[:, None] * np.kron(cc[p:, :p], np.outer(one, m))
        square = square + cross + cross.T + np.outer(fill, fill) * np.kron(cc[p:, p:], np.outer(one, one))
    return Sums(n, composites(mean[:p], mean[p:]), row["my"], n * square, n * composites(cy[:p], cy[p:]), n * row["cyy"])


@dataclass
class Selection:
    """steps: for each one the pick, the coefficients of all picks so far, and its measures; picks: all of them, in order."""

    steps: list[dict]
    picks: list[int]
    mean: np.ndarray
    std: np.ndarray


def select(sums: Sums, knobs: Knobs) -> Selection:
    """Forward selection on one window's moments.

    A step takes the candidate whose correlation with the residual is largest in size (the first of equals), refits on all
    picks, and ends the selection if the squared error falls by too small a share. The refit adds a column to a triangular
    factor of the picks' covariance and takes its part from all other columns; a candidate that the picks explain adds nothing."""
    n = sums.n
    var = np.maximum(np.diag(sums.cc) / n, 0)
    std = np.where(np.sqrt(var) < 1e-12, 1.0, np.sqrt(var))
    left, against = sums.cc / n / np.outer(std, std), sums.cy / n / std
    own, total = np.diag(left).copy(), sums.yy / n
    factor = np.zeros((0, len(std)))  # rows of the triangular factor, over all columns
    shares, picks, steps, sse = np.zeros(0), [], [], total
    while len(picks) < min(knobs.max_features, len(std)):
        scale = np.sqrt(np.maximum(own, 0) * max(sse, 0.0))
        corr = np.where(scale > 1e-12, np.abs(against) / np.where(scale > 1e-12, scale, 1.0), 0.0)
        corr[picks] = -1.0
        best = int(corr.argmax())
        if corr[best] < knobs.min_abs_corr:
            break
        rest = left[best, best]
        fresh = rest > INDEPENDENT * own[best]
        row = left[best] / np.sqrt(rest) if fresh else np.zeros(len(std))
        share = against[best] / np.sqrt(rest) if fresh else 0.0
        gain = share * share / sse if sse > 1e-12 else 0.0
        if picks and gain < knobs.min_improvement:
            break
        left, against = left - np.outer(row, row), against - row * share
        factor, shares, picks, sse = np.vstack([factor, row]), np.r_[shares, share], [*picks, best], sse - share * share
        beta = np.zeros(len(picks))
        for k in reversed(range(len(picks))):
            pivot = factor[k, picks[k]]
            beta[k] = (shares[k] - factor[k, picks] @ beta) / pivot if pivot else 0.0
        steps.append({"beta": beta, "train_r2": float(1 - sse / total) if total > 1e-12 else None, "selection_abs_corr": float(corr[best]), "sse_improvement": float(gain)})
    return Selection(steps, picks, sums.mean, std)


def _windows(quarterly: DataFrame, targets: DataFrame, window: int) -> DataFrame:
    """The moments of each target's preceding quarters; a row for each quarter and target."""
    return F.broadcast(targets.withColumnRenamed("quarter_idx", "target")).join(quarterly, F.col("quarter_idx").between(F.col("target") - window, F.col("target") - 1))


def fits(quarterly: DataFrame, targets: DataFrame, factors: list[str], macro: list[str], knobs: Knobs, filled: DataFrame | None = None) -> DataFrame:
    """The fit of every step of all target quarters, a row for each term. filled is fills(), needed where factors are null."""
    names, p, columns = catalogue(factors, macro), len(factors), [x.split()[0] for x in FITS.split(", ")]
    given = filled is not None

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        target = int(rows["target"].iloc[0])
        if not given and any(np.any(np.asarray(x)[p:]) for x in rows["mv"]):
            raise ValueError("factors are null: fills() of the windows are needed")
        fill = np.asarray(rows["fill"].iloc[0], float) if given else np.zeros(len(names))
        parts = [expanded(r, p, fill) for _, r in rows.sort_values("quarter_idx").iterrows()]
        sums = reduce(Sums.merged, parts)
        if sums.n < knobs.least_rows:
            return pd.DataFrame(columns=columns)
        found = select(sums, knobs)
        head = {"quarter_idx": target, "window_start": target - knobs.window, "window_end": target - 1, "intercept": sums.my}
        out = []
        for step, fit in enumerate(found.steps, 1):
            measures = {k: fit[k] for k in ("train_r2", "selection_abs_corr", "sse_improvement")}
            for place, (k, b) in enumerate(zip(found.picks, fit["beta"], strict=False), 1):
                out.append({**head, **measures, "step": step, "last": step == len(found.steps), "feature": names[k][0], "place": place, "stock_factor": names[k][1], "macro_factor": names[k][2], "mean": found.mean[k], "std": found.std[k], "fill": fill[k], "beta": b})
        out = out or [{**head, "step": 0, "last": True, "feature": None, "place": 0, "stock_factor": None, "macro_factor": None, "mean": 0.0, "std": 1.0, "fill": 0.0, "beta": 0.0}]
        return pd.DataFrame(out, columns=columns)

    rows = _windows(quarterly, targets, knobs.window)
    if given:
        rows = rows.join(F.broadcast(filled), "target")  # a row for each target
    return rows.groupBy("target").applyInPandas(solve, FITS)


def log_of(fitted: DataFrame) -> DataFrame:
    """The selection log: what each step added, its coefficient at entry and the fit's measures."""
    rows = fitted.where("place = step AND step > 0")
    return rows.select("quarter_idx", "window_start", "window_end", "step", F.col("feature").alias("selected_feature"), F.col("beta").alias("coefficient"), "train_r2", "selection_abs_corr", "sse_improvement")


def models_of(fitted: DataFrame) -> DataFrame:
    """The terms of each quarter's last step."""
    return fitted.where("last")


_TERM = ("place", "feature", "stock_factor", "macro_factor", "mean", "std", "fill", "beta")


def _values(factors: list[str], macro: list[str]):
    """(columns of factor and macro maps by name, function of a term's value over them)."""
    z = F.create_map(*(x for f in factors for x in (F.lit(f), F.col(f))))
    m = F.create_map(*(x for c in macro for x in (F.lit(c), F.col(c))))

    def term(t):
        value = F.coalesce(F.element_at("_z", t["stock_factor"]) * F.element_at("_m", t["macro_factor"]), t["fill"])
        return F.coalesce(t["beta"] * (value - t["mean"]) / t["std"], F.lit(0.0))

    return {"_z": z, "_m": m}, term


def lines(panel: DataFrame, steps: DataFrame, factors: list[str], macro: list[str], window: int) -> DataFrame:
    """Each step's fit as a line in the factors, a row for each target quarter, step and quarter of its window.

    Within a quarter the macro values are constants: c, and for each factor a slope w, and u, what its composites add where it is null."""
    series = panel.groupBy("quarter_idx").agg(*(F.first(m).alias(m) for m in macro))
    terms = steps.where("step > 0").withColumnRenamed("quarter_idx", "target")
    near = terms.join(F.broadcast(series), F.col("quarter_idx").between(F.col("target") - window, F.col("target") - 1))  # a row per quarter
    m = F.element_at(F.create_map(*(x for c in macro for x in (F.lit(c), F.col(c)))), F.col("macro_factor"))
    near = near.withColumns({"_m": m, "_b": F.coalesce(F.col("beta") / F.col("std"), F.lit(0.0))})
    own = {f: (F.col("stock_factor") == f) & F.col("_m").isNotNull() for f in factors}
    fixed = F.col("_b") * F.when(F.col("_m").isNull(), F.col("fill") - F.col("mean")).otherwise(-F.col("mean"))
    return near.groupBy("target", "quarter_idx", "step").agg(
        (F.first("intercept") + F.sum(fixed)).alias("_c"),
        *(F.coalesce(F.sum(F.when(own[f], F.col("_b") * F.col("_m"))), F.lit(0.0)).alias(f"_w_{f}") for f in factors),
        *(F.coalesce(F.sum(F.when(own[f], F.col("_b") * F.col("fill"))), F.lit(0.0)).alias(f"_u_{f}") for f in factors),
    )


def train_rank_ics(panel: DataFrame, steps: DataFrame, factors: list[str], macro: list[str], label: str, window: int) -> DataFrame:
    """(quarter_idx, step, train_rankic): rank correlation of each step's fit with the label over the window's labelled rows.

    A label is ranked once in a window, not once in a step. Windows beyond what a task sorts are ranked by cells."""
    known = panel.where(F.col(label).isNotNull())
    sizes = {r["quarter_idx"]: r["n"] for r in known.groupBy("quarter_idx").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per quarter
    largest = max((sum(n for q, n in sizes.items() if t - window <= q < t) for t in range(min(sizes), max(sizes) + 2)), default=0) if sizes else 0

    def ranked(rows: DataFrame, value: str, group: list[str], name: str) -> DataFrame:
        return with_average_rank(rows, value, group, name) if largest > ROWS_IN_TASK else rows.withColumn(name, average_rank(value, *group))

    fitted = lines(panel, steps, factors, macro, window)
    fitted = fitted.groupBy("target", "quarter_idx").agg(F.collect_list(F.struct(*(c for c in fitted.columns if c not in ("target", "quarter_idx")))).alias("_lines"))
    rows = known.select("quarter_idx", F.col(label).alias("_label"), *factors).join(F.broadcast(fitted), "quarter_idx")  # a row per target and quarter
    rows = ranked(rows, "_label", ["target"], "_y").select("target", "_y", *factors, F.inline("_lines"))
    fit = sum((F.when(F.col(f).isNull(), F.col(f"_u_{f}")).otherwise(F.col(f) * F.col(f"_w_{f}")) for f in factors), F.col("_c"))
    rows = ranked(rows.select("target", "step", "_y", fit.alias("fit")), "fit", ["target", "step"], "_p")
    return rows.groupBy("target", "step").agg(correlation(F.col("_p"), F.col("_y"), least=3).alias("train_rankic")).withColumnRenamed("target", "quarter_idx")


def log_with_rank_ics(log: DataFrame, train: DataFrame, quarterly: DataFrame) -> DataFrame:
    """The log with train_rankic, and valid_rankic_if_available of the validation quarters; quarterly has (quarter_idx, split, rankic)."""
    valid = quarterly.where("split = 'valid'").select("quarter_idx", F.col("rankic").alias("valid_rankic_if_available"))
    return log.join(train, ["quarter_idx", "step"], "left").join(valid, "quarter_idx", "left")


def predicted(panel: DataFrame, models: DataFrame, factors: list[str], macro: list[str]) -> DataFrame:
    """panel rows of the target quarters with prediction, selected features in order and their number."""
    maps, term = _values(factors, macro)
    one = models.groupBy("quarter_idx").agg(F.array_sort(F.collect_list(F.struct(*_TERM))).alias("terms"), F.first("intercept").alias("intercept"))
    rows = panel.join(F.broadcast(one), "quarter_idx").withColumns(maps)  # a row per target quarter

    names = F.filter(F.transform("terms", lambda t: t["feature"]), lambda x: x.isNotNull())
    rows = rows.withColumns({"prediction": F.col("intercept") + F.aggregate("terms", F.lit(0.0), lambda a, t: a + term(t)), "selected_features": F.array_join(names, ";"), "selected_feature_count": F.size(names)})
    return rows.drop("_z", "_m", "terms", "intercept")


def frequency(log: DataFrame) -> DataFrame:
    """How often each feature was selected, with its mean absolute coefficient at entry and mean step."""
    return log.groupBy("selected_feature").agg(F.count(F.lit(1)).alias("selected_count"), F.avg(F.abs("coefficient")).alias("avg_abs_coefficient"), F.avg("step").alias("avg_step"))
