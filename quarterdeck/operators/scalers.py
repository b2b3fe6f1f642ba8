"""Scalers fitted on the training quarters that change a column's shape: Yeo-Johnson power, and quantile to normal.

Fits go through the driver as numbers for each column (a power, or up to 1,000 landmarks), never as rows; what is fitted is
applied as column expressions.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.functions.order import number_until, quantiles, settled

#: First grid of powers: multiples of STEP from -REACH to REACH times it; each pass divides the step by REACH.
STEP, REACH = 0.5, 8
#: Step at which the vertex of a parabola through three likelihoods ends the search.
FINEST = 2e-4
#: Deviation, as a share of the mean, below which a transformed column is rounding noise.
NOISE = 1e-10
LEAST_LANDMARKS, MOST_LANDMARKS = 10, 1000
#: Shares nearer to 0 and 1 than this are clipped before the normal score.
EDGE = 1e-7

# Coefficients of algorithm AS 241 (Wichura 1988), highest power first, numerator and denominator of its three ranges.
CENTRAL = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
MIDDLE = (
    (7.7454501427834140764e-4, 2.27238449892691845833e-2, 2.4178072517745061177e-1, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 1.51986665636164571966e-2, 1.4810397642748007459e-1, 6.8976733498510000455e-1, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.2426609473880784386e-3, 2.65321895265761230930e-2, 2.9656057182850489123e-1, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 1.48753612908506148525e-2, 1.3692988092273580531e-1, 5.9983220655588793769e-1, 1.0),
)


def yeo_johnson(x: Column, power: Column) -> Column:
    """The power transform of any sign; null for null."""
    up, down = F.log1p(F.greatest(x, F.lit(0.0))), F.log1p(F.greatest(-x, F.lit(0.0)))
    above = F.when(power == 0, up).otherwise(F.try_divide(F.expm1(power * up), power))
    below = F.when(power == 2, down).otherwise(F.try_divide(F.expm1((2 - power) * down), 2 - power))
    return F.when(x >= 0, above).when(x < 0, -below)


def powers(rows: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The power of each column of largest likelihood; None where a column has no two different values.

    A pass sums the likelihoods of 17 powers a column; the next one looks closer around the best, or beyond it where that is the
    last of the grid. The likelihood's top is that of a parabola at the end."""
    spark = rows.sparkSession
    ends = rows.agg(*(F.min(c).alias(f"{i}_low") for i, c in enumerate(columns)), *(F.max(c).alias(f"{i}_high") for i, c in enumerate(columns))).first()
    varied = [i for i in range(len(columns)) if ends[f"{i}_low"] is not None and ends[f"{i}_low"] < ends[f"{i}_high"]]
    found: dict[str, float | None] = dict.fromkeys(columns)
    if not varied:
        return found
    long = settled(rows.select(F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.col(columns[i]).cast("double").alias("x")) for i in varied)))).where("x IS NOT NULL"))
    open_ = {i: (0.0, STEP) for i in varied}
    while open_:
        grid = [(i, k, centre + k * step) for i, (centre, step) in open_.items() for k in range(-REACH, REACH + 1)]
        tried = long.join(F.broadcast(spark.createDataFrame(grid, "i int, k int, power double")), "i")  # 17 rows a column
        y = yeo_johnson(F.col("x"), F.col("power"))
        sums = tried.groupBy("i", "k", "power").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("var"), F.sum(F.signum("x") * F.log1p(F.abs("x"))).alias("logs"))
        usable = (F.sqrt("var") > NOISE * F.abs("mean")) & (F.col("var") < float("inf"))
        by = {(r["i"], r["k"]): r["fit"] for r in sums.select("i", "k", F.when(usable, -F.col("n") / 2 * F.ln("var") + (F.col("power") - 1) * F.col("logs")).alias("fit")).collect()}
        ahead = {}
        for i, (centre, step) in open_.items():
            fits = {k: by[i, k] for k in range(-REACH, REACH + 1) if by.get((i, k)) is not None}
            if not fits:
                found[columns[i]] = 1.0
                continue
            best = max(fits, key=lambda k: (fits[k], -abs(k)))
            if abs(best) == REACH and abs(centre) < 1000 * STEP:
                ahead[i] = (centre + best * step, step)
            elif step / REACH >= FINEST:
                ahead[i] = (centre + best * step, step / REACH)
            else:
                left, top, right = fits.get(best - 1), fits[best], fits.get(best + 1)
                bend = left - 2 * top + right if left is not None and right is not None else 0.0
                found[columns[i]] = centre + best * step + (step * (left - right) / (2 * bend) if bend < 0 else 0.0)
        open_ = ahead
    long.unpersist()
    return found


def power_scaled(panel: DataFrame, columns: list[str], train: DataFrame) -> DataFrame:
    """panel with columns of largest normal likelihood on train, standardised there; a constant training column becomes 0."""
    fitted = powers(train, columns)
    used = [c for c in columns if fitted[c] is not None]
    values = {c: yeo_johnson(F.col(c).cast("double"), F.lit(fitted[c])) for c in used}
    moments = train.agg(F.lit(0).alias("_one"), *(F.avg(values[c]).alias(f"{c}__mean") for c in used), *(F.stddev_pop(values[c]).alias(f"{c}__std") for c in used))
    scaled = {c: (values[c] - F.col(f"{c}__mean")) / F.when(F.col(f"{c}__std") > 0, F.col(f"{c}__std")).otherwise(1.0) for c in used}
    out = panel.crossJoin(F.broadcast(moments))  # one row
    return out.withColumns({c: scaled.get(c, F.lit(0.0)) for c in columns}).select(*panel.columns)


def normal_score(p: Column) -> Column:
    """The standard normal quantile of a share between 0 and 1."""

    def ratio(pair, r: Column) -> Column:
        top, bottom = (F.aggregate(F.array(*map(F.lit, row)), F.lit(0.0), lambda a, c: a * r + c) for row in pair)
        return top / bottom

    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.signum(q) * F.when(r <= 5, ratio(MIDDLE, r - 1.6)).otherwise(ratio(FAR, r - 5))
    return F.when(F.abs(q) <= 0.425, q * ratio(CENTRAL, 0.180625 - q * q)).otherwise(tail)


def share_below(landmarks: Column, n: int, x: Column) -> Column:
    """Share of the training values below x by linear interpolation between landmarks; the middle of its range for a tie."""
    if n == 1:
        return F.when(x.isNotNull(), F.lit(0.5))
    upto, below, last = number_until(landmarks, n, x, True), number_until(landmarks, n, x, False), n - 1
    place = F.struct(upto.alias("upto"), below.alias("below"))

    def share(at: Column) -> Column:
        low, high = F.get(landmarks, at["upto"] - 1), F.get(landmarks, at["upto"])
        inside = (at["upto"] - 1 + F.try_divide(x - low, high - low)) / last
        return F.when(at["upto"] > at["below"], (at["below"] + at["upto"] - 1) / 2 / last).otherwise(inside)

    found = F.element_at(F.transform(F.array(place), share), 1)  # the places are found once
    return F.when(x - EDGE < F.get(landmarks, F.lit(0)), 0.0).when(x + EDGE > F.get(landmarks, F.lit(n - 1)), 1.0).otherwise(found)


def quantile_scaled(panel: DataFrame, columns: list[str], train: DataFrame) -> DataFrame:
    """panel with columns as normal scores of their place among the training values; a constant training column becomes 0.

    Landmarks are exact quantiles of all training rows, 10 to 1,000 of them by the number of rows; scores end at those of EDGE."""
    rows = train.count()
    n = max(1, min(max(LEAST_LANDMARKS, min(MOST_LANDMARKS, rows)), rows))
    found = quantiles(train, columns, tuple(k / max(n - 1, 1) for k in range(n))).withColumnsRenamed({c: f"{c}__marks" for c in columns})
    # a column of its own for what the next step names often
    out = panel.crossJoin(F.broadcast(found))  # one row
    out = out.withColumns({f"{c}__share": share_below(F.col(f"{c}__marks"), n, F.col(c).cast("double")) for c in columns})
    values = {}
    for c in columns:
        score = normal_score(F.least(F.greatest(F.col(f"{c}__share"), F.lit(EDGE)), F.lit(1 - EDGE)))
        constant = F.coalesce(F.get(f"{c}__marks", F.lit(0)) == F.get(f"{c}__marks", F.lit(n - 1)), F.lit(True))
        values[c] = F.when(constant, 0.0).when(F.col(c).isNotNull(), score)
    return out.withColumns(values).select(*panel.columns)


def chosen(strategy: str) -> str:
    """The scaler that a recommended strategy names."""
    names = (("RobustScaler", "robust"), ("MinMaxScaler", "minmax"), ("PowerTransformer", "power"), ("QuantileTransformer", "quantile_normal"))
    return next((how for name, how in names if name in strategy), "standard")
