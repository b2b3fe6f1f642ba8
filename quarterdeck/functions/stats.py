"""Column expressions for statistics that Spark has no function of its own for; none raises on a constant or empty group."""

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-12


def clean(x: Column) -> Column:
    """Doubles with NaN and infinities as null."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded half away from zero as doubles are in SQL, x * 10**digits being a double too, without a negative zero."""
    x = x.cast("double")
    units = F.abs(x) * F.lit(10.0**digits)
    whole = F.floor(units)
    near = F.when(units < 2.0**52, whole + (units - whole >= 0.5).cast("double")).when(units < float("inf"), units)
    return F.coalesce(F.signum(x) * near / F.lit(10.0**digits), x) + F.lit(0.0)


def _total(x: Column) -> Column:
    """Sum in units of 2**-48 as two sums of integers, null if one of them overflows."""
    units = x * F.lit(2.0**16)
    whole = F.floor(units)
    rest = F.floor((units - whole) * F.lit(2.0**32) + 0.5)
    return (F.try_sum(whole).cast("double") + F.try_sum(rest).cast("double") / F.lit(2.0**32)) / F.lit(2.0**16)


def _within(x: Column, most: float) -> Column:
    return F.greatest(F.max(x), -F.min(x)) < F.lit(most)


def steady_sum(x: Column) -> Column:
    """Sum of doubles that is the same to the last digit in any order of the rows; plain beyond 2**46 and with NaN or infinities."""
    x = x.cast("double")
    return F.coalesce(F.when(_within(x, 2.0**46), _total(x)), F.sum(x))


def steady_avg(x: Column) -> Column:
    return F.try_divide(steady_sum(x), F.count(x))


def steady_stddev(x: Column) -> Column:
    """Sample deviation that is the same to the last digit in any order: whole hundredths are squared and summed as integers, what is left
    beside them by steady sums; plain beyond 2**31 and with NaN or infinities."""
    x = x.cast("double")
    n, units = F.count(x), F.floor(x * 100 + 0.5)
    whole, left = units.cast("decimal(19,0)"), (x - units / F.lit(100.0)) * F.lit(2.0**13)
    squares = F.try_subtract(F.try_multiply(F.try_sum(whole * whole), n.cast("decimal(19,0)")), F.try_multiply(F.try_sum(whole), F.try_sum(whole)))
    crossed = n * _total(units * left) - F.try_sum(units) * _total(left)
    beside = n * _total(left * left) - _total(left) * _total(left)
    spread = F.greatest(squares.cast("double") / 10_000 + crossed / F.lit(50 * 2.0**13) + beside / F.lit(2.0**26), F.lit(0.0))
    exact = F.when(F.min(x) == F.max(x), 0.0).otherwise(F.sqrt(F.try_divide(spread, n * (n - 1.0))))
    return F.when(n > 1, F.coalesce(F.when(_within(x, 2.0**31), exact), F.stddev_samp(x)))


def average_rank(value: str, *group: str) -> Column:
    """Rank within the group, the mean of their places for ties; null for null."""
    own = Window.partitionBy(*group)
    place = F.rank().over(own.orderBy(F.col(value).asc_nulls_last())) + (F.count(F.lit(1)).over(own.partitionBy(*group, value)) - 1) / 2
    return F.when(F.col(value).isNotNull(), place)


def average_rank_pct(value: str, *group: str) -> Column:
    return average_rank(value, *group) / F.count(value).over(Window.partitionBy(*group))


def adjusted_skewness(x: Column) -> Column:
    n, g = F.count(x), F.skewness(x)
    return F.when((n > 2) & (F.stddev_pop(x) > 0), g * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2, F.lit(0)))


def adjusted_kurtosis(x: Column) -> Column:
    n, g = F.count(x), F.kurtosis(x)
    return F.when((n > 3) & (F.stddev_pop(x) > 0), F.try_divide(n - 1.0, (n - 2.0) * (n - 3.0)) * ((n + 1.0) * g + 6))


def correlation(x: Column, y: Column, least: int = 2) -> Column:
    """Pearson correlation over complete pairs; null with too few of them or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    scale = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.count(x) >= least) & (scale > EPS), F.try_divide(F.covar_pop(x, y), scale))


def clipped(x: Column, low: Column, high: Column) -> Column:
    """least and greatest skip nulls, so a null stays null only by the guard."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def scaled(x: Column, mean: Column, std: Column) -> Column:
    """z-score; a deviation below EPS or missing counts as one."""
    return (x - mean) / F.when(std >= EPS, std).otherwise(F.lit(1.0))


def min_max(x: Column, w: WindowSpec) -> Column:
    """0 to 1 within the window; 0.5 where all are equal."""
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high - low < EPS, F.lit(0.5)).otherwise(F.try_divide(x - low, high - low))


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def log1p_or_signed(x: Column, smallest: Column) -> Column:
    """log1p where the column never falls below -1, else the signed form."""
    return F.when(smallest < -1, signed_log1p(x)).otherwise(F.log1p(F.greatest(x, F.lit(-0.999999))))


def split_name(quarter: Column) -> Column:
    return F.when(quarter.between(1, 21), "train").when(quarter.between(22, 25), "valid").when(quarter.between(26, 30), "test").otherwise("unknown")


def grade_number(row: Column, n: Column, grades: int) -> Column:
    """Grade from 0 of a row (from 1) among n; sizes differ by one at most and larger ones are spread."""
    return F.least(F.floor((row - 1) * grades / n), F.lit(grades - 1)).cast("int")


def matches(a: Column, b: Column, absolute: float, relative: float) -> Column:
    return F.abs(a - b) <= absolute + relative * F.abs(b)
