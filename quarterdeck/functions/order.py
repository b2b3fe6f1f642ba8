"""Exact ranks, prefix sums and quantiles of groups too large for one task.

Groups of at most ROWS_IN_TASK rows, by their count, are sorted in a task each. Beyond, approximate percentiles cut the values of a group into cells, and the counts of the cells make the result exact, whatever the
cuts are. Windows then run inside a cell, and a value that fills a cell alone, however often it stands, needs none. Quantiles
take cells at every size and run no job of their own; for ranks and prefix sums a count decides, and the cuts go through the driver:
some numbers for each group (a quarter, or a quarter and feature).
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

#: Rows of a group that one task sorts; larger groups are cut into cells, with the same results.
ROWS_IN_TASK = 1_000_000
CUTS = 256
ACCURACY = 10_000
_GRID = [i / CUTS for i in range(CUTS + 1)]
_NULLS = 2 * CUTS + 4  # the cell after all others


def settled(rows: DataFrame) -> DataFrame:
    """rows computed once, since sums of doubles may differ in their last digits when they are computed again."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows.persist()


def _same(pairs) -> F.Column:
    return reduce(lambda a, b: a & b, (F.col(a).eqNullSafe(F.col(b)) for a, b in pairs), F.lit(True))


def _fits_a_task(rows: DataFrame, group: list[str]) -> bool:
    largest = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (largest or 0) <= ROWS_IN_TASK


def _with_tie_number(rows: DataFrame, group: list[str], tie: str) -> DataFrame:
    """_tie: a number that never falls as the tie rises. That of a text is made of its six bytes after those that all texts of the group begin with."""
    if isinstance(rows.schema[tie].dataType, NumericType):
        return rows.withColumn("_tie", F.col(tie).cast("double"))
    keys, raw = [f"_t{i}" for i in range(len(group))], F.col(tie).cast("binary")
    ends = rows.groupBy(*(F.col(g).alias(k) for g, k in zip(group, keys))).agg(F.min(tie).cast("binary").alias("_low"), F.max(tie).cast("binary").alias("_high"))
    shared = F.filter(F.sequence(F.lit(0), F.octet_length("_low")), lambda i: F.substring(F.col("_low"), F.lit(1), i) == F.substring(F.col("_high"), F.lit(1), i))
    ends = ends.select(*keys, F.coalesce(F.size(shared) - 1, F.lit(0)).alias("_skip"))
    out = rows.join(F.broadcast(ends), _same(zip(group, keys))).drop(*keys)  # a row per group
    number = F.conv(F.rpad(F.hex(F.substring(raw, F.col("_skip") + 1, F.lit(6))), 12, "0"), 16, 10).cast("double")
    return out.withColumn("_tie", number).drop("_skip")


def celled(rows: DataFrame, group: list[str], value: str, tie: str | None = None) -> DataFrame:
    """rows with _cell and _sub (ordered by value, then, inside one value, by a numeric or text tie), _alone (the cell holds one value), and
    _before, _sum_before, _size (rows and sum of value in earlier cells of the group, rows in this), _n, _total (known values of the group, their sum).

    Null values share the last cell; null groups are a group."""
    rows, keys = settled(rows), [f"_g{i}" for i in range(len(group))]
    x = F.col(value).cast("double")
    if _fits_a_task(rows, group):  # one cell for all values and one for the nulls
        own = Window.partitionBy(*group)
        rows = rows.withColumns({"_n": F.count(x).over(own), "_total": F.coalesce(F.sum(x).over(own), F.lit(0.0)), "_size": F.count(F.lit(1)).over(own), "_cell": x.isNull().cast("int"), "_sub": F.lit(0)})
        return rows.withColumns({"_alone": F.lit(False), "_before": F.when(x.isNull(), F.col("_n")).otherwise(F.lit(0)), "_sum_before": F.lit(0.0)})
    given = tie is not None and isinstance(rows.schema[tie].dataType, (NumericType, StringType))
    if given:
        rows = _with_tie_number(rows, group, tie)
    ties = F.percentile_approx("_tie", _GRID, ACCURACY) if given else F.lit(None).cast("array<double>")
    cuts = rows.groupBy(*(F.col(g).alias(k) for g, k in zip(group, keys))).agg(F.array_distinct(F.percentile_approx(x, _GRID, ACCURACY)).alias("_cuts"), F.array_distinct(ties).alias("_ties"))
    cuts = rows.sparkSession.createDataFrame(cuts.collect(), cuts.schema)
    out = rows.join(F.broadcast(cuts), _same(zip(group, keys))).drop(*keys)  # a row per group
    on_cut = F.array_contains("_cuts", x)
    cell = 2 * F.size(F.filter("_cuts", lambda c: c < x)) + on_cut.cast("int")
    out = out.withColumns({"_alone": F.coalesce(on_cut, F.lit(True)), "_cell": F.when(x.isNull(), _NULLS).otherwise(cell)})
    sub = F.when(F.col("_alone") & F.col("_ties").isNotNull(), F.size(F.filter("_ties", lambda c: c < F.col("_tie")))) if given else F.lit(0)
    out = out.withColumn("_sub", F.coalesce(sub, F.lit(0))).drop("_cuts", "_ties", "_tie")
    sizes = out.groupBy(*(F.col(g).alias(k) for g, k in zip(group, keys)), F.col("_cell").alias("_c"), F.col("_sub").alias("_s")).agg(F.count(F.lit(1)).alias("_size"), F.count(x).alias("_known"), F.coalesce(F.sum(x), F.lit(0.0)).alias("_sum"))
    own = Window.partitionBy(*keys)  # a row per cell
    earlier = own.orderBy("_c", "_s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *keys, "_c", "_s", "_size", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_sum_before"),
        F.sum("_known").over(own).alias("_n"), F.sum("_sum").over(own).alias("_total"),
    )
    return out.join(F.broadcast(sizes), _same([*zip(group, keys), ("_cell", "_c"), ("_sub", "_s")])).drop(*keys, "_c", "_s")


def _without(rows: DataFrame) -> DataFrame:
    return rows.drop("_cell", "_sub", "_alone", "_before", "_sum_before", "_size", "_n", "_total", "_salt")


def _in_cell(rows: DataFrame, group: list[str]) -> tuple[DataFrame, Window]:
    """rows with _salt, and the window of a cell; rows of one value, which need no order, are dealt to many windows."""
    salted = rows.withColumn("_salt", F.when(F.col("_alone"), F.pmod(F.xxhash64(*rows.columns), F.lit(1024))).otherwise(F.lit(0)))
    return salted, Window.partitionBy(*group, "_cell", "_salt")


def with_average_rank(rows: DataFrame, value: str, group: list[str], name: str, pct: bool = False) -> DataFrame:
    """name: rank of value within the group from the smallest, the mean of their places for ties, null for null; pct: as a share of the known values."""
    cells, own = _in_cell(celled(rows, group, value), group)
    inside = F.rank().over(own.orderBy(value)) + (F.count(F.lit(1)).over(own.partitionBy(*group, "_cell", "_salt", value)) - 1) / 2
    place = F.col("_before") + F.when(F.col("_alone"), (F.col("_size") + 1) / 2).otherwise(inside)
    return _without(cells.withColumn(name, F.when(F.col(value).isNotNull(), place / F.col("_n") if pct else place)))


def with_ordinal(rows: DataFrame, value: str, tie: str, group: list[str], name: str, size: str | None = None) -> DataFrame:
    """name: place from 1 by value from the largest, then by tie from the smallest; nulls last. size: number of known values of the group."""
    cells = celled(rows.withColumn("_down", -F.col(value)), group, "_down", tie)
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*group, "_cell", "_sub").orderBy("_down", tie))
    return _without(cells.withColumns({name: place, **({size: F.col("_n")} if size else {})})).drop("_down")


def with_prefix(rows: DataFrame, value: str, group: list[str], count: str, total: str) -> DataFrame:
    """count and total: rows and sum of value before the row in the order of value, plus _n and _total of the group.

    Of equal values some may count as before the others or not, alike in both columns; value * count - total is the same either way."""
    cells, own = _in_cell(celled(rows, group, value), group)
    before = own.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.when(F.col("_alone"), 0).otherwise(F.count(F.lit(1)).over(before))
    within = F.when(F.col("_alone"), 0.0).otherwise(F.coalesce(F.sum(value).over(before), F.lit(0.0)))
    return cells.withColumns({count: F.col("_before") + inside, total: F.col("_sum_before") + within}).drop("_cell", "_sub", "_alone", "_before", "_sum_before", "_size", "_salt")


def number_until(marks: Column, n: int, x: Column, equal: bool) -> Column:
    """How many of at most n sorted marks lie below x (or at it, if equal), by halving steps."""
    steps = [1 << k for k in reversed(range(n.bit_length()))]

    def further(at: Column, step: Column) -> Column:
        mark = F.get(marks, at + step - 1)
        return F.when(F.coalesce(mark <= x if equal else mark < x, F.lit(False)), at + step).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def _ranks(wanted: list[tuple[float, bool]], j: Column) -> tuple[Column, Column, Column]:
    """Of the j-th wanted (fraction, filled): its place from 0 between two ranks, and those ranks among the _n values; a rank that one of the _z filled nulls holds is null.

    A null filled by the median stands behind the lower of the two values around the middle."""
    p = F.get(F.expr(f"array({', '.join(f'{float(p)!r}D' for p, _ in wanted)})"), j)
    filled = F.get(F.expr(f"array({', '.join(str(f) for _, f in wanted)})"), j)
    place = (F.col("_n") + F.when(filled, F.col("_z")).otherwise(0) - 1) * p
    behind = F.floor((F.col("_n") - 1) / 2) + 1

    def rank(k: Column) -> Column:
        return F.when(~filled | (k < behind), k).when(k >= behind + F.col("_z"), k - F.col("_z"))

    return place, rank(F.floor(place)), rank(F.ceil(place))


def quantiles(rows: DataFrame, columns: list[str], fractions: tuple[float, ...], group: tuple[str, ...] = (), filled: tuple[float, ...] = ()) -> DataFrame:
    """One row per group (one at all without): for each column the array of its quantiles, linear between neighbours, null without values.

    filled: fractions behind the others, of the column with its nulls at its median. The result is a plan without a job of its own. It passes over
    rows three times: approximate percentiles cut each column into cells, counts of the cells tell those that hold a wanted rank, and the
    values of these alone are counted by value and ordered inside their cell, a CUTS-th of the group at most but for a value that fills a
    cell by itself and is one counted row. The cuts may differ each time they are computed, so the last pass takes the ends of its cells from the counted
    ones. rows must hold the same values each time it is computed; else the query may end with an error that says so."""
    keys, xs = [f"_g{i}" for i in range(len(group))], range(len(columns))
    asked = [*((p, False) for p in fractions), *((p, True) for p in filled)]
    wanted = sorted({*asked, *([(0.5, False)] if filled else [])})
    last = len(wanted) - 1
    data = rows.select(*(F.col(g).alias(k) for g, k in zip(group, keys)), *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)))
    none = F.array().cast("array<double>")
    cuts = data.groupBy(*keys).agg(*(F.coalesce(F.array_distinct(F.percentile_approx(f"_x{i}", _GRID, ACCURACY)), none).alias(f"_c{i}") for i in xs))

    def beside(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
        renamed = F.broadcast(right.withColumnsRenamed({k: f"{k}_" for k in names}))
        return left.join(renamed, _same((k, f"{k}_") for k in names), how).drop(*(f"{k}_" for k in names))

    near = beside(data, cuts, keys) if keys else data.crossJoin(F.broadcast(cuts))  # a row per group
    cell = {i: number_until(F.col(f"_c{i}"), len(_GRID), F.col(f"_x{i}"), False) for i in xs}
    placed = near.select(*keys, *(F.when(F.col(f"_x{i}").isNull(), -1).otherwise(cell[i]).alias(f"_k{i}") for i in xs), *(f"_c{i}" for i in xs))
    ends = {i: [F.get(f"_c{i}", F.col(f"_k{i}") - 1).alias("_low"), F.when(F.col(f"_k{i}") >= 0, F.get(f"_c{i}", f"_k{i}")).alias("_high")] for i in xs}
    placed = placed.select(*keys, F.inline(F.array(*(F.struct(F.lit(i).alias("_i"), F.col(f"_k{i}").alias("_cell"), *ends[i]) for i in xs))))
    own = Window.partitionBy(*keys, "_i")  # a row per cell
    known = F.when(F.col("_cell") >= 0, F.col("_m")).otherwise(0)
    counts = placed.groupBy(*keys, "_i", "_cell").agg(F.count(F.lit(1)).alias("_m"), F.first("_low").alias("_low"), F.first("_high").alias("_high"))
    counts = counts.withColumns({
        "_before": F.coalesce(F.sum(known).over(own.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_n": F.sum(known).over(own), "_z": F.sum(F.col("_m") - known).over(own),
    })

    def held(j: Column, low: Column, high: Column) -> Column:
        _, a, b = _ranks(wanted, j)
        return F.coalesce((a >= low) & (a < high), F.lit(False)) | F.coalesce((b >= low) & (b < high), F.lit(False))

    inside = F.filter(F.sequence(F.lit(0), F.lit(last)), lambda j: held(j, F.col("_before"), F.col("_before") + F.col("_m")))
    places = counts.where("_cell >= 0").withColumn("_js", inside).where(F.size("_js") > 0)
    spans, carried = [*keys, "_i", "_cell"], ("_before", "_n", "_z", "_from", "_to")
    places = places.withColumns({"_from": F.array_min("_js"), "_to": F.array_max("_js")})
    places = places.groupBy(*keys, "_i").agg(F.sort_array(F.collect_list(F.struct("_cell", "_low", "_high", *carried))).alias("_places"))
    places = places.withColumn("_highs", F.transform("_places", lambda p: p["_high"]))
    long = data.select(*keys, F.inline(F.array(*(F.struct(F.lit(i).alias("_i"), F.col(f"_x{i}").alias("_x")) for i in xs)))).where("_x IS NOT NULL")
    values = beside(long, places, [*keys, "_i"])  # a row per group and column, of the cells that hold a wanted rank
    near_by = F.array(F.get("_places", number_until(F.col("_highs"), min(len(_GRID) + 1, 2 * len(wanted)), F.col("_x"), False)))
    held_by = F.filter(near_by, lambda p: p.isNotNull() & F.coalesce(F.col("_x") > p["_low"], F.lit(True)))
    values = values.select(*keys, "_i", "_x", F.inline(held_by))
    values = values.groupBy(*spans, "_x").agg(F.count(F.lit(1)).alias("_m"), *(F.max(c).alias(c) for c in carried))
    values = values.withColumn("_end", F.col("_before") + F.sum("_m").over(Window.partitionBy(*spans).orderBy("_x")))

    def slots(j: Column) -> Column:  # j for the lower rank, the next number after all j for the upper
        _, a, b = _ranks(wanted, j)
        hit = [F.coalesce((k >= F.col("_end") - F.col("_m")) & (k < F.col("_end")), F.lit(False)) for k in (a, b)]
        return F.array(F.when(hit[0], j), F.when(hit[1], j + last + 1))

    found = values.select(*keys, "_i", "_x", "_n", "_z", F.explode(F.array_compact(F.flatten(F.transform(F.sequence("_from", "_to"), slots)))).alias("_slot"))
    found = found.groupBy(*keys, "_i").agg(F.max("_n").alias("_n"), F.max("_z").alias("_z"), F.map_from_entries(F.collect_list(F.struct("_slot", "_x"))).alias("_at"))
    changed = F.raise_error(F.lit("a wanted rank is gone: the rows of these quantiles differ each time they are computed")).cast("double")

    def value(j: Column, median: Column) -> Column:
        place, *ranks = _ranks(wanted, j)
        a, b = (F.when(k.isNull(), median).otherwise(F.coalesce(F.element_at("_at", slot), changed)) for k, slot in zip(ranks, (j, j + last + 1)))
        low, high = F.floor(place), F.ceil(place)
        return F.when((low == high) | (a == b), a).otherwise((high - place) * a + (place - low) * b)

    at = {q: j for j, q in enumerate(wanted)}
    if filled:
        found = found.withColumn("_median", value(F.lit(at[0.5, False]), F.lit(None).cast("double")))
    median = F.col("_median") if filled else F.lit(None).cast("double")
    order = F.expr(f"array({', '.join(str(at[q]) for q in asked)})")
    found = found.select(*keys, "_i", F.transform(order, lambda j: value(j, median)).alias("_q"))
    out = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_q"))).alias("_of"))
    if keys:  # groups without any value too; the cuts are asked again, so that Spark reads them from the same shuffle
        out = beside(cuts, out, keys, "left")
    has = {i: F.size(f"_c{i}") > 0 if keys else F.lit(True) for i in xs}
    return out.select(*(F.col(k).alias(g) for k, g in zip(keys, group)), *(F.when(has[i], F.element_at("_of", F.lit(i))).alias(c) for i, c in enumerate(columns)))
