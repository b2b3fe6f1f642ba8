"""Names, types, roles and eligibility of columns: rules on schemas, and small tables of their outcome."""


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens that make a column name return-like, by rule.
RETURN_TOKENS = {
    "mainline": ("涨跌幅", "月平均收益率", "future", "return", "ret", "label", "下一期", "未来"),
    "preprocess": ("平均收益率", "区间涨跌幅", "下一期收益", "未来收益", "future_return", "return", "ret"),
    "panel": ("平均收益率", "下一期收益", "未来收益", "return"),
}
#: Whole names that are return-like besides.
RETURN_NAMES = ("ret", "next_ret")
DUPLICATE = "__dup"


def normalized_names(names: list[str | None]) -> list[str]:
    """Stripped; a first blank is row_id_raw, other blanks empty_col_<place>; repeats get __dup<n>."""
    out, seen = [], {}
    for k, name in enumerate(names):
        name = (name or "").strip()
        if not name or name.startswith("Unnamed"):
            name = "row_id_raw" if k == 0 else f"empty_col_{k}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}{DUPLICATE}{seen[name] - 1}")
    return out


def is_return_like(name: str, rule: str = "mainline") -> bool:
    return any(t in name.lower() for t in RETURN_TOKENS[rule])


def role(name: str, id_column: str, name_column: str, label: str) -> str:
    """id, meta, label, return_like or factor, by the first rule that applies."""
    if name in (id_column, "security_code", "row_id_raw"):
        return "id"
    if name in (name_column, "sheet_name", "quarter_idx"):
        return "meta"
    if name == label:
        return "label"
    return "return_like" if is_return_like(name, "panel") or name.lower() in RETURN_NAMES else "factor"


def safe_names(names: list[str], fixed: dict[str, str], roles: dict[str, str]) -> dict[str, str]:
    """Fixed names where given, else factor_001 or return_like_001 by one counter; a name that is taken gets _2, _3."""
    out, used, n = {}, set(), 0
    for name in names:
        safe = fixed.get(name)
        if safe is None:
            n += 1
            safe = f"{'return_like' if roles[name] == 'return_like' else 'factor'}_{n:03d}"
        base, k = safe, 1
        while safe in used:
            k += 1
            safe = f"{base}_{k}"
        used.add(safe)
        out[name] = safe
    return out


def ordered(*names: list[str]) -> list[str]:
    """All names, each once, in the order in which they come first: the columns of a projection."""
    return list(dict.fromkeys(n for some in names for n in some))


def eligibility(df: DataFrame, meta: set[str], macro: set[str]) -> list[tuple[str, bool, str]]:
    """(column, included, reason) by the first rule that applies."""
    out = []
    for field in df.schema.fields:
        if field.name in meta:
            reason = "meta_or_return"
        elif is_return_like(field.name):
            reason = "return_like"
        elif not isinstance(field.dataType, T.NumericType):
            reason = "non_numeric"
        elif field.name in macro:
            reason = "macro"
        else:
            reason = "included"
        out.append((field.name, reason == "included", reason))
    return out


def headed(cells: DataFrame) -> DataFrame:
    """sheet_name and columns of every sheet, from its cells (sheet_name, column, place): each column once, by its first place and then its name."""
    first = cells.groupBy("sheet_name", "column").agg(F.min("place").alias("place"))
    heads = first.groupBy("sheet_name").agg(F.array_sort(F.collect_list(F.struct("place", "column"))).alias("heads"))  # a sheet's columns, not its rows
    return heads.select("sheet_name", F.col("heads.column").alias("columns"))


def drift(sheets: DataFrame) -> DataFrame:
    """Per sheet (sheet_name, columns): columns missing from and beyond the baseline (the first sheet by name), and whether the order differs."""
    rows = sheets.crossJoin(F.broadcast(sheets.agg(F.min_by("columns", "sheet_name").alias("baseline"))))  # one row
    c, baseline = F.col("columns"), F.col("baseline")
    missing, extra = F.array_except(baseline, c), F.array_except(c, baseline)
    return rows.select("sheet_name", F.array_join(missing, ";").alias("missing_columns"), F.array_join(extra, ";").alias("extra_columns"), ((F.size(missing) == 0) & (F.size(extra) == 0) & (c != baseline)).alias("order_drift"))


def id_text(x: Column) -> Column:
    """Trimmed; 123.0 is 123 and a missing id the empty string."""
    return F.coalesce(F.regexp_replace(F.trim(x.cast("string")), r"\.0$", ""), F.lit(""))


def padded_id(x: Column, width: int = 6) -> Column:
    """id_text filled with zeros from the left; longer ids stay whole."""
    x = id_text(x)
    return F.when(F.length(x) < width, F.lpad(x, width, "0")).otherwise(x)


def safe_feature_name(x: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", ""), 1, 120)


def numeric(x: Column) -> Column:
    """A number written plainly, else null."""
    text = F.trim(x.cast("string"))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def conversion_log(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: values there, converted, failed, the share converted, the five smallest distinct failed values, and what to do."""
    rows = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias("text"), numeric(F.col(c)).isNull().alias("bad")) for c in columns))))
    counts = rows.groupBy("column").agg(F.count("text").alias("n"), F.count_if(F.col("bad") & F.col("text").isNotNull()).alias("failed"))
    failed = rows.where("bad AND text IS NOT NULL").select("column", "text").distinct().withColumn("part", F.pmod(F.xxhash64("text"), F.lit(1024)))
    # the five smallest of each part of the values, and then of these: no task ranks all of a column
    for part in (["column", "part"], ["column"]):
        failed = failed.withColumn("place", F.row_number().over(Window.partitionBy(*part).orderBy("text"))).where("place <= 5").drop("place")
    examples = failed.groupBy(F.col("column").alias("_c")).agg(F.array_join(F.array_sort(F.collect_list("text")), ";").alias("examples"))
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    out = named.join(F.broadcast(counts), "column", "left").join(F.broadcast(examples), F.col("column") == F.col("_c"), "left")  # a row per column
    n, bad = F.coalesce("n", F.lit(0)), F.coalesce("failed", F.lit(0))
    return out.select("column", n.alias("non_missing"), bad.alias("failed"), (n - bad).alias("success"), F.round(F.try_divide((n - bad).cast("double"), n), 6).alias("ratio"), F.coalesce("examples", F.lit("")).alias("examples"), F.when(n > bad, "numeric").otherwise("string").alias("action"))
