"""What runs report: totals and first failures, shares of outcomes, bands, differences to a named variant, triplet distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import dot

_OUTCOMES = (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0))


def run_totals(rows: DataFrame, ok: Column, seconds: Column, source: Column, *keys: str) -> DataFrame:
    """total, succeeded, failed, seconds_per_video, sources and expansion (rows a source), by keys; a null ok is a failure."""
    good = F.coalesce(F.sum(F.when(ok, 1)), F.lit(0)).cast("long")
    g = rows.groupBy(*keys).agg(F.count("*").alias("total"), good.alias("succeeded"), F.sum(seconds).alias("_s"), F.count_distinct(source).alias("sources"))
    return g.select(
        *keys, "total", "succeeded", (F.col("total") - F.col("succeeded")).alias("failed"), F.try_divide("_s", "total").alias("seconds_per_video"),
        "sources", F.try_divide(F.col("total").cast("double"), F.col("sources")).alias("expansion"),
    )


def first_failures(rows: DataFrame, ok: Column, *order: str, k: int = 10) -> DataFrame:
    """The first k rows by `order` that did not succeed: a report's list, taken from each task's own first k."""
    return rows.where(~F.coalesce(ok, F.lit(False))).orderBy(*order).limit(k)


def confusion_rows(c: DataFrame) -> DataFrame:
    """label, predicted, n, row_percent (of the label's rows), total_percent of one row of counts; 0 of nothing."""
    cells = F.array(*[F.struct(F.lit(y).alias("label"), F.lit(p).alias("predicted"), F.col(k).alias("n"), sum_.alias("row")) for k, y, p in _OUTCOMES for sum_ in [F.col("tp") + F.col("fn") if y else F.col("tn") + F.col("fp")]])
    whole = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    r = c.select(F.explode(cells).alias("r"), whole.alias("whole"))
    percent = lambda of: F.coalesce(F.try_divide(100.0 * F.col("r.n"), F.col(of)), F.lit(0.0))
    return r.select("r.label", "r.predicted", "r.n", percent("r.row").alias("row_percent"), percent("whole").alias("total_percent"))


def error_band(eer: Column) -> Column:
    """Over 15 % is high, over 10 % middle."""
    return F.when(eer > 0.15, "high").when(eer > 0.10, "middle").otherwise("low")


def bars(rows: DataFrame, name: str, value: str, high: float = 0.9, middle: float = 0.7) -> DataFrame:
    """rows with place (1 the largest value, of equal ones the first name), over_mean and band: a bar chart's data, a row a bar."""
    mean = rows.agg(F.avg(value).alias("_mean"))  # one row
    band = F.when(F.col(value) >= high, "high").when(F.col(value) >= middle, "middle").otherwise("low")
    place = F.row_number().over(Window.orderBy(F.desc(value), name))  # a chart has few bars
    return rows.crossJoin(F.broadcast(mean)).select(*rows.columns, place.alias("place"), (F.col(value) - F.col("_mean")).alias("over_mean"), band.alias("band"))


def against_full(variants: DataFrame, full: str, value: str = "accuracy") -> DataFrame:
    """variants (variant, value, ...) with delta, the value less that of the variant named `full` (null where it is missing)."""
    base = variants.where(F.col("variant") == full).agg(F.max(value).alias("_full"))  # one row
    return variants.crossJoin(F.broadcast(base)).withColumn("delta", F.col(value) - F.col("_full")).drop("_full")


def triplet_metrics(rows: DataFrame, a: Column, p: Column, n: Column, dims: int, margin: float = 1.0) -> DataFrame:
    """n, loss, violations (share with d(a,p) + margin > d(a,n)), mean_positive, mean_negative: squared distances of unit vectors."""
    size = lambda v: F.greatest(F.sqrt(dot(v, v, dims)), F.lit(1e-12))
    far = lambda u, v: 2 - 2 * dot(u, v, dims) / (size(u) * size(v))
    d = rows.select(far(a, p).alias("dp"), far(a, n).alias("dn"))
    gap = F.col("dp") + margin - F.col("dn")
    return d.agg(
        F.count("*").alias("n"), F.avg(F.greatest(gap, F.lit(0.0))).alias("loss"), F.avg((gap > 0).cast("int")).alias("violations"),
        F.avg("dp").alias("mean_positive"), F.avg("dn").alias("mean_negative"),
    )


# --- tables of text: (place, line) rows, to be read in order of place -----------------------------------------------------


def _fixed(x: Column, places: int) -> Column:
    """Halves go up before they are printed, as in SQL."""
    return F.format_string(f"%.{places}f", F.round(x, places))


def _percent(c: str, width: int) -> Column:
    return F.lpad(F.concat(_fixed(100 * F.col(c), 2), F.lit("%")), width, " ")


def overall_table(folds: DataFrame, names: dict[str, str]) -> DataFrame:
    """A line for each value that `names` gives a title: mean and standard deviation over the folds in percent; then the number of folds."""
    g = folds.agg(F.count("*").alias("n"), *[x for c in names for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    line = lambda c: F.format_string("%-30s %-20s %-15s", F.lit(names[c]), _fixed(100 * F.col(f"m_{c}"), 2), F.concat(F.lit("± "), _fixed(100 * F.col(f"s_{c}"), 2)))
    lines = [*map(line, names), F.format_string("%-30s %-20s %-15s", F.lit("Number of Folds"), F.col("n").cast("string"), F.lit("—"))]
    return g.select(F.posexplode(F.array(*lines)).alias("place", "line"))


def outcome_table(c: DataFrame, titles: dict[str, str]) -> DataFrame:
    """A line for each of tp, tn, fp, fn of one row of counts: title, count, share of all; then the total."""
    whole = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    share = lambda k: F.concat(_fixed(F.coalesce(F.try_divide(100.0 * F.col(k), whole), F.lit(0.0)), 1), F.lit("%"))
    row = lambda title, n, part: F.format_string("%-25s %-10d %s", F.lit(title), n, part)
    return c.select(F.posexplode(F.array(*[row(t, F.col(k), share(k)) for k, t in titles.items()], row("TOTAL", whole, F.lit("100.0%")))).alias("place", "line"))


def fold_table(folds: DataFrame, name: str, values: list[str], count: str) -> DataFrame:
    """part (0 folds, 1 mean, 2 deviation), name, line: each fold's values in percent and its rows, then their mean and deviation."""
    parts = lambda title, cells, last: F.concat_ws(" ", F.rpad(title, 12, " "), *[_percent(x, 10) for x in cells], F.lpad(last, 5, " "))
    own = folds.select(F.lit(0).alias("part"), F.col(name).alias("name"), parts(F.col(name), values, F.col(count).cast("string")).alias("line"))
    g = folds.agg(*[x for c in values for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    ends = [(1, "MEAN", "m_"), (2, "STD", "s_")]
    rows = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(t).alias("name"), parts(F.lit(t), [f"{x}{c}" for c in values], F.lit("")).alias("line")) for p, t, x in ends])
    return own.unionByName(g.select(F.explode(rows).alias("r")).select("r.*"))


def variant_table(variants: DataFrame, name: str, size: str, values: list[str]) -> DataFrame:
    """name, line: a variant's number of inputs and its values in percent."""
    return variants.select(F.col(name).alias("name"), F.concat_ws(" ", F.rpad(F.col(name), 25, " "), F.lpad(F.col(size).cast("string"), 8, " "), *[_percent(v, 8) for v in values]).alias("line"))


def importance_table(rows: DataFrame, name: str, value: str, percent: bool = False) -> DataFrame:
    """name, line: what was attributed to a joint, or in percent to a group of features."""
    v = F.concat(_fixed(100 * F.col(value), 1), F.lit("%")) if percent else _fixed(F.col(value), 4)
    return rows.select(F.col(name).cast("string").alias("name"), F.concat_ws(" ", F.rpad(F.col(name).cast("string"), 20, " "), F.lpad(v, 12, " ")).alias("line"))
