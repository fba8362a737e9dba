"""Verification metrics from label (0 or 1) and score: confusion, curves, areas, thresholds, folds.

Curves need running totals in order of score. These are taken in two steps, so that no task sees all scores: scores fall
into value ranges, each range sums its own, and ranges' offsets are added from their totals, which are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Ranges of values, and distinct scores (of a key) that one has on average: more ranges for more scores, up to MOST_RANGES.
RANGES, RANGE_ROWS, MOST_RANGES = 64, 200_000, 2048


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def counts(df: DataFrame, predicted: Column, *keys: str) -> DataFrame:
    """tp, fp, tn, fn by keys."""
    p, y = predicted.cast("int"), F.col("label")
    n = lambda a, b: F.sum(F.when((y == a) & (p == b), 1).otherwise(0)).cast("long")
    return df.groupBy(*keys).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(0, 0).alias("tn"), n(1, 0).alias("fn"))


def rates(c: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 of counts, 0 where undefined."""
    tp, fp, tn, fn = (F.col(k) for k in ("tp", "fp", "tn", "fn"))
    return c.withColumns({"accuracy": _share(tp + tn, tp + fp + tn + fn), "precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn), "f1": _share(2 * tp, 2 * tp + fp + fn)})


def report(c: DataFrame) -> DataFrame:
    """class, precision, recall, f1, support: both classes, macro and weighted averages, of one row of counts."""
    tp, fp, tn, fn = (F.col(k) for k in ("tp", "fp", "tn", "fn"))
    one = lambda name, a, b, d: F.struct(F.lit(name).alias("class"), _share(a, a + b).alias("precision"), _share(a, a + d).alias("recall"), _share(2 * a, 2 * a + b + d).alias("f1"), (a + d).alias("support"))
    rows = c.select(F.explode(F.array(one("0", tn, fn, fp), one("1", tp, fp, fn))).alias("r")).select("r.*")
    mean = lambda name, f: rows.agg(*[f(k).alias(k) for k in ("precision", "recall", "f1")], F.sum("support").alias("support")).select(F.lit(name).alias("class"), "precision", "recall", "f1", "support")
    return rows.unionByName(mean("macro avg", F.avg)).unionByName(mean("weighted avg", lambda k: F.coalesce(F.try_divide(F.sum(F.col(k) * F.col("support")), F.sum("support")), F.lit(0.0))))


def eps_rates(c: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Per class percentages with eps in every denominator, as a training log has them."""
    tp, fp, tn, fn = (F.col(k).cast("double") for k in ("tp", "fp", "tn", "fn"))
    out = {}
    for name, a, b, d in (("fake", tn, fn, fp), ("authentic", tp, fp, fn)):
        p, r = a / (a + b + eps), a / (a + d + eps)
        out |= {f"{name}_precision": 100 * p, f"{name}_recall": 100 * r, f"{name}_f1": 100 * 2 * p * r / (p + r + eps)}
    return c.withColumns(out)


def running_totals(df: DataFrame, keys: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """score, pos, neg, tp, fp, next_pos, next_neg, n_pos, n_neg: one row a distinct score, totals from the largest down.

    With keys, each key's curve is its own; its ranges are of the scores of all. Sums by score are written once: what made
    the scores runs a single time, when this is called.
    """
    keys = keys or []
    g = df.groupBy(*keys, "score").agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg"))
    g = written(g, "score-sums")
    ranges = ranges or min(MOST_RANGES, max(RANGES, g.count() // RANGE_ROWS))
    # the edges of the ranges are one row of fewer than `ranges` numbers
    edges = g.agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)], 16 * ranges).alias("_edges"))
    g = g.crossJoin(F.broadcast(edges)).withColumn("range", F.size(F.filter("_edges", lambda e: F.col("score") < e))).drop("_edges")
    top = F.max_by(F.struct("pos", "neg"), "score").alias("top")
    sums = g.groupBy(*keys, "range").agg(F.sum("pos").alias("range_pos"), F.sum("neg").alias("range_neg"), top)
    order = Window.partitionBy(*keys).orderBy("range")  # at most `ranges` rows a key
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sums = sums.select(
        *keys, "range", F.coalesce(F.sum("range_pos").over(before), F.lit(0)).alias("pos0"), F.coalesce(F.sum("range_neg").over(before), F.lit(0)).alias("neg0"),
        F.lead("top").over(order).alias("after"), F.sum("range_pos").over(whole).alias("n_pos"), F.sum("range_neg").over(whole).alias("n_neg"),
    )
    within = Window.partitionBy(*keys, "range").orderBy(F.desc("score"))
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    out = g.join(sums, [*keys, "range"])
    return out.select(
        *keys, "score", "pos", "neg", (F.col("pos0") + F.sum("pos").over(so_far)).alias("tp"), (F.col("neg0") + F.sum("neg").over(so_far)).alias("fp"),
        F.coalesce(F.lead("pos").over(within), F.col("after.pos")).alias("next_pos"), F.coalesce(F.lead("neg").over(within), F.col("after.neg")).alias("next_neg"), "n_pos", "n_neg",
    )


def roc_curve(df: DataFrame, keys: list[str] | None = None, drop_collinear: bool = False) -> DataFrame:
    """threshold, tp, fp, tpr, fpr, fnr from the largest score down; the point (0, 0) has threshold null.

    drop_collinear keeps the ends and the points where the curve changes direction.
    """
    keys = keys or []
    t = running_totals(df, keys)
    if drop_collinear:
        t = t.where(F.col("next_pos").isNull() | (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg")))
    pts = t.select(*keys, F.col("score").alias("threshold"), "tp", "fp", "n_pos", "n_neg")
    zero = t.groupBy(*keys).agg(F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg")).select(*keys, F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "n_pos", "n_neg")
    pts = zero.unionByName(pts)
    return pts.withColumns({"tpr": _share(F.col("tp"), F.col("n_pos")), "fpr": _share(F.col("fp"), F.col("n_neg"))}).withColumn("fnr", 1 - F.col("tpr"))


def roc_auc(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """auc, n_pos, n_neg: trapezoids; 0 where a class is missing."""
    keys = keys or []
    t = running_totals(df, keys)
    area = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos"))) / 2.0
    out = t.groupBy(*keys).agg(area.alias("area"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
    return out.select(*keys, _share(F.col("area"), F.col("n_pos") * F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def average_precision(df: DataFrame) -> DataFrame:
    """Sum of recall steps times precision."""
    t = running_totals(df)
    return t.agg(F.coalesce(F.sum(F.try_divide(F.col("pos").cast("double"), F.col("n_pos")) * F.col("tp") / (F.col("tp") + F.col("fp"))), F.lit(0.0)).alias("average_precision"))


def pr_auc(df: DataFrame) -> DataFrame:
    """Area under precision over recall by trapezoids, from (0, 1)."""
    t = running_totals(df)
    now = F.col("tp") / (F.col("tp") + F.col("fp"))
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    before = F.coalesce(F.try_divide(tp0.cast("double"), (tp0 + fp0).cast("double")), F.lit(1.0))
    return t.agg(F.coalesce(F.sum(F.try_divide(F.col("pos").cast("double"), F.col("n_pos")) * (now + before) / 2), F.lit(0.0)).alias("pr_auc"))


def youden(df: DataFrame) -> DataFrame:
    """threshold, j, tpr, fpr of the largest tpr - fpr; of equal ones the largest threshold (null: the point (0, 0))."""
    pts = roc_curve(df).withColumn("j", F.round(F.col("tpr") - F.col("fpr"), 12))
    best = F.max(F.struct("j", F.coalesce("threshold", F.lit(float("inf"))).alias("t"), "tpr", "fpr"))
    return pts.agg(best.alias("b")).select(F.when(F.col("b.t") < float("inf"), F.col("b.t")).alias("threshold"), F.col("b.j").alias("j"), F.col("b.tpr").alias("tpr"), F.col("b.fpr").alias("fpr"))


def eer(df: DataFrame, keys: list[str] | None = None, drop_collinear: bool = True) -> DataFrame:
    """eer and its threshold: where |fpr - fnr| is least, the largest threshold of equal ones; (0, 0.5) with one class."""
    keys = keys or []
    pts = roc_curve(df, keys, drop_collinear)
    gap = F.round(F.abs(F.col("fpr") - F.col("fnr")), 12)
    best = F.min(F.struct(gap.alias("gap"), (-F.coalesce("threshold", F.lit(float("inf")))).alias("t"), ((F.col("fpr") + F.col("fnr")) / 2).alias("e")))
    out = pts.groupBy(*keys).agg(best.alias("b"), F.max("n_pos").alias("p"), F.max("n_neg").alias("n"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return out.select(*keys, F.when(both, F.col("b.e")).otherwise(0.0).alias("eer"), F.when(both, F.when(F.col("b.t") > float("-inf"), -F.col("b.t"))).otherwise(0.5).alias("threshold"))


def score_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """label, bin, n: equal bins from each class's smallest to its largest score, the last one closed."""
    ends = df.groupBy("label").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    at = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide((F.col("score") - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))).cast("int"))
    return df.join(F.broadcast(ends), "label").groupBy("label", at.alias("bin")).agg(F.count("*").alias("n"))


def first_of_each_case(df: DataFrame, key: str, threshold: float = 0.5, k: int = 5) -> DataFrame:
    """The first k rows by key of each of TP, TN, FP, FN."""
    p = F.col("score") >= threshold
    case = F.when(p & (F.col("label") == 1), "TP").when(p, "FP").when(F.col("label") == 1, "FN").otherwise("TN")
    w = Window.partitionBy("case").orderBy(key, "claimed_identity")
    return df.withColumn("case", case).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)
