"""Bounding boxes: IoU, greedy one-to-one matching, precision, recall and F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A box from two opposite corners in any order."""
    return F.struct(F.least(x1, x2).alias("x"), F.least(y1, y2).alias("y"), F.abs(x2 - x1).alias("w"), F.abs(y2 - y1).alias("h"))


def checked(box: Column) -> Column:
    """The box, or an error if its extent is negative or missing: such boxes are refused, not clamped."""
    ok = F.coalesce((box.w >= 0) & (box.h >= 0) & box.x.isNotNull() & box.y.isNotNull(), F.lit(False))
    return F.when(ok, box).otherwise(F.raise_error(F.concat(F.lit("malformed box "), F.coalesce(F.to_json(box), F.lit("null")))))


def iou(a: Column, b: Column) -> Column:
    """Each overlap is clamped at 0 before the two are multiplied; no union, no overlap: 0."""
    wide = F.greatest(F.lit(0.0), F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x))
    high = F.greatest(F.lit(0.0), F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y))
    common = wide * high
    union = a.w * a.h + b.w * b.h - common
    return F.when(union > 0, common / F.when(union > 0, union)).otherwise(F.lit(0.0))


def candidates(predicted: DataFrame, truth: DataFrame, page: str) -> DataFrame:
    """page, i, j, iou for all pairs of a page that overlap. Both sides hold page, idx, box; the
    overlap conditions are part of the equi-join, so disjoint pairs are never built. A box that is
    malformed is an error."""
    p = predicted.select(page, F.col("idx").alias("i"), checked(F.col("box")).alias("p"))
    t = truth.select(page, F.col("idx").alias("j"), checked(F.col("box")).alias("t"))
    meet = p.join(t.withColumnRenamed(page, "_page"), (F.col(page) == F.col("_page")) & F.expr("p.x < t.x + t.w and t.x < p.x + p.w and p.y < t.y + t.h and t.y < p.y + p.h"))
    return meet.select(page, "i", "j", iou(F.col("p"), F.col("t")).alias("iou")).where("iou > 0")


def match(predicted: DataFrame, truth: DataFrame, page: str) -> DataFrame:
    """page, matches (array of i, j, iou): pairs are taken by falling IoU, then i, then j, each side once.

    One page's candidates are gathered, never more: a page is the unit of work."""
    ranked = candidates(predicted, truth, page).groupBy(page).agg(F.sort_array(F.collect_list(F.struct((-F.col("iou")).alias("n"), "i", "j"))).alias("c"))
    taken = F.expr("aggregate(c, cast(array() as array<struct<n:double,i:int,j:int>>), (a, x) -> if(exists(a, m -> m.i = x.i or m.j = x.j), a, array_append(a, named_struct('n', x.n, 'i', cast(x.i as int), 'j', cast(x.j as int)))))")
    return ranked.select(page, F.transform(taken, lambda m: F.struct(m.i.alias("i"), m.j.alias("j"), (-m.n).alias("iou"))).alias("matches"))


def report(predicted: DataFrame, truth: DataFrame, page: str, threshold: float = 0.5) -> DataFrame:
    """page, predicted, truth, matched, tp, fp, fn, iou_sum, threshold. A weak match is a false
    positive and a false negative; the threshold itself counts as good."""
    sizes = predicted.select(page, F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(truth.select(page, F.lit(0).alias("p"), F.lit(1).alias("t"))).groupBy(page).agg(F.sum("p").alias("predicted"), F.sum("t").alias("truth"))
    m = match(predicted, truth, page).select(F.col(page).alias("_page"), "matches")
    got = F.coalesce(F.col("matches"), F.array().cast("array<struct<i:int,j:int,iou:double>>"))
    tp = F.size(F.filter(got, lambda x: x.iou >= threshold)).cast("bigint")
    out = sizes.join(m, F.col(page) == F.col("_page"), "left").select(page, "predicted", "truth", F.size(got).cast("bigint").alias("matched"), tp.alias("tp"), F.aggregate(got, F.lit(0.0), lambda a, x: a + x.iou).alias("iou_sum"))
    return out.select("*", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("truth") - F.col("tp")).alias("fn"), F.lit(float(threshold)).alias("threshold"))


def rates(reports: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, mean_iou and mean_matched_iou to summed or single reports."""
    c = F.col
    over = lambda a, b, none: F.when(b == 0, none).otherwise(a / F.when(b != 0, b))
    p, r = over(c("tp"), c("predicted"), F.lit(1.0)), over(c("tp"), c("truth"), F.lit(1.0))
    out = reports.withColumn("precision", p).withColumn("recall", r)
    out = out.withColumn("f1", over(2 * c("precision") * c("recall"), c("precision") + c("recall"), F.lit(0.0)))
    out = out.withColumn("mean_iou", over(c("iou_sum"), c("truth"), F.when(c("iou_sum") == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))))
    return out.withColumn("mean_matched_iou", over(c("iou_sum"), c("matched"), F.lit(0.0)))


def aggregate(reports: DataFrame, by: list[str]) -> DataFrame:
    """Sums of all counts for each group; reports at different thresholds raise an error."""
    sums = [F.sum(n).alias(n) for n in ("predicted", "truth", "matched", "tp", "fp", "fn", "iou_sum")]
    out = reports.groupBy(*by).agg(*sums, F.min("threshold").alias("threshold"), F.max("threshold").alias("_high"))
    same = F.when(F.col("threshold") == F.col("_high"), F.col("threshold")).otherwise(F.raise_error(F.lit("reports at different thresholds cannot be added")))
    return out.withColumn("threshold", same).drop("_high")
