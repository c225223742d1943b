"""The evaluation report: text, boxes and structure of predicted documents against the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf import EngineConf
from ..functions import text as T
from ..functions.tree_distance import Keys
from . import boxes as B
from . import trees as R


def evaluate(predicted: DataFrame, truth: DataFrame, key: str, *, unit: str = "grapheme", iou_threshold: float | None = None, keys: Keys = Keys(), conf: EngineConf = EngineConf()) -> DataFrame:
    """predicted and truth hold key and tree (JSON). One row for each key of either side (a missing
    side is the empty tree): verdict, and where admitted CER, WER, box counts and rates, and the
    tree edit distance. What the cost check refuses never reaches the distance; its columns stay null."""
    conf_threshold = conf.iou_threshold if iou_threshold is None else iou_threshold
    if unit not in T.UNITS:
        raise ValueError(f"unit must be one of {T.UNITS}, got {unit!r}")
    if not 0 <= conf_threshold <= 1:
        raise ValueError("iou_threshold must be between 0 and 1")
    p = predicted.select(F.col(key).alias("pk"), F.col("tree").alias("pt"))
    t = truth.select(F.col(key).alias("tk"), F.col("tree").alias("tt"))
    both = p.join(t, F.col("pk") == F.col("tk"), "full").select(F.coalesce("pk", "tk").alias(key), "pt", "tt")
    both = R.compared(both, "pt", "tt", conf.max_nodes, conf.max_ted_work, keys).select(key, F.col("fa").alias("pf"), F.col("fb").alias("tf"), "verdict", "distance")
    ok = F.col("verdict") == "admitted"
    both = both.withColumn("cer", F.when(ok, T.score(F.col("tf.text"), F.col("pf.text"), unit))).withColumn("wer", F.when(ok, T.score(F.col("tf.text"), F.col("pf.text"), "word")))

    def side(name: str) -> DataFrame:
        at = both.where(ok).select(key, F.posexplode(f"{name}.boxes").alias("idx", "b"))
        return at.select(key, "idx", F.struct(*(F.col("b")[i].alias(n) for i, n in enumerate("xywh"))).alias("box"))

    report = B.rates(B.report(side("pf"), side("tf"), key, conf_threshold)).withColumnRenamed(key, "bk")
    count = lambda n: F.when(ok, F.coalesce(n, F.lit(0).cast("bigint"))).alias(n)
    one = lambda n, none: F.when(ok, F.coalesce(n, F.lit(none))).alias(n)
    return both.join(report, F.col(key) == F.col("bk"), "left").select(
        key, "verdict", F.col("cer.errors").alias("cer_errors"), F.col("cer.length").alias("cer_length"), T.rate(F.col("cer.errors"), F.col("cer.length")).alias("cer"),
        F.col("wer.errors").alias("wer_errors"), F.col("wer.length").alias("wer_length"), T.rate(F.col("wer.errors"), F.col("wer.length")).alias("wer"),
        *(count(n) for n in ("tp", "fp", "fn", "matched")), one("precision", 1.0), one("recall", 1.0), one("f1", 1.0), one("mean_iou", 0.0), one("mean_matched_iou", 0.0),
        F.col("distance").cast("bigint").alias("ted"), R.normalised(F.col("distance"), F.col("pf.size"), F.col("tf.size")).alias("ted_normalised"),
        F.when(F.col("verdict") != "malformed", F.col("pf.weight") * F.col("tf.weight")).alias("ted_work"), F.coalesce("pf.error", "tf.error").alias("error"),
    )
