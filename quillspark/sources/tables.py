"""Parquet tables, with the one cast that the engine needs: event times as instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ms, the event time in epoch milliseconds, whatever the session's time zone."""
    df = table(spark, sf_dir, "events")
    return df.withColumn("ms", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000"))


def quarantine(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Splits rows into good ones and rejects with a reason: the first rule (reason: SQL condition
    that a good row meets) that does not hold, null counting as not holding. Never fails the job."""
    reason = F.coalesce(*(F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(r)) for r, c in rules.items()), F.lit(None).cast("string"))
    judged = df.withColumn("reject_reason", reason)
    return judged.where("reject_reason is null").drop("reject_reason"), judged.where("reject_reason is not null")
