"""Lanes, claims, leases, recovery and quarantine over task and delivery logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAD, MAIN = "lead", "main"


def lane(page_index: Column) -> Column:
    """The first page of a job goes ahead of all others."""
    return F.when(page_index == 0, LEAD).otherwise(MAIN)


def init_job(jobs: DataFrame, total: str) -> DataFrame:
    """One pending page for each of total; a job without pages has none."""
    pages = F.when(F.col(total) > 0, F.sequence(F.lit(0), (F.col(total) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return jobs.withColumn("page_index", F.explode(pages)).withColumn("state", F.lit("PENDING")).withColumn("attempts", F.lit(0)).withColumn("lane", lane(F.col("page_index")))


def claim(tasks: DataFrame, group: list[str], order: list[str], budget: int) -> DataFrame:
    """The tasks that one reader of each group takes: the lead lane first, budget in all."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.when(F.col("lane") == LEAD, 0).otherwise(1), *order))
    return tasks.withColumn("_rank", rank).where(F.col("_rank") <= budget).drop("_rank")


def lane_budgets(concurrency: Column, in_flight: Column, reserve: int = 4) -> tuple[Column, Column]:
    """(for the lead lane, for the main lane): the free slots, of which main leaves a reserve; with no
    reserve both share."""
    held = F.least(F.lit(reserve), concurrency - 1)
    return F.greatest(F.lit(0), concurrency - in_flight), F.greatest(F.lit(0), concurrency - held - in_flight)


def idle_ms(now: Column, delivered: Column, renewed: Column) -> Column:
    """Since the last renewal of a lease, or the delivery."""
    return F.greatest(F.lit(0), now - F.greatest(delivered, renewed))


def orphans(pending: DataFrame, consumer: Column, min_idle: int, batch: int, order: list[str]) -> DataFrame:
    """Entries that others hold and have not touched for min_idle; the batch bounds the scan of a lane
    before the caller's own entries are left out."""
    rank = F.row_number().over(Window.partitionBy("lane").orderBy(*order))
    idle = pending.where(F.col("idle_ms") >= min_idle).withColumn("_rank", rank)
    return idle.where((F.col("_rank") <= batch) & (F.col("consumer") != consumer)).drop("_rank")


def requeue(tasks: DataFrame, now: Column, handoff: Column) -> DataFrame:
    """Successors: always the main lane, enqueued anew, first_enqueued kept, one attempt more unless handed on."""
    kept = F.coalesce("first_enqueued_ms", "enqueued_ms")
    out = tasks.withColumn("attempt", F.col("attempt") + F.when(handoff, 0).otherwise(1)).withColumn("first_enqueued_ms", kept)
    return out.withColumn("lane", F.lit(MAIN)).withColumn("enqueued_ms", now)


def unacked(delivered: DataFrame, acks: DataFrame, keys: list[str]) -> DataFrame:
    """An ack names the stream and the entry."""
    return delivered.join(acks.select(*keys).distinct(), keys, "left_anti")


def age_ms(now: Column, first: Column, enqueued: Column) -> Column:
    return F.greatest(F.lit(0), now - F.coalesce(first, enqueued))


def lag_ms(now: Column, enqueued: Column) -> Column:
    return F.greatest(F.lit(0), now - enqueued)


def depth(entries: DataFrame, by: list[str]) -> DataFrame:
    """entries: delivered, acked. stream_length, pending and backlog (not delivered yet)."""
    live = ~F.col("acked")
    out = entries.groupBy(*by).agg(F.count_if(live).alias("stream_length"), F.count_if(live & F.col("delivered")).alias("pending"))
    return out.withColumn("backlog", F.greatest(F.lit(0), F.col("stream_length") - F.col("pending")))


def reap(state: Column, terminal: Column, age: Column, attempt: Column, deadline_ms: int, requeues: int) -> Column:
    """What becomes of an orphan; its age counts against the deadline, not against the degrade limit."""
    return (
        F.when(state.isNull(), "expired")
        .when(terminal, "already_terminal")
        .when((age >= deadline_ms) | (attempt + 1 >= requeues), "forced_terminal")
        .otherwise("requeued")
    )


def ack_policy(outcome: Column, retry_after_s: Column, pause_s: float = 0.5) -> Column:
    """struct<action, pause_s> for an outcome; a crash is released and tried again."""
    action = F.when(outcome == "HANDOFF", "requeue_same_attempt").when(outcome == "SATURATED", "requeue").when(outcome == "CRASHED", "release_requeue").otherwise("ack")
    pause = F.when(outcome == "SATURATED", F.least(F.coalesce(retry_after_s, F.lit(pause_s)), F.lit(pause_s))).otherwise(F.lit(0.0))
    return F.struct(action.alias("action"), pause.alias("pause_s"))


def safe_document_id(name: Column) -> Column:
    return name.rlike(r"\A[A-Za-z0-9_-]{1,64}\z")


def stale_documents(files: DataFrame, jobs: DataFrame, age_s: int) -> DataFrame:
    """Stored documents old enough, safely named, whose job is gone. files: name, age_s; jobs: name."""
    return files.where((F.col("age_s") >= age_s) & safe_document_id(F.col("name"))).join(jobs.select("name").distinct(), "name", "left_anti")


def own_pending(pending: DataFrame, consumer: str, order: list[str], budget: int) -> DataFrame:
    """What each consumer holds unacked from before it restarted: lead lane first, budget in all; marked recovered."""
    rank = F.row_number().over(Window.partitionBy(consumer).orderBy(F.when(F.col("lane") == LEAD, 0).otherwise(1), *order))
    return pending.withColumn("_rank", rank).where(F.col("_rank") <= budget).drop("_rank").withColumn("recovered", F.lit(True))
