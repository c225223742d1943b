"""The page state machine over command logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import controllers as C
from .fold import ordered_fold


def transition_table(spark: SparkSession) -> DataFrame:
    """from_state, to_state: the whole relation."""
    return spark.createDataFrame([(a, b) for a, to in C.TRANSITIONS.items() for b in to], "from_state string, to_state string")


def state_sets(spark: SparkSession) -> DataFrame:
    """state, terminal, running, checkpoint, predecessors."""
    rows = [(s, s in C.TERMINAL, s in C.RUNNING, C.CHECKPOINT.get(s), sorted(C.PREDECESSORS[s])) for s in C.TRANSITIONS]
    return spark.createDataFrame(rows, "state string, terminal boolean, running boolean, checkpoint string, predecessors array<string>")


def apply_commands(commands: DataFrame, keys: list[str], order: list[str], initial: str | None = "PENDING") -> DataFrame:
    """commands (keys, order, to_state) with ok, observed, already_applied, state for each, in order of
    each page. initial None: pages that nothing has created are missing."""

    def step(state, to):
        state, (ok, observed, already) = C.page_step(initial if state is None else state, to)
        return state, (ok, observed, already, state or "MISSING")

    return ordered_fold(commands, keys, order, ["to_state"], step, "ok boolean, observed string, already_applied boolean, state string")


def completions(applied: DataFrame, job: str, order: list[str], totals: DataFrame) -> DataFrame:
    """For each job the one terminal transition that completes it: the one whose rank is the total.
    totals: job, total_pages. Ranks are needed only where all pages are done."""
    done = applied.where(F.col("ok") & F.col("state").isin(*C.TERMINAL))
    last = done.groupBy(job).agg(F.count("*").alias("done_count"), F.max(F.struct(*order)).alias("last"))
    return last.join(totals, job).where("done_count >= total_pages").select(job, "done_count", "total_pages", *(F.col(f"last.{c}").alias(c) for c in order))


def bump_attempts(retries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds attempts: how often each page has been tried again, this time included. A count by rows, so
    that no two retries at one time lose one."""
    return retries.withColumn("attempts", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))


def release_target(state: Column) -> Column:
    out = F.lit(None).cast("string")
    for running, back in C.CHECKPOINT.items():
        out = F.when(state == running, back).otherwise(out)
    return out


def force_target(state: Column) -> Column:
    """Where a page out of time goes; null if it is terminal, MISSING if there is none."""
    out = F.lit(None).cast("string")
    for s in C.TRANSITIONS:
        if target := C.final_target(s):
            out = F.when(state == s, target).otherwise(out)
    return F.when(state.isNull(), F.lit("MISSING")).otherwise(out)


def final_attempt(age_s: Column, attempt: Column, degrade_s: int, deadline_s: int, requeues: int) -> Column:
    return (age_s >= degrade_s) | (age_s >= deadline_s) | (attempt + 1 >= requeues)


def process_outcome(state: Column, reclaim: Column, layout_ok: Column, vlm: Column, final: Column, handoff: Column) -> Column:
    """What one delivery of a page comes to. vlm: ok, saturated or error; layout_ok counts where layout
    still has to run; reclaim: the delivery is a recovery, so running states roll back."""
    back = F.when(reclaim & state.isin(*C.RUNNING), release_target(state)).otherwise(state)
    second = (
        F.when(vlm == "ok", F.when(back == "LAYOUT_DONE", "RESUMED").otherwise("COMPLETED"))
        .when((vlm == "saturated") & ~final, "SATURATED")
        .otherwise("DEGRADED")
    )
    return (
        F.when(state.isNull(), "MISSING")
        .when(state.isin(*C.TERMINAL), "ALREADY_TERMINAL")
        .when(state.isin(*C.RUNNING) & ~reclaim, "OWNED_BY_OTHER")
        .when((back == "PENDING") & ~layout_ok, "FAILED")
        .when((back == "PENDING") & handoff, "HANDOFF")
        .otherwise(second)
    )


def ttl_sweeps(log: DataFrame, keys: list[str], order: list[str], ms: str, ttl_ms: int) -> DataFrame:
    """Adds sweep: which successful transition of a job renews the expiry of all its pages."""

    def step(s, now):
        s, sweep = C.sweep_step(s, now, ttl_ms)
        return s, (sweep,)

    return ordered_fold(log, keys, order, [ms], step, "sweep boolean")


def degrade(pages: DataFrame, status: str, error: str, confidence: float) -> DataFrame:
    """What a page falls back to: the layout alone, marked, with the reason."""
    reason = F.when(F.col(status).isNotNull(), F.concat(F.lit("HTTP "), F.col(status).cast("string"))).otherwise(F.col(error))
    return pages.withColumn("state", F.lit("FALLBACK_DONE")).withColumn("degraded", F.lit(1)).withColumn("confidence", F.lit(confidence)).withColumn("fallback_reason", reason)
