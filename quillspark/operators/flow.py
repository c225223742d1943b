"""Flow control over logs: bucket, breaker, rate control, admission, retries, idempotency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import EngineConf
from ..functions import controllers as C
from .fold import ordered_fold


def token_bucket(calls: DataFrame, keys: list[str], order: list[str], ms: str, *, rate: float, burst: float, max_wait_ms: float, cost: float = 1.0) -> DataFrame:
    """Bounded reservations: adds granted, wait_ms, tokens."""
    step = lambda s, now: C.bucket_step(s, now, cost, rate, burst, max_wait_ms)
    return ordered_fold(calls, keys, order, [ms], step, "granted boolean, wait_ms bigint, tokens double")


def token_bucket_ops(calls: DataFrame, keys: list[str], order: list[str], ms: str, op: str, *, rate: float, burst: float, max_wait_ms: float) -> DataFrame:
    """A log of acquire, peek and reset: adds granted, wait_ms, tokens."""
    step = lambda s, now, what: C.bucket_op_step(s, now, what, rate, burst, max_wait_ms)
    return ordered_fold(calls, keys, order, [ms, op], step, "granted boolean, wait_ms bigint, tokens double")


def bounded_flight(calls: DataFrame, keys: list[str], order: list[str], call: str, ms: str, failed: str, *, ttl_ms: int, most: int) -> DataFrame:
    """Single flight with a bounded store for each of keys: adds outcome and held. A task holds most
    results of one key at a time."""
    step = lambda s, key, now, bad: C.bounded_flight_step(s, key, now, bad, ttl_ms, most)
    return ordered_fold(calls, keys, order, [call, ms, failed], step, "outcome string, held bigint")


def token_bucket_unbounded(calls: DataFrame, keys: list[str], order: list[str], ms: str, *, rate: float, burst: float) -> DataFrame:
    """All are granted, however long they wait: no fold, but a running minimum. Adds tokens, wait_ms."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n = F.row_number().over(w)
    t = (F.col(ms) - F.min(ms).over(Window.partitionBy(*keys))) * rate / 1000
    rows = calls.withColumn("_n", n).withColumn("_t", t)
    low = F.min(burst - F.col("_t") + F.col("_n") - 1).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("tokens", F.col("_t") - F.col("_n") + low)
    return rows.withColumn("wait_ms", F.greatest(F.lit(0.0), F.ceil(F.round(-F.col("tokens") * 1000 / rate, 6))).cast("bigint")).drop("_n", "_t")


def breaker(calls: DataFrame, keys: list[str], order: list[str], ms: str, op: str, conf: EngineConf) -> DataFrame:
    step = lambda s, now, what: C.breaker_step(s, now, what, conf)
    return ordered_fold(calls, keys, order, [ms, op], step, "admitted boolean, retry_ms bigint, breaker_state string")


def aimd(calls: DataFrame, keys: list[str], order: list[str], ms: str, op: str, latency: str, conf: EngineConf) -> DataFrame:
    step = lambda s, now, what, lat: C.aimd_step(s, now, what, None if lat != lat else lat, conf)
    return ordered_fold(calls, keys, order, [ms, op, latency], step, "rate double, action string, p95 double")


def aimd_p95(successes: DataFrame, keys: list[str], order: list[str], latency: str, conf: EngineConf = EngineConf()) -> DataFrame:
    """p95 over the last ring of successes, from enough samples on: a window, no fold."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - conf.aimd_ring, 0)
    ring = F.array_sort(F.collect_list(latency).over(w))
    at = F.ceil(F.size(ring) * 0.95).cast("int")
    return successes.withColumn("p95", F.when(F.size(ring) >= conf.aimd_min_samples, F.element_at(ring, at)))


def admission(log: DataFrame, keys: list[str], order: list[str], pages: str, drained: str, high: int, low: int) -> DataFrame:
    step = lambda s, p, d: C.admission_step(s, p, d, high, low)
    return ordered_fold(log, keys, order, [pages, drained], step, "admitted boolean, depth bigint, shedding boolean")


def admission_observed(log: DataFrame, keys: list[str], order: list[str], depth: str, high: int, low: int) -> DataFrame:
    """Shedding as seen from a series of depths: the last crossing decides."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col(depth) >= high, True).when(F.col(depth) <= low, False)
    return log.withColumn("shedding", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False)))


def retry_after_s(depth: Column, low: int, rate: Column, jitter: Column, cap: int = 300) -> Column:
    """Seconds until the queue should be low again, at least 1 and at most cap."""
    wait = F.ceil(F.greatest(F.lit(0), depth - low) / F.greatest(rate, F.lit(0.1)) * (1 + jitter))
    return F.least(F.lit(cap), F.greatest(F.lit(1), wait)).cast("bigint")


def classify(error: Column, status: Column) -> Column:
    """Disposition of a failed call; unknown errors are permanent."""
    return (
        F.when(error == "circuit_open", "CIRCUIT_OPEN")
        .when(error == "rate_limit_timeout", "SATURATED")
        .when(error == "http", F.when(status.isin(408, 425, 429, 500, 502, 503, 504), "RETRY").otherwise("PERMANENT"))
        .when(error.isin("timeout", "transport"), "RETRY")
        .otherwise("PERMANENT")
    )


def retry_after_ms(exact: Column, seconds: Column) -> Column:
    """From a header in ms, else one in seconds; never negative; dates and junk are null."""
    ms = F.coalesce(exact.try_cast("double"), seconds.try_cast("double") * 1000)
    return F.when(ms.isNotNull(), F.greatest(F.lit(0.0), ms))


def backoff_ceiling_ms(attempt: Column, base_ms: int = 200, cap_ms: int = 5_000) -> Column:
    return F.least(F.lit(float(cap_ms)), base_ms * F.pow(F.lit(2.0), attempt))


def backoff_ms(attempt: Column, hint_ms: Column, draw: Column, base_ms: int = 200, cap_ms: int = 5_000) -> Column:
    """draw in [0, 1) comes from the caller (a hash, so that replays agree); a hint is a floor plus a spread."""
    return F.when(hint_ms.isNotNull(), hint_ms + draw * base_ms).otherwise(draw * backoff_ceiling_ms(attempt, base_ms, cap_ms))


def hashed_draw(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(1_000_003)) / 1_000_003


def idempotency_key(job: Column, page: Column, stage: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", job.cast("string"), page.cast("string"), stage), 256), 1, 32)


def single_flight(requests: DataFrame, keys: list[str], order: list[str], ms: str, failed: str, ttl_ms: int) -> DataFrame:
    def step(s, now, bad):
        s, what = C.flight_step(s, now, bad, ttl_ms)
        return s, (what,)

    return ordered_fold(requests, keys, order, [ms, failed], step, "outcome string")


def chaos(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Faulted requests: requests (id, endpoint, ms, draw) within a rule (endpoint, start_ms, end_ms, ratio)."""
    on = (requests.endpoint == rules.endpoint) & (requests.ms >= rules.start_ms) & (requests.ms < rules.end_ms) & (requests.draw < rules.ratio)
    return requests.join(rules, on, "left_semi")


def gated_calls(calls: DataFrame, keys: list[str], order: list[str], ms: str, outcome: str, latency: str, conf: EngineConf) -> DataFrame:
    """Adds result, rate, wait_ms, breaker_state: all gates of an endpoint over its call log."""
    step = lambda s, now, what, lat: C.call_step(s, now, what, None if lat != lat else lat, conf)
    return ordered_fold(calls, keys, order, [ms, outcome, latency], step, "result string, rate double, wait_ms bigint, breaker_state string")
