"""States and flow control bound to the event stream.

The stream spans a month; times are scaled so that 3,600 ms of it are 1 ms of a controller's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import EngineConf
from ..functions import controllers as C
from ..operators import flow, states
from ..sources.tables import events as load
from ..sources.tables import table

DAY = 86_400_000
BUCKET = {"rate": 2.0, "burst": 5.0, "max_wait_ms": 3000}
BREAKER = EngineConf(breaker_min_volume=5, breaker_failure_ratio=0.3)
AIMD = EngineConf(aimd_successes=5, aimd_slo_ms=85.0, aimd_refractory_ms=2_000)
HIGH, LOW = 60, 48
#: The state that each kind of event asks for.
ASKS = {"view": "LAYOUT_RUNNING", "click": "LAYOUT_DONE", "signup": "VLM_RUNNING", "purchase": "DONE", "error": "FAILED"}


def scaled(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d).withColumn("sms", F.expr("ms div 3600"))


def commands(spark: SparkSession, d: str) -> DataFrame:
    """A user is a job, each of its days a page, each event a command."""
    to = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in ASKS.items()))
    return load(spark, d).select(F.col("user_id").alias("job_id"), F.expr(f"ms div {DAY}").alias("page"), "ms", "event_id", to.alias("to_state"))


def applied(spark: SparkSession, d: str) -> DataFrame:
    return states.apply_commands(commands(spark, d), ["job_id", "page"], ["ms", "event_id"])


def transition_relation(spark: SparkSession, d: str) -> DataFrame:
    return states.transition_table(spark)


def state_sets(spark: SparkSession, d: str) -> DataFrame:
    s = states.state_sets(spark)
    return s.select("state", "terminal", "running", "checkpoint", F.array_join("predecessors", ",").alias("predecessors"))


def state_machine(spark: SparkSession, d: str) -> DataFrame:
    return applied(spark, d).select("event_id", "ok", "observed", "already_applied", "state")


def state_counts(spark: SparkSession, d: str) -> DataFrame:
    last = applied(spark, d).groupBy("job_id", "page").agg(F.max_by("state", F.struct("ms", "event_id")).alias("state"))
    return last.groupBy("job_id", "state").agg(F.count("*").alias("pages"))


def job_progress(spark: SparkSession, d: str) -> DataFrame:
    last = applied(spark, d).groupBy("job_id", "page").agg(F.max_by("state", F.struct("ms", "event_id")).alias("state"))
    done = F.count_if(F.col("state").isin(*sorted(C.TERMINAL)))
    return last.groupBy("job_id").agg(done.alias("done"), F.count("*").alias("total"), (done >= F.count("*")).alias("complete"))


def job_complete(spark: SparkSession, d: str) -> DataFrame:
    a = applied(spark, d)
    # a job's total are the pages that it had by halfway, so that some complete
    totals = a.groupBy("job_id").agg(F.expr("count(distinct page) div 2").alias("total_pages"))
    return states.completions(a, "job_id", ["ms", "event_id"], totals).select("job_id", "done_count", "total_pages", "ms", "event_id")


def accepted_events(spark: SparkSession, d: str) -> DataFrame:
    """What accepted transitions emit: partial results, final ones and failures; rejected ones emit nothing."""
    a = applied(spark, d).where("ok")
    kind = F.when(F.col("state") == "LAYOUT_DONE", "page.partial").when(F.col("state").isin(*sorted(C.TERMINAL)), "page.final")
    return a.select("event_id", "job_id", "page", kind.alias("event")).where("event is not null")


def forced_pages(spark: SparkSession, d: str) -> DataFrame:
    last = applied(spark, d).groupBy("job_id", "page").agg(F.max_by("state", F.struct("ms", "event_id")).alias("state"))
    return last.select("job_id", "page", "state", states.force_target(F.col("state")).alias("forced"), states.release_target(F.col("state")).alias("released"))


def page_outcomes(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d).withColumn("n", F.col("event_id"))
    state = F.element_at(F.array(*map(F.lit, ["PENDING", "LAYOUT_RUNNING", "LAYOUT_DONE", "VLM_RUNNING", "DONE"])), (F.col("n") % 5 + 1).cast("int"))
    vlm = F.when(F.col("n") % 3 == 0, "ok").when(F.col("n") % 3 == 1, "saturated").otherwise("error")
    final = states.final_attempt(F.col("value"), F.col("n") % 400, 90, 300, EngineConf().effective_max_requeues)
    out = states.process_outcome(state, F.col("n") % 2 == 0, F.col("n") % 7 != 0, vlm, final, F.col("n") % 11 == 0)
    return e.select("event_id", final.alias("final_attempt"), out.alias("outcome"))


def token_bucket_bounded(spark: SparkSession, d: str) -> DataFrame:
    r = flow.token_bucket(scaled(spark, d), ["event_type"], ["ms", "event_id"], "sms", **BUCKET)
    return r.select("event_id", "granted", "wait_ms", F.round("tokens", 6).alias("tokens"))


def token_bucket_no_wait(spark: SparkSession, d: str) -> DataFrame:
    r = flow.token_bucket(scaled(spark, d), ["event_type"], ["ms", "event_id"], "sms", rate=2.0, burst=5.0, max_wait_ms=0)
    return r.groupBy("event_type").agg(F.count_if("granted").alias("granted"), F.count_if(~F.col("granted")).alias("refused"))


def token_bucket_reserve(spark: SparkSession, d: str) -> DataFrame:
    r = flow.token_bucket_unbounded(scaled(spark, d), ["event_type"], ["ms", "event_id"], "sms", rate=2.0, burst=5.0)
    return r.select("event_id", F.round("tokens", 6).alias("tokens"), "wait_ms")


def _ops(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type").isin("purchase", "click"), "success").otherwise("allow")
    return scaled(spark, d).withColumn("endpoint", F.col("user_id") % 8).withColumn("op", op)


def breaker(spark: SparkSession, d: str) -> DataFrame:
    r = flow.breaker(_ops(spark, d), ["endpoint"], ["ms", "event_id"], "sms", "op", BREAKER)
    return r.select("event_id", "admitted", "retry_ms", "breaker_state")


def aimd(spark: SparkSession, d: str) -> DataFrame:
    e = scaled(spark, d).withColumn("endpoint", F.col("user_id") % 8).withColumn("op", F.when(F.col("event_type") == "error", "congestion").otherwise("success"))
    r = flow.aimd(e, ["endpoint"], ["ms", "event_id"], "sms", "op", "value", AIMD)
    return r.select("event_id", "rate", "action")


def aimd_p95(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d).where("event_type <> 'error'").withColumn("endpoint", F.col("user_id") % 8)
    return flow.aimd_p95(e, ["endpoint"], ["ms", "event_id"], "value").select("event_id", "p95")


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    pages = F.when(F.col("event_type").isin("click", "view"), 1 + F.col("event_id") % 20).otherwise(0).cast("int")
    return load(spark, d).withColumn("cluster", F.col("user_id") % 4).withColumn("pages", pages).withColumn("drained", F.when(F.col("pages") == 0, 12).otherwise(0))


def admission(spark: SparkSession, d: str) -> DataFrame:
    r = flow.admission(_jobs(spark, d), ["cluster"], ["ms", "event_id"], "pages", "drained", HIGH, LOW)
    return r.select("event_id", "admitted", "depth", "shedding")


def admission_observed(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("cluster").orderBy("ms", "event_id")
    j = _jobs(spark, d).withColumn("depth", F.sum(F.col("pages") - F.col("drained")).over(w))
    return flow.admission_observed(j, ["cluster"], ["ms", "event_id"], "depth", HIGH, LOW).select("event_id", F.col("depth").cast("bigint").alias("depth"), "shedding")


def single_flight(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d).withColumn("failed", F.col("event_type") == "error")
    return flow.single_flight(e, ["user_id"], ["ms", "event_id"], "ms", "failed", 2 * DAY).select("event_id", "outcome")


def duplicate_calls(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d).withColumn("key", flow.idempotency_key(F.col("user_id"), F.expr(f"ms div {DAY}"), F.col("event_type")))
    return e.groupBy("key").agg(F.count("*").alias("calls")).where("calls > 1")


def idempotency_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", flow.idempotency_key(F.col("l_orderkey"), F.col("l_linenumber"), F.lit("vlm")).alias("key")).distinct()


def retry_classify(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d)
    error = F.element_at(F.array(*map(F.lit, ["http", "circuit_open", "rate_limit_timeout", "timeout", "transport", "other"])), (F.col("event_id") % 6 + 1).cast("int"))
    status = F.element_at(F.array(*map(F.lit, [400, 404, 408, 425, 429, 500, 501, 502, 503, 504])), (F.expr("event_id div 6") % 10 + 1).cast("int"))
    return e.select("event_id", flow.classify(error, status).alias("disposition"))


def backoff_ceiling(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d).select("event_id", flow.backoff_ceiling_ms(F.col("event_id") % 8).alias("ceiling_ms"), flow.backoff_ms(F.col("event_id") % 8, F.when(F.col("event_id") % 3 == 0, F.col("value")), F.lit(0.5)).alias("middle_ms"))


def retry_after(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d)
    exact = F.when(F.col("event_id") % 3 == 0, F.round("value", 2).cast("string"))
    seconds = F.when(F.col("event_id") % 3 == 1, (F.col("event_id") % 9 - 2).cast("string")).when(F.col("event_id") % 3 == 2, "Wed, 21 Oct 2015 07:28:00 GMT")
    return e.select("event_id", flow.retry_after_ms(exact, seconds).alias("after_ms"), flow.retry_after_s(F.col("event_id") % 9000, 4000, F.lit(10.0), F.lit(0.0)).alias("queue_s"))


def chaos_faults(spark: SparkSession, d: str) -> DataFrame:
    """Rules: for a day after each signup of a user, half of its requests (by id) are faulted."""
    e = load(spark, d).select("event_id", F.col("user_id").alias("endpoint"), "ms", "event_type", (F.col("event_id") % 100 / 100).alias("draw"))
    rules = e.where("event_type = 'signup'").select("endpoint", F.col("ms").alias("start_ms"), (F.col("ms") + DAY).alias("end_ms"), F.lit(0.5).alias("ratio"))
    return flow.chaos(e, rules).select("event_id")


def retry_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Attempt numbers of a page's calls, and whether the loop may go on."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ms", "event_id")
    e = load(spark, d).withColumn("n", F.row_number().over(w))
    n = EngineConf().retry_attempts
    return e.select("event_id", ((F.col("n") - 1) % n + 1).cast("bigint").alias("attempt"), ((F.col("n") - 1) % n + 1 < n).alias("may_retry"))


def ttl_sweeps(spark: SparkSession, d: str) -> DataFrame:
    return states.ttl_sweeps(load(spark, d), ["user_id"], ["ms", "event_id"], "ms", 3 * DAY).select("event_id", "sweep")


def degraded_pages(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d).where("event_type = 'error'").select("event_id", F.when(F.col("event_id") % 2 == 0, 500 + F.col("event_id") % 5).alias("status"), F.lit("ReadTimeout").alias("error"))
    return states.degrade(e, "status", "error", EngineConf().fallback_confidence).select("event_id", "state", "degraded", "confidence", "fallback_reason")


def gated_calls(spark: SparkSession, d: str) -> DataFrame:
    what = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "throttled").otherwise("ok")
    e = scaled(spark, d).withColumn("endpoint", F.col("user_id") % 8).withColumn("would", what)
    r = flow.gated_calls(e, ["endpoint"], ["ms", "event_id"], "sms", "would", "value", BREAKER)
    return r.groupBy("endpoint", "result", "breaker_state").agg(F.count("*").alias("calls"), F.round(F.min("rate"), 3).alias("least_rate"), F.max("wait_ms").alias("longest_ms"))


def page_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Errors and clicks as retries of their page."""
    retries = commands(spark, d).where("to_state in ('FAILED', 'LAYOUT_DONE')")
    return states.bump_attempts(retries, ["job_id", "page"], ["ms", "event_id"]).select("event_id", "job_id", "page", "attempts")


def token_bucket_ops(spark: SparkSession, d: str) -> DataFrame:
    """Some events peek at the bucket or reset it."""
    op = F.when(F.col("event_id") % 101 == 0, "reset").when(F.col("event_id") % 7 == 0, "peek").otherwise("acquire")
    r = flow.token_bucket_ops(scaled(spark, d).withColumn("op", op), ["event_type"], ["ms", "event_id"], "sms", "op", **BUCKET)
    return r.select("event_id", "op", "granted", "wait_ms", F.round("tokens", 6).alias("tokens"))


def bounded_flight(spark: SparkSession, d: str) -> DataFrame:
    """Users as calls, with room for eight results for each kind of event."""
    calls = scaled(spark, d).select("event_id", "event_type", "ms", "sms", (F.col("user_id") % 20).cast("string").alias("call"), (F.col("event_id") % 11 == 0).alias("bad"))
    return flow.bounded_flight(calls, ["event_type"], ["ms", "event_id"], "call", "sms", "bad", ttl_ms=40, most=8).select("event_id", "outcome", "held")


_F = (page_attempts, token_bucket_ops, bounded_flight, ttl_sweeps, degraded_pages, gated_calls, transition_relation, state_sets, state_machine, state_counts, job_progress, job_complete, accepted_events, forced_pages, page_outcomes, token_bucket_bounded, token_bucket_no_wait, token_bucket_reserve, breaker, aimd, aimd_p95, admission, admission_observed, single_flight, duplicate_calls, idempotency_keys, retry_classify, backoff_ceiling, retry_after, chaos_faults, retry_attempts)
QUERIES = {f.__name__: f for f in _F}

_E = f"e as (select *, epoch_us(ts) // 1000 as ms, epoch_us(ts) // 3600000 as sms, epoch_us(ts) // {DAY * 1000} as day from events)"
_PRED = " ".join(f"when '{s}' then [{', '.join(repr(p) for p in sorted(C.PREDECESSORS[s]))}]" for s in ASKS.values())
_TERMINAL = ", ".join(f"'{s}'" for s in sorted(C.TERMINAL))
_RUN = f"""with recursive {_E},
c as (select user_id as job_id, day as page, ms, event_id, case event_type {' '.join(f"when '{k}' then '{v}'" for k, v in ASKS.items())} end as to_state,
  row_number() over (partition by user_id, day order by ms, event_id) as r from e),
walk(job_id, page, r, ms, event_id, ok, observed, already_applied, state) as (
  select distinct job_id, page, 0::bigint, 0::bigint, null::bigint, false, '', false, 'PENDING' from c
  union all
  select c.job_id, c.page, c.r, c.ms, c.event_id, list_contains(case c.to_state {_PRED} end, w.state), w.state,
    w.state = c.to_state and not list_contains(case c.to_state {_PRED} end, w.state),
    case when list_contains(case c.to_state {_PRED} end, w.state) then c.to_state else w.state end
  from walk w join c on c.job_id = w.job_id and c.page = w.page and c.r = w.r + 1),
a as (select * from walk where r > 0),
last as (select job_id, page, max_by(state, r) as state from a group by all)"""


def _bucket_sql(wait: float) -> str:
    full = "least(5.0::double, w.tokens + greatest(0, k.sms - w.at_) * 2.0::double / 1000)"
    return f"""with recursive {_E}, k as (select event_type, event_id, sms, row_number() over (partition by event_type order by ms, event_id) as r from e),
walk(event_type, r, event_id, at_, tokens, granted, wait_ms) as (
  select event_type, 0::bigint, null::bigint, min(sms), 5.0::double, false, 0::bigint from k group by event_type
  union all
  select event_type, r, event_id, greatest(sms, was), t - case when t >= 1 or need <= {wait} then 1 else 0 end, t >= 1 or need <= {wait}, case when t >= 1 then 0 else need end
  from (select *, ceil((1 - t) * 1000 / 2.0::double)::bigint as need from (select k.*, w.at_ as was, {full} as t from walk w join k on k.event_type = w.event_type and k.r = w.r + 1)))"""


def _breaker_sql() -> str:
    c = BREAKER
    return f"""with recursive {_E}, k as (select user_id % 8 as ep, event_id, sms, case when event_type = 'error' then 'failure' when event_type in ('purchase', 'click') then 'success' else 'allow' end as op,
  row_number() over (partition by user_id % 8 order by ms, event_id) as r from e),
walk(ep, r, event_id, st, since, f, s, opened, probes, good, admitted, retry_ms) as (
  select ep, 0::bigint, null::bigint, 'closed', min_by(sms, r), 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, true, 0::bigint from k group by ep
  union all
  select ep, r, event_id,
    case when op = 'success' and st = 'half_open' and good + 1 >= {c.breaker_probe_successes} then 'closed' when op = 'failure' and (st = 'half_open' or (f + 1 + s >= {c.breaker_min_volume} and (f + 1)::double / (f + 1 + s) >= {c.breaker_failure_ratio})) then 'open' else st end,
    case when op = 'success' and st = 'half_open' and good + 1 >= {c.breaker_probe_successes} then sms else since end,
    case when op = 'success' and st = 'half_open' and good + 1 >= {c.breaker_probe_successes} then 0 when op = 'failure' and st <> 'half_open' then f + 1 else f end,
    case when op = 'success' and st = 'half_open' and good + 1 >= {c.breaker_probe_successes} then 0 when op = 'success' and st <> 'half_open' then s + 1 else s end,
    case when op = 'success' and st = 'half_open' and good + 1 >= {c.breaker_probe_successes} then 0 when op = 'failure' and (st = 'half_open' or (f + 1 + s >= {c.breaker_min_volume} and (f + 1)::double / (f + 1 + s) >= {c.breaker_failure_ratio})) then sms else opened end,
    case when st <> 'half_open' then probes when op = 'allow' and probes < {c.breaker_max_probes} then probes + 1 when op = 'success' and good + 1 >= {c.breaker_probe_successes} then 0 when op = 'success' then greatest(0, probes - 1) else probes end,
    case when st = 'half_open' and op = 'success' then case when good + 1 >= {c.breaker_probe_successes} then 0 else good + 1 end else good end,
    not (op = 'allow' and (st = 'open' or (st = 'half_open' and probes >= {c.breaker_max_probes}))),
    case when op = 'allow' and st = 'open' then greatest(0, {c.breaker_cooldown_ms} - (sms - opened)) when op = 'allow' and st = 'half_open' and probes >= {c.breaker_max_probes} then {c.breaker_cooldown_ms // 4} else 0 end
  from (select ep, r, event_id, sms, op, case when half then 'half_open' else st end as st, case when fresh then sms else since end as since, case when fresh then 0 else f end as f, case when fresh then 0 else s end as s, opened, case when half then 0 else probes end as probes, case when half then 0 else good end as good
    from (select k.*, w.st, w.since, w.f, w.s, w.opened, w.probes, w.good, w.st = 'closed' and k.sms - w.since >= {c.breaker_window_ms} as fresh, w.st = 'open' and k.sms - w.opened >= {c.breaker_cooldown_ms} as half from walk w join k on k.ep = w.ep and k.r = w.r + 1)))
select event_id, admitted, retry_ms, st as breaker_state from walk where r > 0"""


def _aimd_sql() -> str:
    c = AIMD
    return f"""with recursive {_E}, ok as (select user_id % 8 as ep, event_id, list_sort(list(value) over (partition by user_id % 8 order by ms, event_id rows between {c.aimd_ring - 1} preceding and current row)) as ring from e where event_type <> 'error'),
q as (select event_id, case when len(ring) >= {c.aimd_min_samples} then ring[ceil(0.95 * len(ring))::int] end as p95 from ok),
k as (select user_id % 8 as ep, e.event_id, sms, event_type = 'error' as bad, coalesce(p95 > {c.aimd_slo_ms}, false) as slow, row_number() over (partition by user_id % 8 order by ms, e.event_id) as r from e left join q using (event_id)),
walk(ep, r, event_id, rate, streak, cut, action) as (
  select distinct ep, 0::bigint, null::bigint, {c.aimd_max_rate}::double, 0::bigint, null::bigint, '' from k
  union all
  select ep, r, event_id,
    case when action = 'decrease' then greatest(rate * {c.aimd_decrease}::double, case when bad then {c.aimd_min_rate}::double else {c.aimd_max_rate * c.aimd_latency_floor}::double end) when action = 'increase' then least(rate + {c.aimd_increase}::double, {c.aimd_max_rate}::double) else rate end,
    case when bad or slow or streak + 1 >= {c.aimd_successes} then 0 else streak + 1 end, case when action = 'decrease' then sms else cut end, action
  from (select k.*, w.rate, w.streak, w.cut, case when k.bad or k.slow then case when w.cut is not null and k.sms - w.cut < {c.aimd_refractory_ms} then 'refractory' else 'decrease' end when w.streak + 1 >= {c.aimd_successes} and w.rate < {c.aimd_max_rate} then 'increase' else 'steady' end as action
    from walk w join k on k.ep = w.ep and k.r = w.r + 1))
select event_id, round(rate, 3) as rate, action from walk where r > 0"""


_JOBS = f"{_E}, k as (select user_id % 4 as cl, event_id, ms, case when event_type in ('click', 'view') then 1 + event_id % 20 else 0 end as pages, case when event_type in ('click', 'view') then 0 else 12 end as drained, row_number() over (partition by user_id % 4 order by ms, event_id) as r from e)"

ORACLES = {
    "ttl_sweeps": f"""with recursive {_E}, k as (select user_id, event_id, ms, row_number() over (partition by user_id order by ms, event_id) as r from e),
walk(user_id, r, event_id, at_, sweep) as (select user_id, r, event_id, ms, false from k where r = 1 union all select k.user_id, k.r, k.event_id, case when k.ms - w.at_ > {3 * DAY // 2} then k.ms else w.at_ end, k.ms - w.at_ > {3 * DAY // 2} from walk w join k on k.user_id = w.user_id and k.r = w.r + 1)
select event_id, sweep from walk""",
    "degraded_pages": "select event_id, 'FALLBACK_DONE' as state, 1 as degraded, 0.4::double as confidence, case when event_id % 2 = 0 then 'HTTP ' || (500 + event_id % 5) else 'ReadTimeout' end as fallback_reason from events where event_type = 'error'",
    "transition_relation": "select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in (("PENDING", "LAYOUT_RUNNING"), ("PENDING", "FAILED"), ("LAYOUT_RUNNING", "LAYOUT_DONE"), ("LAYOUT_RUNNING", "PENDING"), ("LAYOUT_RUNNING", "FAILED"), ("LAYOUT_DONE", "VLM_RUNNING"), ("LAYOUT_DONE", "FALLBACK_DONE"), ("VLM_RUNNING", "DONE"), ("VLM_RUNNING", "LAYOUT_DONE"), ("VLM_RUNNING", "FALLBACK_DONE"), ("VLM_RUNNING", "FAILED"))) + ") t(from_state, to_state)",
    "state_sets": "select * from (values ('PENDING', false, false, null, 'LAYOUT_RUNNING'), ('LAYOUT_RUNNING', false, true, 'PENDING', 'PENDING'), ('LAYOUT_DONE', false, false, null, 'LAYOUT_RUNNING,VLM_RUNNING'), ('VLM_RUNNING', false, true, 'LAYOUT_DONE', 'LAYOUT_DONE'), ('DONE', true, false, null, 'VLM_RUNNING'), ('FALLBACK_DONE', true, false, null, 'LAYOUT_DONE,VLM_RUNNING'), ('FAILED', true, false, null, 'LAYOUT_RUNNING,PENDING,VLM_RUNNING')) t(state, terminal, running, checkpoint, predecessors)",
    "state_machine": _RUN + " select event_id, ok, observed, already_applied, state from a",
    "state_counts": _RUN + " select job_id, state, count(*)::bigint as pages from last group by all",
    "job_progress": _RUN + f" select job_id, count(*) filter (where state in ({_TERMINAL}))::bigint as done, count(*)::bigint as total, count(*) filter (where state in ({_TERMINAL})) >= count(*) as complete from last group by job_id",
    "job_complete": _RUN + f", t as (select job_id, count(distinct page) // 2 as total_pages from a group by 1), d as (select job_id, count(*)::bigint as done_count, max(row(ms, event_id)) as l from a where ok and state in ({_TERMINAL}) group by 1) select d.job_id, done_count, total_pages::bigint as total_pages, l[1] as ms, l[2] as event_id from d join t using (job_id) where done_count >= total_pages",
    "accepted_events": _RUN + f" select event_id, job_id, page, case when state = 'LAYOUT_DONE' then 'page.partial' else 'page.final' end as event from a where ok and (state = 'LAYOUT_DONE' or state in ({_TERMINAL}))",
    "forced_pages": _RUN + " select job_id, page, state, case state when 'PENDING' then 'FAILED' when 'LAYOUT_RUNNING' then 'FAILED' when 'LAYOUT_DONE' then 'FALLBACK_DONE' when 'VLM_RUNNING' then 'FALLBACK_DONE' end as forced, case state when 'LAYOUT_RUNNING' then 'PENDING' when 'VLM_RUNNING' then 'LAYOUT_DONE' end as released from last",
    "page_outcomes": "with x as (select event_id, ['PENDING', 'LAYOUT_RUNNING', 'LAYOUT_DONE', 'VLM_RUNNING', 'DONE'][event_id % 5 + 1] as s, event_id % 2 = 0 as re, event_id % 7 <> 0 as lay, ['ok', 'saturated', 'error'][event_id % 3 + 1] as v, value >= 90 or event_id % 400 + 1 >= 360 as fin, event_id % 11 = 0 as hand from events), y as (select *, case when re and s = 'LAYOUT_RUNNING' then 'PENDING' when re and s = 'VLM_RUNNING' then 'LAYOUT_DONE' else s end as b from x) select event_id, fin as final_attempt, case when s = 'DONE' then 'ALREADY_TERMINAL' when s in ('LAYOUT_RUNNING', 'VLM_RUNNING') and not re then 'OWNED_BY_OTHER' when b = 'PENDING' and not lay then 'FAILED' when b = 'PENDING' and hand then 'HANDOFF' when v = 'ok' then case when b = 'LAYOUT_DONE' then 'RESUMED' else 'COMPLETED' end when v = 'saturated' and not fin then 'SATURATED' else 'DEGRADED' end as outcome from y",
    "token_bucket_bounded": _bucket_sql(3000) + " select event_id, granted, wait_ms, round(tokens, 6) as tokens from walk where r > 0",
    "page_attempts": f"with {_E} select event_id, user_id as job_id, day as page, row_number() over (partition by user_id, day order by ms, event_id) as attempts from e where event_type in ('error', 'click')",
    "token_bucket_ops": f"""with recursive {_E}, k as (select event_type, event_id, sms, case when event_id % 101 = 0 then 'reset' when event_id % 7 = 0 then 'peek' else 'acquire' end as op, row_number() over (partition by event_type order by ms, event_id) as r from e),
walk(event_type, r, event_id, op, at_, left_, granted, wait_ms, tokens) as (
  select distinct event_type, 0::bigint, null::bigint, null::varchar, null::bigint, null::double, false, 0::bigint, 0::double from k
  union all
  select event_type, r, event_id, op, case when op = 'reset' then null else greatest(sms, coalesce(was, sms)) end, case op when 'reset' then null when 'peek' then t else t - case when ok then 1 else 0 end end,
    op = 'reset' or ok, case when op = 'reset' or t >= cost then 0 else need end, case op when 'reset' then 5.0 when 'peek' then t else t - case when ok then 1 else 0 end end
  from (select *, t >= cost or need <= most as ok from (select *, ceil((cost - t) * 1000 / 2.0::double)::bigint as need from (
    select k.*, w.at_ as was, case when w.left_ is null then 5.0::double else least(5.0::double, w.left_ + greatest(0, k.sms - w.at_) * 2.0::double / 1000) end as t, case when k.op = 'peek' then 0 else 1 end as cost, case when k.op = 'peek' then 0 else 3000 end as most
    from walk w join k on k.event_type = w.event_type and k.r = w.r + 1))))
select event_id, op, granted, wait_ms, round(tokens, 6) as tokens from walk where r > 0""",
    "token_bucket_no_wait": _bucket_sql(0) + " select event_type, count(*) filter (where granted)::bigint as granted, count(*) filter (where not granted)::bigint as refused from walk where r > 0 group by event_type",
    "token_bucket_reserve": f"with {_E}, k as (select event_id, event_type, ms, (sms - min(sms) over (partition by event_type)) * 2.0::double / 1000 as t, row_number() over (partition by event_type order by ms, event_id) as n from e), b as (select *, t - n + min(5.0::double - t + n - 1) over (partition by event_type order by ms, event_id rows unbounded preceding) as tokens from k) select event_id, round(tokens, 6) as tokens, greatest(0, ceil(round(-tokens * 1000 / 2.0::double, 6)))::bigint as wait_ms from b",
    "breaker": _breaker_sql(),
    "aimd": _aimd_sql(),
    "aimd_p95": f"with {_E}, o as (select event_id, list_sort(list(value) over (partition by user_id % 8 order by ms, event_id rows between 99 preceding and current row)) as ring from e where event_type <> 'error') select event_id, case when len(ring) >= 20 then ring[ceil(0.95 * len(ring))::int] end as p95 from o",
    "admission": f"""with recursive {_JOBS},
walk(cl, r, event_id, depth, shed, admitted) as (
  select distinct cl, 0::bigint, null::bigint, 0::bigint, false, null::boolean from k
  union all
  select cl, r, event_id, d + case when pages > 0 and not s and d + pages <= {HIGH} then pages else 0 end, case when pages = 0 then was else s or d + pages > {HIGH} end, case when pages > 0 then not s and d + pages <= {HIGH} end
  from (select *, was and (pages = 0 or d > {LOW}) as s from (select k.*, greatest(0, w.depth - k.drained) as d, w.shed as was from walk w join k on k.cl = w.cl and k.r = w.r + 1)))
select event_id, admitted, depth, shed as shedding from walk where r > 0""",
    "admission_observed": f"with {_JOBS}, s as (select cl, event_id, r, sum(pages - drained) over (partition by cl order by r)::bigint as depth from k) select event_id, depth, coalesce(last_value(case when depth >= {HIGH} then true when depth <= {LOW} then false end ignore nulls) over (partition by cl order by r), false) as shedding from s",
    "single_flight": f"""with recursive {_E}, k as (select user_id, event_id, ms, event_type = 'error' as bad, row_number() over (partition by user_id order by ms, event_id) as r from e),
walk(user_id, r, event_id, done, outcome) as (
  select distinct user_id, 0::bigint, null::bigint, null::bigint, '' from k
  union all
  select k.user_id, k.r, k.event_id, case when w.done is not null and k.ms - w.done < {2 * DAY} then w.done when k.bad then null else k.ms end, case when w.done is not null and k.ms - w.done < {2 * DAY} then 'replayed' when k.bad then 'failed' else 'executed' end
  from walk w join k on k.user_id = w.user_id and k.r = w.r + 1)
select event_id, outcome from walk where r > 0""",
    "duplicate_calls": f"with {_E} select left(sha256(concat_ws(':', user_id, day, event_type)), 32) as key, count(*)::bigint as calls from e group by 1 having count(*) > 1",
    "idempotency_keys": "select distinct l_orderkey, l_linenumber, left(sha256(concat_ws(':', l_orderkey, l_linenumber, 'vlm')), 32) as key from lineitem",
    "retry_classify": "with x as (select event_id, ['http', 'circuit_open', 'rate_limit_timeout', 'timeout', 'transport', 'other'][event_id % 6 + 1] as e, [400, 404, 408, 425, 429, 500, 501, 502, 503, 504][(event_id // 6) % 10 + 1] as s from events) select event_id, case e when 'circuit_open' then 'CIRCUIT_OPEN' when 'rate_limit_timeout' then 'SATURATED' when 'http' then case when s in (408, 425, 429, 500, 502, 503, 504) then 'RETRY' else 'PERMANENT' end when 'timeout' then 'RETRY' when 'transport' then 'RETRY' else 'PERMANENT' end as disposition from x",
    "backoff_ceiling": "select event_id, least(5000, 200 * 2 ** (event_id % 8))::double as ceiling_ms, case when event_id % 3 = 0 then value + 100 else least(5000, 200 * 2 ** (event_id % 8)) / 2 end::double as middle_ms from events",
    "retry_after": "select event_id, case event_id % 3 when 0 then greatest(0, round(value, 2)) when 1 then greatest(0, (event_id % 9 - 2) * 1000)::double end as after_ms, least(300, greatest(1, ceil(greatest(0, event_id % 9000 - 4000) / 10.0)))::bigint as queue_s from events",
    "chaos_faults": f"with {_E} select event_id from e where event_id % 100 / 100.0 < 0.5 and exists (select 1 from e s where s.event_type = 'signup' and s.user_id = e.user_id and e.ms >= s.ms and e.ms < s.ms + {DAY})",
    "retry_attempts": f"with {_E}, k as (select event_id, row_number() over (partition by user_id, event_type order by ms, event_id) as n from e) select event_id, ((n - 1) % 3 + 1)::bigint as attempt, (n - 1) % 3 + 1 < 3 as may_retry from k",
}
