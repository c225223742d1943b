"""Queues, result streams and metrics bound to orders, order lines and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import EngineConf
from ..functions import controllers as C
from ..operators import metrics as M
from ..operators import queueing as Q
from ..operators import results as R
from ..operators import states
from ..sources.tables import events as load
from ..sources.tables import quarantine as split
from ..sources.tables import table

CONF = EngineConf()
DAY = 86_400_000


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as page tasks of their orders."""
    l = table(spark, d, "lineitem").withColumn("page_index", F.col("l_linenumber") - 1)
    return l.withColumn("lane", Q.lane(F.col("page_index"))).withColumn("consumer", F.col("l_suppkey") % 16)


def init_jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "part").select(F.col("p_partkey").alias("job_id"), "p_size")
    return Q.init_job(jobs, "p_size").select("job_id", F.col("page_index").cast("bigint").alias("page_index"), "state", "lane")


def lanes(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d).groupBy("lane").agg(F.count("*").alias("tasks"))


def claims(spark: SparkSession, d: str) -> DataFrame:
    c = Q.claim(_tasks(spark, d), ["consumer"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], 100)
    return c.groupBy("consumer", "lane").agg(F.count("*").alias("taken"), F.max("l_orderkey").alias("last"))


def dispatch_budget(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d).select("event_id", (1 + F.col("event_id") % 16).alias("c"), (F.col("event_id") % 20).alias("f"))
    lead, main = Q.lane_budgets(F.col("c"), F.col("f"))
    return e.select("event_id", lead.cast("bigint").alias("lead_budget"), main.cast("bigint").alias("main_budget"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Events as deliveries: each kind is a lane, a user a consumer."""
    e = load(spark, d).withColumn("lane", F.when(F.col("event_type") == "click", "lead").otherwise("main")).withColumn("consumer", F.col("user_id") % 16)
    return e.withColumn("delivered", F.col("event_id") % 5 != 0).withColumn("acked", F.col("event_id") % 3 == 0)


def queue_depth(spark: SparkSession, d: str) -> DataFrame:
    return Q.depth(_entries(spark, d), ["lane"])


def queue_depth_total(spark: SparkSession, d: str) -> DataFrame:
    return Q.depth(_entries(spark, d), [])


def _pending(spark: SparkSession, d: str) -> DataFrame:
    p = _entries(spark, d).where("delivered and not acked")
    now = F.lit(1_706_745_600_000)
    return p.withColumn("idle_ms", Q.idle_ms(now, F.col("ms"), F.when(F.col("event_id") % 4 == 0, F.col("ms") + 3_600_000)))


def consumers(spark: SparkSession, d: str) -> DataFrame:
    p = _pending(spark, d)
    return p.groupBy("lane", "consumer").agg(F.count("*").alias("pending"), F.min("idle_ms").alias("idle_ms"), F.count_if(F.col("idle_ms") >= 5 * DAY).alias("orphaned"))


def orphans(spark: SparkSession, d: str) -> DataFrame:
    return Q.orphans(_pending(spark, d), F.lit(3), 5 * DAY, CONF.reaper_batch, ["ms", "event_id"]).select("lane", "event_id", "consumer", "idle_ms")


def own_pending(spark: SparkSession, d: str) -> DataFrame:
    return Q.own_pending(_pending(spark, d), "consumer", ["ms", "event_id"], 20).select("consumer", "lane", "event_id", "recovered")


def requeued(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d).select("event_id", F.col("ms").alias("enqueued_ms"), F.when(F.col("event_id") % 2 == 0, F.col("ms") - 1000).alias("first_enqueued_ms"), (F.col("event_id") % 4).alias("attempt"), F.lit("lead").alias("lane"), (F.col("event_id") % 3 == 0).alias("h"))
    return Q.requeue(t, F.lit(1_706_745_600_000), F.col("h")).select("event_id", "lane", "attempt", "enqueued_ms", "first_enqueued_ms")


def unacked(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d)
    return Q.unacked(e.where("delivered"), e.where("acked"), ["lane", "event_id"]).select("lane", "event_id")


def task_ages(spark: SparkSession, d: str) -> DataFrame:
    now, first = F.lit(1_705_000_000_000), F.when(F.col("event_id") % 2 == 0, F.col("ms") - 1000)
    return load(spark, d).select("event_id", Q.age_ms(now, first, F.col("ms")).alias("age_ms"), Q.lag_ms(now, F.col("ms")).alias("lag_ms"))


def _fields(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stream entries with text fields, some of them malformed."""
    k = F.get_json_object("props", "$.k")
    e = load(spark, d).select("event_id", F.when(F.col("event_id") % 17 != 0, F.col("user_id").cast("string")).alias("job_id"), F.when(F.col("event_id") % 13 == 0, F.concat(k, F.lit("x"))).otherwise(k).alias("page_index"), F.when(F.col("event_id") % 19 != 0, F.col("ms").cast("string")).alias("enqueued_at_ms"))
    return split(e, {"job_id": "job_id is not null", "page_index": "try_cast(page_index as int) >= 0", "enqueued_at_ms": "try_cast(enqueued_at_ms as bigint) is not null"})


def quarantine(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d)[1].select("event_id", "reject_reason")


def parsed_tasks(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d)[0].select("event_id", F.col("job_id").cast("bigint").alias("job_id"), F.col("page_index").cast("bigint").alias("page_index"))


def reaper_actions(spark: SparkSession, d: str) -> DataFrame:
    """Lines as orphans, orders as the page states they refer to."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderstatus") == "P", "VLM_RUNNING").otherwise("PENDING").alias("state")).where("o_orderkey % 10 <> 0")
    t = _tasks(spark, d).join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    action = Q.reap(F.col("state"), F.col("state").isin(*C.TERMINAL), F.col("l_quantity") * 10_000, F.col("l_linenumber") * 52, CONF.page_deadline_s * 1000, CONF.effective_max_requeues)
    return t.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


def ack_policy(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.element_at(F.array(*map(F.lit, ["HANDOFF", "SATURATED", "CRASHED", "COMPLETED", "FAILED"])), (F.col("event_id") % 5 + 1).cast("int"))
    return load(spark, d).select("event_id", Q.ack_policy(outcome, F.when(F.col("event_id") % 2 == 0, F.col("value") / 100)).alias("a")).select("event_id", "a.action", "a.pause_s")


def document_sweep(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("../"), F.col("p_partkey"))).otherwise(F.concat(F.lit("doc-"), F.col("p_partkey")))
    files = table(spark, d, "part").select(name.alias("name"), (F.col("p_size") * 40).alias("age_s"))
    jobs = table(spark, d, "supplier").select(F.concat(F.lit("doc-"), F.col("s_suppkey")).alias("name"))
    return Q.stale_documents(files, jobs, CONF.document_age_s).select("name")


# result streams ------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """A user is a job; its events by hour are its results."""
    kind = F.when(F.col("event_type") == "purchase", "page.final").otherwise("page.partial")
    e = load(spark, d).select(F.col("user_id").alias("job_id"), "event_id", F.expr("ms div 3600000").alias("hour"), "ms", kind.alias("event"), F.create_map(F.lit("page"), F.col("event_id").cast("string")).alias("data"))
    return R.publish(e, "job_id", ["ms", "event_id"], "hour")


def result_seq(spark: SparkSession, d: str) -> DataFrame:
    return _stream(spark, d).select("event_id", "seq", "entry_id")


def entry_ids(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d)
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), F.col("event_id"))).when(F.col("event_id") % 5 == 1, F.concat(F.lit(" "), F.col("ms"), F.lit("-"), F.col("event_id"), F.lit(" "))).otherwise(F.concat(F.col("ms"), F.lit("-"), F.col("event_id") % 11))
    return e.select("event_id", R.parse_id(text).alias("i")).select("event_id", "i.ms", "i.n")


def result_window_gap(spark: SparkSession, d: str) -> DataFrame:
    s = _stream(spark, d)
    w = R.window(R.retained(s, "job_id", 20), "job_id")
    cursor = s.groupBy("job_id").agg(F.max_by("id", F.when(F.col("seq") <= F.col("job_id") % 60 + 1, F.col("seq"))).alias("cursor"))
    return w.join(cursor, "job_id").select("job_id", F.concat_ws("-", "window_lo.ms", "window_lo.n").alias("lo"), F.concat_ws("-", "window_hi.ms", "window_hi.n").alias("hi"), R.gap_after(F.col("cursor"), F.col("window_lo")).alias("gap"))


def history(spark: SparkSession, d: str) -> DataFrame:
    s = R.retained(_stream(spark, d), "job_id", CONF.result_maxlen)
    cursors = s.where(F.col("seq") == F.col("job_id") % 40 + 1).select("job_id", F.col("id").alias("cursor"))
    return R.history(s, cursors, "job_id", 10).select("job_id", "event_id", "seq")


def tail(spark: SparkSession, d: str) -> DataFrame:
    """Three readers a job, one of them with an id that says nothing."""
    s = _stream(spark, d)
    readers = s.where(F.col("seq").isin(1, 5, 9)).select("job_id", "seq", F.when(F.col("seq") == 9, F.lit("none")).otherwise(F.col("entry_id")).alias("last_id")).select("job_id", F.col("seq").alias("reader"), "last_id")
    return R.tail(s, readers, "job_id", "reader", "last_id", 6).select("job_id", "reader", "event_id", "seq")


def _resume(spark: SparkSession, d: str) -> DataFrame:
    s = _stream(spark, d)
    kept = R.retained(s, "job_id", 20)
    cursors = s.where(F.col("seq") == F.col("job_id") % 60 + 1).select("job_id", F.col("id").alias("cursor"))
    progress = s.groupBy("job_id").agg(F.count_if(F.col("event") == "page.final").alias("done"), F.lit(12).cast("bigint").alias("total_pages"))
    return R.resume(kept, progress, cursors, "job_id", CONF.result_history, CONF.result_retry_ms)


def resume_frames(spark: SparkSession, d: str) -> DataFrame:
    return _resume(spark, d)


def resume_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _resume(spark, d).groupBy("job_id", "kind").agg(F.count("*").alias("frames"))


def stream_completeness(spark: SparkSession, d: str) -> DataFrame:
    totals = load(spark, d).select(F.col("user_id").alias("job_id")).distinct().withColumn("total_pages", F.col("job_id") % 60 + 20)
    return R.completeness(_stream(spark, d), "job_id", totals)


def subscriber_slots(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d).withColumn("op", F.when(F.col("event_type").isin("error", "signup"), "release").otherwise("acquire")).withColumn("g", F.col("user_id") % 4)
    return R.subscriber_slots(e, ["g"], ["ms", "event_id"], "op", CONF.subscriber_slots).select("event_id", "served", "held")


# metrics -------------------------------------------------------------------------------------


def histogram_cumulative(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d).withColumn("s", F.col("value") / 10)
    h = M.histogram(e, ["event_type"], "s")
    return h.select("event_type", F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.format_string("%.3f", "le")).alias("le"), "bucket", F.round("sum", 6).alias("sum"), "count")


def counter_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Running totals that restart every so often."""
    e = load(spark, d).withColumn("total", F.col("event_id") % 500)
    return M.counter_deltas(e, ["user_id"], ["ms", "event_id"], "total").select("event_id", "delta")


def counter_totals(spark: SparkSession, d: str) -> DataFrame:
    return M.counter_total(load(spark, d).withColumn("one", F.lit(1).cast("bigint")), ["event_type"], "one")


def gauge_sum(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d)
    g = M.gauge_sum(e, ["event_type"], "user_id", ["ms", "event_id"], "ms", "value", F.lit(1_706_400_000_000), 3 * DAY)
    return g.select("event_type", F.round("value", 6).alias("value"), "workers")


def exposition(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d).groupBy("event_type").agg(F.count("*").cast("double").alias("v"))
    samples = c.select(F.lit("pages_total").alias("family"), F.lit("pages_total").alias("name"), F.create_map(F.lit("kind"), F.col("event_type"), F.lit("a"), F.lit('q"\\')).alias("labels"), F.col("v").alias("value"), F.col("event_type").alias("ord"))
    families = spark.createDataFrame([("pages_total", "counter", "Pages by\nkind"), ("queue_lag", "gauge", "Lag")], "family string, kind string, help string")
    return M.exposition(samples, families)


def series_keys(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d).select("event_type", (F.col("user_id") % 4).cast("string").alias("w")).distinct()
    key = M.series_key(F.lit("calls"), F.create_map(F.lit("worker"), F.col("w"), F.lit("kind"), F.col("event_type")))
    return e.select(key.alias("k")).select(M.series_name(F.col("k")).alias("name"), F.substring_index("k", M.SEPARATOR, -1).alias("labels"), M.series_labels(F.col("k"))["worker"].alias("worker"))


def percentiles(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d)
    parts = [M.order_statistic(e, ["event_type"], "value", f(q)).withColumn("which", F.lit(f"{n}{int(q * 100)}")) for n, f in (("bench", M.bench_index), ("ttfp", M.ttfp_index)) for q in (0.5, 0.95)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def peak_of_sum(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d).withColumn("hour", F.expr("ms div 3600000"))
    return M.peak_of_sum(e, "hour", "value").select(F.round("peak", 6).alias("peak"))


def size_units(spark: SparkSession, d: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ["GiB", "MiB", "KiB", "GB", "MB", "kB", "B", "pt"])), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.round(M.mebibytes(F.concat(F.col("p_size"), F.lit("."), F.col("p_partkey") % 10, unit, F.lit(" / 1GiB"))), 6).alias("mib"))


def reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Pages admitted, streamed and done for each day, from three sources that should agree."""
    e = load(spark, d).withColumn("day", F.expr(f"ms div {DAY}"))
    n = lambda df: df.groupBy("day").agg(F.count("*").alias("n"))
    return M.reconcile("day", admitted=n(e.where("event_type = 'click'")), streamed=n(e.where("event_type in ('click', 'view') and value < 50")), done=n(e.where("event_type = 'view'")))


def goodput(spark: SparkSession, d: str) -> DataFrame:
    """Finished pages by second of elapsed time; what has merely ended does not count."""
    g = load(spark, d).groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("done"), F.count_if(F.col("event_type").isin("purchase", "error")).alias("ended"), ((F.max("ms") - F.min("ms")) / 1000).alias("s"))
    return g.select("user_id", "done", "ended", F.round(F.when(F.col("s") > 0, F.col("done") / F.when(F.col("s") > 0, F.col("s"))).otherwise(0.0), 12).alias("per_s"))


def no_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Violations of at-most-once: lines executed more than once."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("executions")).where("executions > 1")


def job_status(spark: SparkSession, d: str) -> DataFrame:
    """done, complete and counts by state; a page without a state is MISSING."""
    p = _tasks(spark, d).withColumn("state", F.when(F.col("l_linestatus") == "F", "DONE").when(F.col("l_returnflag") != "N", "PENDING"))
    c = p.groupBy("l_orderkey", F.coalesce("state", F.lit("MISSING")).alias("state")).agg(F.count("*").alias("n"))
    s = c.groupBy("l_orderkey").agg(F.sum(F.when(F.col("state").isin(*C.TERMINAL), F.col("n")).otherwise(0)).alias("done"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("state", "n"))).alias("c"))
    return s.select("l_orderkey", "done", (F.col("done") >= F.col("total")).alias("complete"), F.array_join(F.transform("c", lambda x: F.concat(x.state, F.lit("="), x.n)), ",").alias("state_counts"))


def worker_rates(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d).groupBy(F.col("event_type").alias("outcome")).agg(F.count("*").alias("n"), (F.max("ms") - F.min("ms")).alias("span"))
    return g.select("outcome", "n", F.round(F.col("n") * 1000 / F.col("span"), 9).alias("per_s"))


def lane_balance(spark: SparkSession, d: str) -> DataFrame:
    """Tasks in flight after each start (+1) or end (-1)."""
    from pyspark.sql import Window

    e = load(spark, d).withColumn("g", F.col("user_id") % 8).withColumn("step", F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1))
    w = Window.partitionBy("g").orderBy("ms", "event_id")
    return e.select("event_id", F.sum("step").over(w).cast("bigint").alias("in_flight"))


def queue_lag(spark: SparkSession, d: str) -> DataFrame:
    """Unread entries by lane; not a number where no reader has said."""
    e = _entries(spark, d).withColumn("read", F.when(F.col("lane") == "main", F.col("event_id") % 2))
    return e.groupBy("lane").agg((F.count("*") - F.sum("read")).cast("double").alias("lag")).select("lane", F.coalesce("lag", F.lit(float("nan"))).alias("lag"))


def liveness(spark: SparkSession, d: str) -> DataFrame:
    now = 1_706_400_000_000
    return load(spark, d).groupBy(F.expr("user_id % 4").alias("pool")).agg(F.count_distinct(F.when(F.col("ms") >= now - DAY, F.col("user_id"))).alias("live"))


def endpoint_stats(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d).withColumn("status", F.element_at(F.array(*map(F.lit, [200, 429, 503, 504, None])), (F.col("event_id") % 5 + 1).cast("int")))
    c = M.request_class(F.col("status"), F.when(F.col("event_id") % 2 == 0, "timeout"))
    return e.groupBy("event_type", c.alias("outcome")).agg(F.count("*").alias("n"), F.max(M.breaker_code(F.when(F.col("event_id") % 2 == 0, "open").otherwise("closed"))).cast("bigint").alias("breaker"))


def traces(spark: SparkSession, d: str) -> DataFrame:
    h = F.concat(F.lit(" 00-"), F.upper(F.md5(F.col("event_id").cast("string"))), F.lit("-"), F.substring(F.md5(F.col("user_id").cast("string")), 1, 16), F.when(F.col("event_id") % 4 == 0, "-zz").otherwise("-01"))
    t = load(spark, d).select("event_id", M.traceparent(h).alias("t"))
    return t.select("event_id", "t.trace_id", M.format_traceparent(F.col("t.trace_id"), F.col("t.span_id")).alias("header"))


def submissions(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d).select("event_id", M.page_limit(F.col("event_id") % 120, CONF.max_pages, F.col("user_id") % 3 != 0).cast("bigint").alias("status"))


def terminal_classes(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.element_at(F.array(*map(F.lit, ["COMPLETED", "RESUMED", "DEGRADED", "FAILED", "ALREADY_TERMINAL", "HANDOFF"])), (F.col("event_id") % 6 + 1).cast("int"))
    return load(spark, d).groupBy(M.terminal_class(outcome).alias("class")).agg(F.count("*").alias("n"))


_F = (init_jobs, lanes, claims, dispatch_budget, queue_depth, queue_depth_total, consumers, orphans, own_pending, requeued, unacked, task_ages, quarantine, parsed_tasks, reaper_actions, ack_policy, document_sweep,
      result_seq, entry_ids, result_window_gap, tail, history, resume_frames, resume_kinds, stream_completeness, subscriber_slots,
      histogram_cumulative, counter_deltas, counter_totals, gauge_sum, exposition, series_keys, percentiles, peak_of_sum, size_units, reconcile, goodput, no_duplicates, job_status, worker_rates, lane_balance, queue_lag, liveness, endpoint_stats, traces, submissions, terminal_classes)
QUERIES = {f.__name__: f for f in _F}

_E = f"e as (select *, epoch_us(ts) // 1000 as ms, epoch_us(ts) // {DAY * 1000} as day from events)"
_N = _E + ", n as (select *, case when event_type = 'click' then 'lead' else 'main' end as lane, user_id % 16 as consumer, event_id % 5 <> 0 as delivered, event_id % 3 = 0 as acked from e)"
_P = _N + ", p as (select *, greatest(0, 1706745600000 - greatest(ms, case when event_id % 4 = 0 then ms + 3600000 else ms end)) as idle_ms from n where delivered and not acked)"
_T = "t as (select *, case when l_linenumber = 1 then 'lead' else 'main' end as lane, l_suppkey % 16 as consumer from lineitem)"
_S = _E + ", h as (select user_id as job_id, event_id, ms, ms // 3600000 as hour, event_type, row_number() over (partition by user_id order by ms, event_id) as seq, row_number() over (partition by user_id, ms // 3600000 order by ms, event_id) - 1 as n from e), s as (select *, row(hour, n) as id, hour || '-' || n as entry_id, max(seq) over (partition by job_id) as top from h)"
_Q = _E + ", j as (select event_id, case when event_id % 17 <> 0 then user_id::varchar end as job_id, case when event_id % 13 = 0 then json_extract_string(props, '$.k') || 'x' else json_extract_string(props, '$.k') end as page_index, case when event_id % 19 <> 0 then ms::varchar end as enq from e), r as (select *, case when job_id is null then 'job_id' when coalesce(try_cast(page_index as int), -1) < 0 then 'page_index' when try_cast(enq as bigint) is null then 'enqueued_at_ms' end as reject_reason from j)"
_BOUNDS = ", ".join(f"({b}::double, '{b:.3f}')" for b in M.BUCKETS) + ", ('inf'::double, '+Inf')"


def _rank(kind: str, q: float) -> str:
    at = f"round_even({q} * (c - 1), 0)" if kind == "bench" else f"least(c - 1, floor({q} * c))"
    return f"select event_type, value, '{kind}{int(q * 100)}' as which from (select event_type, value, row_number() over (partition by event_type order by value) - 1 as r, count(*) over (partition by event_type) as c from events) where r = {at}"


ORACLES = {
    "init_jobs": "select p_partkey as job_id, unnest(range(0, p_size)) as page_index, 'PENDING' as state, case when unnest(range(0, p_size)) = 0 then 'lead' else 'main' end as lane from part",
    "lanes": f"with {_T} select lane, count(*)::bigint as tasks from t group by lane",
    "claims": f"with {_T}, r as (select *, row_number() over (partition by consumer order by case lane when 'lead' then 0 else 1 end, l_orderkey, l_linenumber, l_partkey, l_extendedprice) as k from t) select consumer, lane, count(*)::bigint as taken, max(l_orderkey) as last from r where k <= 100 group by all",
    "dispatch_budget": "select event_id, greatest(0, 1 + event_id % 16 - event_id % 20)::bigint as lead_budget, greatest(0, 1 + event_id % 16 - least(4, event_id % 16) - event_id % 20)::bigint as main_budget from events",
    "queue_depth": f"with {_N} select lane, count(*) filter (where not acked)::bigint as stream_length, count(*) filter (where not acked and delivered)::bigint as pending, greatest(0, count(*) filter (where not acked) - count(*) filter (where not acked and delivered))::bigint as backlog from n group by lane",
    "queue_depth_total": f"with {_N} select count(*) filter (where not acked)::bigint as stream_length, count(*) filter (where not acked and delivered)::bigint as pending, count(*) filter (where not acked and not delivered)::bigint as backlog from n",
    "consumers": f"with {_P} select lane, consumer, count(*)::bigint as pending, min(idle_ms) as idle_ms, count(*) filter (where idle_ms >= {5 * DAY})::bigint as orphaned from p group by all",
    "orphans": f"with {_P}, r as (select *, row_number() over (partition by lane order by ms, event_id) as k from p where idle_ms >= {5 * DAY}) select lane, event_id, consumer, idle_ms from r where k <= 64 and consumer <> 3",
    "own_pending": f"with {_P}, r as (select *, row_number() over (partition by consumer order by case lane when 'lead' then 0 else 1 end, ms, event_id) as k from p) select consumer, lane, event_id, true as recovered from r where k <= 20",
    "requeued": f"with {_E} select event_id, 'main' as lane, event_id % 4 + case when event_id % 3 = 0 then 0 else 1 end as attempt, 1706745600000 as enqueued_ms, case when event_id % 2 = 0 then ms - 1000 else ms end as first_enqueued_ms from e",
    "unacked": f"with {_N} select lane, event_id from n where delivered and not acked",
    "task_ages": f"with {_E} select event_id, greatest(0, 1705000000000 - case when event_id % 2 = 0 then ms - 1000 else ms end) as age_ms, greatest(0, 1705000000000 - ms) as lag_ms from e",
    "quarantine": f"with {_Q} select event_id, reject_reason from r where reject_reason is not null",
    "parsed_tasks": f"with {_Q} select event_id, job_id::bigint as job_id, page_index::bigint as page_index from r where reject_reason is null",
    "reaper_actions": "with o as (select o_orderkey, case o_orderstatus when 'F' then 'DONE' when 'P' then 'VLM_RUNNING' else 'PENDING' end as state from orders where o_orderkey % 10 <> 0) select case when state is null then 'expired' when state = 'DONE' then 'already_terminal' when l_quantity * 10000 >= 300000 or l_linenumber * 52 + 1 >= 360 then 'forced_terminal' else 'requeued' end as action, count(*)::bigint as n from lineitem left join o on l_orderkey = o_orderkey group by 1",
    "ack_policy": "select event_id, case event_id % 5 when 0 then 'requeue_same_attempt' when 1 then 'requeue' when 2 then 'release_requeue' else 'ack' end as action, case when event_id % 5 = 1 then least(coalesce(case when event_id % 2 = 0 then value / 100 end, 0.5), 0.5) else 0 end::double as pause_s from events",
    "document_sweep": "with f as (select case when p_partkey % 7 = 0 then '../' || p_partkey else 'doc-' || p_partkey end as name, p_size * 40 as age from part) select name from f where age >= 900 and regexp_full_match(name, '[A-Za-z0-9_-]{1,64}') and name not in (select 'doc-' || s_suppkey from supplier)",
    "result_seq": f"with {_S} select event_id, seq, entry_id from s",
    "entry_ids": f"with {_E} select event_id, case when event_id % 5 <> 0 then ms end as ms, case event_id % 5 when 0 then null when 1 then event_id else event_id % 11 end as n from e",
    "result_window_gap": f"with {_S}, w as (select job_id, min(id) as lo, max(id) as hi, arg_min(entry_id, seq) as l, arg_max(entry_id, seq) as h from s where seq > top - 20 group by 1), c as (select job_id, arg_max(id, seq) as cur from s where seq <= job_id % 60 + 1 group by 1) select job_id, l as lo, h as hi, cur < lo as gap from w join c using (job_id)",
    "tail": f"with {_S}, r as (select job_id, seq as reader, case when seq <> 9 then id end as after_ from s where seq in (1, 5, 9)), k as (select s.job_id, reader, event_id, seq, row_number() over (partition by s.job_id, reader order by id) as i from s join r using (job_id) where after_ is null or id > after_) select job_id, reader, event_id, seq from k where i <= 6",
    "history": f"with {_S}, k as (select * from s where seq > top - 256), c as (select job_id, id as cur from k where seq = job_id % 40 + 1), r as (select k.*, row_number() over (partition by k.job_id order by k.id) as i from k join c using (job_id) where k.id > cur) select job_id, event_id, seq from r where i <= 10",
    "resume_kinds": f"with {_S}, c as (select job_id, seq as cur from s where seq = job_id % 60 + 1), g as (select job_id, cur, max(top) as top, cur <= max(top) - 20 as gap, count(*) filter (where event_type = 'purchase') as done from s join c using (job_id) group by 1, 2), f as (select job_id, 'retry' as kind from g union all select job_id, 'stream.open' from g union all select job_id, 'stream.gap' from g where gap union all select job_id, 'job.complete' from g where done >= 12 union all select s.job_id, case when event_type = 'purchase' then 'page.final' else 'page.partial' end from s join g using (job_id) where s.seq > s.top - 20 and (gap or s.seq > cur)) select job_id, kind, count(*)::bigint as frames from f group by all",
    "stream_completeness": f"with {_S} select job_id, count(*)::bigint as entries, (2 * (job_id % 60 + 20) + 1)::bigint as expected, count(*) = 2 * (job_id % 60 + 20) + 1 and max(seq) = count(*) as whole from s group by job_id",
    "subscriber_slots": f"""with recursive {_E}, k as (select user_id % 4 as g, event_id, event_type in ('error', 'signup') as rel, row_number() over (partition by user_id % 4 order by ms, event_id) as r from e),
walk(g, r, event_id, served, held) as (select distinct g, 0::bigint, null::bigint, false, 0::bigint from k union all select k.g, k.r, k.event_id, k.rel or w.held < 64, case when k.rel then greatest(0, w.held - 1) when w.held < 64 then w.held + 1 else w.held end from walk w join k on k.g = w.g and k.r = w.r + 1)
select event_id, served, held from walk where r > 0""",
    "histogram_cumulative": f"with b(le, name) as (values {_BOUNDS}), s as (select event_type, round(sum(value / 10), 6) as sum, count(*)::bigint as c from events group by 1) select s.event_type, name as le, (select count(*) from events e where e.event_type = s.event_type and e.value / 10 <= b.le)::bigint as bucket, sum, c as count from s, b",
    "counter_deltas": f"with {_E} select event_id, greatest(0, event_id % 500 - lag(event_id % 500, 1, 0) over (partition by user_id order by ms, event_id)) as delta from e",
    "counter_totals": "select event_type, count(*)::bigint as total from events group by 1",
    "gauge_sum": f"with {_E}, l as (select event_type, user_id, arg_max(value, row(ms, event_id)) as v from e where ms >= 1706400000000 - {3 * DAY} group by all) select event_type, round(sum(v), 6) as value, count(*)::bigint as workers from l group by 1",
    "exposition": """with c as (select event_type, count(*) as v from events group by 1), t as (select string_agg('pages_total{a="q\\"\\\\",kind="' || event_type || '"} ' || v || chr(10), '' order by event_type) as b from c) select 'pages_total' as family, '# HELP pages_total Pages by\\nkind' || chr(10) || '# TYPE pages_total counter' || chr(10) || b as text from t union all select 'queue_lag', '# HELP queue_lag Lag' || chr(10) || '# TYPE queue_lag gauge' || chr(10)""",
    "series_keys": """select distinct 'calls' as name, '{"kind":"' || event_type || '","worker":"' || (user_id % 4) || '"}' as labels, (user_id % 4)::varchar as worker from events""",
    "percentiles": " union all ".join(_rank(k, q) for k in ("bench", "ttfp") for q in (0.5, 0.95)),
    "peak_of_sum": f"with {_E} select round(max(s), 6) as peak from (select sum(value) as s from e group by ms // 3600000)",
    "size_units": "select p_partkey, round((p_size || '.' || p_partkey % 10)::double * case p_partkey % 8 when 0 then 1024 when 1 then 1 when 2 then 1 / 1024.0 when 3 then 1e9 / 1048576 when 4 then 1e6 / 1048576 when 5 then 1e3 / 1048576 when 6 then 1 / 1048576.0 end, 6) as mib from part",
    "reconcile": f"with {_E} select * from (select day, count(*) filter (where event_type = 'click')::bigint as admitted, count(*) filter (where event_type in ('click', 'view') and value < 50)::bigint as streamed, count(*) filter (where event_type = 'view')::bigint as done, count(*) filter (where event_type = 'click') = count(*) filter (where event_type in ('click', 'view') and value < 50) and count(*) filter (where event_type = 'click') = count(*) filter (where event_type = 'view') as ok from e group by day) where admitted + streamed + done > 0",
    "goodput": f"with {_E} select user_id, count(*) filter (where event_type = 'purchase')::bigint as done, count(*) filter (where event_type in ('purchase', 'error'))::bigint as ended, round(case when max(ms) > min(ms) then count(*) filter (where event_type = 'purchase') / ((max(ms) - min(ms)) / 1000) else 0 end, 12) as per_s from e group by 1",
    "no_duplicates": "select l_orderkey, l_linenumber, count(*)::bigint as executions from lineitem group by all having count(*) > 1",
    "job_status": "with c as (select l_orderkey, case when l_linestatus = 'F' then 'DONE' when l_returnflag <> 'N' then 'PENDING' else 'MISSING' end as state, count(*) as n from lineitem group by all) select l_orderkey, coalesce(sum(n) filter (where state = 'DONE'), 0)::bigint as done, coalesce(sum(n) filter (where state = 'DONE'), 0) >= sum(n) as complete, string_agg(state || '=' || n, ',' order by state) as state_counts from c group by 1",
    "worker_rates": f"with {_E} select event_type as outcome, count(*)::bigint as n, round(count(*) * 1000 / (max(ms) - min(ms)), 9) as per_s from e group by 1",
    "lane_balance": f"with {_E} select event_id, sum(case when event_type in ('click', 'view') then 1 else -1 end) over (partition by user_id % 8 order by ms, event_id)::bigint as in_flight from e",
    "queue_lag": f"with {_N} select lane, case when lane = 'main' then (count(*) - sum(event_id % 2))::double else 'nan'::double end as lag from n group by lane",
    "liveness": f"with {_E} select user_id % 4 as pool, count(distinct case when ms >= {1_706_400_000_000 - DAY} then user_id end)::bigint as live from e group by 1",
    "endpoint_stats": "select event_type, case event_id % 5 when 0 then 'http_2xx' when 1 then '429' when 2 then 'http_5xx' when 3 then 'http_5xx' else case when event_id % 2 = 0 then 'timeout' else 'error' end end as outcome, count(*)::bigint as n, max(case when event_id % 2 = 0 then 2 else 0 end)::bigint as breaker from events group by all",
    "traces": "select event_id, case when event_id % 4 <> 0 then md5(event_id::varchar) end as trace_id, case when event_id % 4 <> 0 then '00-' || md5(event_id::varchar) || '-' || left(md5(user_id::varchar), 16) || '-01' end as header from events",
    "submissions": "select event_id, case when event_id % 120 < 1 then 422 when event_id % 120 > 100 then 413 when user_id % 3 = 0 then 503 else 202 end::bigint as status from events",
    "terminal_classes": "select case when event_id % 6 < 3 then 'success' when event_id % 6 = 3 then 'failed' when event_id % 6 = 4 then 'duplicate' end as class, count(*)::bigint as n from events group by 1",
}
