"""Counters, gauges, histograms, percentiles, exposition and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Histogram bounds in seconds; the last bucket is infinite.
BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0, 10.0, 30.0)
SEPARATOR = "\x1f"


def series_key(name: Column, labels: Column) -> Column:
    """name, a separator, and the labels as JSON with sorted keys."""
    return F.concat(name, F.lit(SEPARATOR), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels)))))


def series_name(key: Column) -> Column:
    return F.substring_index(key, SEPARATOR, 1)


def series_labels(key: Column) -> Column:
    text = F.when(F.contains(key, F.lit(SEPARATOR)), F.substring_index(key, SEPARATOR, -1))
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def counter_total(deltas: DataFrame, by: list[str], value: str) -> DataFrame:
    """Counters only go up: a negative delta raises an error."""
    ok = F.when(F.col(value) >= 0, F.col(value)).otherwise(F.raise_error(F.lit("counters cannot go down")))
    return deltas.groupBy(*by).agg(F.sum(ok).alias("total"))


def counter_deltas(totals: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """What each report of a running total adds, never below 0 (a restarted worker adds nothing)."""
    before = F.lag(value, 1, 0).over(Window.partitionBy(*by).orderBy(*order))
    return totals.withColumn("delta", F.greatest(F.lit(0).cast(totals.schema[value].dataType), F.col(value) - before))


def gauge_sum(samples: DataFrame, series: list[str], worker: str, order: list[str], ms: str, value: str, now: Column, ttl_ms: int) -> DataFrame:
    """Each live worker's last value, summed over workers."""
    live = samples.where(F.col(ms) >= now - ttl_ms)
    last = live.groupBy(*series, worker).agg(F.max_by(value, F.struct(*order)).alias("v"))
    return last.groupBy(*series).agg(F.sum("v").alias("value"), F.count("*").alias("workers"))


def histogram(samples: DataFrame, by: list[str], value: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Cumulative buckets: by, le (double, the last infinite), bucket; and sum and count of the series.
    A value on a bound belongs to it. One row a series is aggregated, then spread: no grid join."""
    edges = (*bounds, float("inf"))
    sums = [F.count_if(F.col(value) <= F.lit(b)).alias(f"_{i}") for i, b in enumerate(edges)]
    one = samples.groupBy(*by).agg(*sums, F.sum(value).alias("sum"), F.count(value).alias("count"))
    spread = F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"_{i}").alias("bucket")) for i, b in enumerate(edges)))
    return one.select(*by, "sum", "count", F.inline(spread))


def number(v: Column) -> Column:
    """A value as the exposition format spells it: specials by name, whole numbers without a point."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(F.isnan(v), "NaN").when(v == float("inf"), "+Inf").when(v == float("-inf"), "-Inf").when(whole, v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def escaped(label: Column) -> Column:
    return F.replace(F.replace(F.replace(label, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def sample_line(name: Column, labels: Column, value: Column) -> Column:
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e.key, F.lit('="'), escaped(e.value), F.lit('"')))
    return F.concat(name, F.when(F.size(labels) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.lit("")), F.lit(" "), number(value))


def exposition(samples: DataFrame, families: DataFrame) -> DataFrame:
    """family, text: HELP and TYPE once, then the family's samples in order (ord). samples: family,
    name, labels, value, ord; families: family, kind, help. A family without samples keeps its head."""
    lines = samples.groupBy("family").agg(F.sort_array(F.collect_list(F.struct("ord", sample_line(F.col("name"), F.col("labels"), F.col("value")).alias("line")))).alias("ls"))
    plain = F.replace(F.replace("help", F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit("# HELP "), F.col("family"), F.lit(" "), plain, F.lit("\n# TYPE "), F.col("family"), F.lit(" "), F.col("kind"), F.lit("\n"))
    body = F.coalesce(F.array_join(F.transform("ls", lambda x: F.concat(x.line, F.lit("\n"))), ""), F.lit(""))
    return families.join(lines, "family", "left").select("family", F.concat(head, body).alias("text"))


def order_statistic(df: DataFrame, by: list[str], value: str, index) -> DataFrame:
    """The value at index(n) (from 0) of each group's n sorted values, found by rank, not in an array."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_r") == index(F.col("_n"))).select(*by, F.col(value).alias("value"))


def bench_index(q: float):
    """Rank by rounding half to even, as round() does."""
    return lambda n: F.bround(F.lit(q) * (n - 1)).cast("bigint")


def ttfp_index(q: float):
    return lambda n: F.least(n - 1, F.floor(F.lit(q) * n)).cast("bigint")


def peak_of_sum(samples: DataFrame, at: str, value: str) -> DataFrame:
    """The largest total at one time, not the total of the largest."""
    return samples.groupBy(at).agg(F.sum(value).alias("s")).agg(F.max("s").alias("peak"))


def mebibytes(text: Column) -> Column:
    """'12.5MiB / 1GiB' or the like to MiB; the first number counts; unknown units are null."""
    n = F.regexp_extract(text, r"^\s*([0-9.]+)\s*([A-Za-z]+)", 1).try_cast("double")
    unit = F.regexp_extract(text, r"^\s*([0-9.]+)\s*([A-Za-z]+)", 2)
    mib = 1024.0 * 1024.0
    factor = F.when(unit == "GiB", 1024.0).when(unit == "MiB", 1.0).when(unit == "KiB", 1 / 1024.0).when(unit == "GB", 1e9 / mib).when(unit == "MB", 1e6 / mib).when(unit == "kB", 1e3 / mib).when(unit == "B", 1 / mib)
    return n * factor


def breaker_code(state: Column) -> Column:
    return F.when(state == "closed", 0).when(state == "half_open", 1).when(state == "open", 2).otherwise(-1)


def terminal_class(outcome: Column) -> Column:
    return F.when(outcome.isin("COMPLETED", "RESUMED", "DEGRADED"), "success").when(outcome == "FAILED", "failed").when(outcome == "ALREADY_TERMINAL", "duplicate")


def reconcile(key: str, **counts: DataFrame) -> DataFrame:
    """Full outer join of counts (key, n) from several sources, by name; ok if all agree."""
    out = None
    for name, df in counts.items():
        one = df.select(F.col(key).alias(key), F.col("n").alias(name))
        out = one if out is None else out.join(one, key, "full")
    cols = [F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in counts]
    out = out.select(key, *cols)
    first, *rest = counts
    same = F.lit(True)
    for n in rest:
        same = same & (F.col(first) == F.col(n))
    return out.withColumn("ok", same)


def request_class(status: Column, error: Column) -> Column:
    """How a call is counted: 429, http_Nxx, timeout or error."""
    return F.when(status == 429, "429").when(status.isNotNull(), F.concat(F.lit("http_"), F.floor(status / 100).cast("string"), F.lit("xx"))).when(error == "timeout", "timeout").otherwise("error")


def traceparent(header: Column) -> Column:
    """struct<trace_id, span_id> of a trace header, null if malformed."""
    t, p = F.lower(F.trim(header)), r"\A00-([0-9a-f]{32})-([0-9a-f]{16})-[0-9a-f]{2}\z"
    return F.when(t.rlike(p), F.struct(F.regexp_extract(t, p, 1).alias("trace_id"), F.regexp_extract(t, p, 2).alias("span_id")))


def format_traceparent(trace: Column, span: Column) -> Column:
    return F.concat(F.lit("00-"), trace, F.lit("-"), span, F.lit("-01"))


def page_limit(pages: Column, limit: int, room: Column) -> Column:
    """Status of a submission: validation comes before capacity."""
    return F.when(pages < 1, 422).when(pages > limit, 413).when(~room, 503).otherwise(202)
