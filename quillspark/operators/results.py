"""Result streams: sequence numbers, windows, gaps, replay and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import controllers as C
from .fold import ordered_fold


def parse_id(entry: Column) -> Column:
    """struct<ms, n> of '<ms>-<n>', null if malformed; compares as numbers, not as text."""
    t = F.trim(entry)
    part = lambda i: F.regexp_extract(t, r"\A(\d+)-(\d+)\z", i).cast("bigint")
    return F.when(t.rlike(r"\A\d+-\d+\z"), F.struct(part(1).alias("ms"), part(2).alias("n")))


def publish(events: DataFrame, job: str, order: list[str], ms: str) -> DataFrame:
    """Adds seq (dense in a job), id (struct ms, n: n counts within a millisecond) and entry_id."""
    by = Window.partitionBy(job).orderBy(*order)
    n = F.row_number().over(Window.partitionBy(job, ms).orderBy(*order)) - 1
    out = events.withColumn("seq", F.row_number().over(by).cast("bigint")).withColumn("id", F.struct(F.col(ms).alias("ms"), n.cast("bigint").alias("n")))
    return out.withColumn("entry_id", F.concat_ws("-", F.col("id.ms"), F.col("id.n")))


def retained(stream: DataFrame, job: str, maxlen: int) -> DataFrame:
    """The last maxlen entries of each job."""
    last = F.row_number().over(Window.partitionBy(job).orderBy(F.desc("seq")))
    return stream.withColumn("_r", last).where(F.col("_r") <= maxlen).drop("_r")


def window(stream: DataFrame, job: str) -> DataFrame:
    return stream.groupBy(job).agg(F.min("id").alias("window_lo"), F.max("id").alias("window_hi"))


def gap_after(cursor: Column, oldest: Column) -> Column:
    """Whether entries after the cursor were trimmed; an empty stream has no gap, nor has no cursor."""
    return F.coalesce(cursor < oldest, F.lit(False))


def history(stream: DataFrame, cursors: DataFrame, job: str, limit: int) -> DataFrame:
    """Replay after each cursor (job, cursor; null: from the start), exclusive, at most limit entries a job."""
    after = stream.join(cursors, job).where(F.col("cursor").isNull() | (F.col("id") > F.col("cursor")))
    rank = F.row_number().over(Window.partitionBy(job).orderBy("id"))
    return after.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r", "cursor")


def tail(stream: DataFrame, readers: DataFrame, job: str, reader: str, last_id: str, count: int) -> DataFrame:
    """What each reader (job, reader, last_id as '<ms>-<n>') is given next: entries after its last one, in
    order, count at most. A reader without a usable id begins at the start. On a stream the same read
    is streaming.processors.tail."""
    after = readers.select(F.col(job).alias("_job"), reader, parse_id(F.col(last_id)).alias("_after"))
    rows = stream.join(after, F.col(job) == F.col("_job")).where(F.col("_after").isNull() | (F.col("id") > F.col("_after")))
    rank = F.row_number().over(Window.partitionBy(job, reader).orderBy("id"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= count).drop("_r", "_job", "_after")


def frame(event: Column, body: Column, entry_id: Column | None = None) -> Column:
    """A server-sent event; frames about the connection carry no id."""
    head = F.concat(F.lit("event: "), event, F.lit("\ndata: "), body, F.lit("\n\n"))
    return head if entry_id is None else F.concat(F.lit("id: "), entry_id, F.lit("\n"), head)


def resume(stream: DataFrame, progress: DataFrame, cursors: DataFrame, job: str, limit: int, retry_ms: int) -> DataFrame:
    """job, pos, kind, frame: what a client that comes back with a cursor is sent. stream: seq, id,
    entry_id, event, data (map); progress: done, total_pages. After a gap everything retained is sent."""
    w = window(stream, job)
    base = progress.join(cursors, job).join(w, job, "left")
    text = lambda c: F.concat_ws("-", F.col(f"{c}.ms"), F.col(f"{c}.n"))
    some = lambda c: F.when(F.col(c).isNotNull(), text(c))
    gap = gap_after(F.col("cursor"), F.col("window_lo"))
    base = base.withColumn("gap", gap).withColumn("start", F.when(~gap, F.col("cursor")))
    opened = F.to_json(F.struct(F.col(job).alias("job_id"), F.col("total_pages"), F.col("done"), some("start").alias("resumed_from"), some("window_lo").alias("window_lo"), some("window_hi").alias("window_hi")), {"ignoreNullFields": "false"})
    lost = F.to_json(F.struct(F.col(job).alias("job_id"), some("window_lo").alias("window_lo")))
    one = lambda df, pos, kind, f: df.select(job, F.lit(pos).cast("bigint").alias("pos"), F.lit(kind).alias("kind"), f.alias("frame"))
    sent = history(stream, base.select(job, F.col("start").alias("cursor")), job, limit)
    body = F.to_json(F.map_concat(F.col("data"), F.create_map(F.lit("seq"), F.col("seq").cast("string"), F.lit("stream_id"), F.col("entry_id"))))
    replay = sent.select(job, (F.col("seq") + 2).alias("pos"), F.col("event").alias("kind"), frame(F.col("event"), body, F.col("entry_id")).alias("frame"))
    seen = sent.where("event = 'job.complete'").select(job).distinct()
    derived = base.where("total_pages > 0 and done >= total_pages").join(seen, job, "left_anti")
    complete = F.to_json(F.struct(F.col(job).alias("job_id"), F.col("done"), F.col("total_pages")))
    parts = [
        one(base, 0, "retry", F.lit(f"retry: {retry_ms}\n\n")),
        one(base, 1, "stream.open", frame(F.lit("stream.open"), opened)),
        one(base.where("gap"), 2, "stream.gap", frame(F.lit("stream.gap"), lost)),
        replay,
        one(derived, 1 << 62, "job.complete", frame(F.lit("job.complete"), complete)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def completeness(stream: DataFrame, job: str, totals: DataFrame) -> DataFrame:
    """Whether a finished job holds two entries a page and one more, without a hole."""
    s = stream.groupBy(job).agg(F.count("*").alias("entries"), F.max("seq").alias("last_seq"))
    expected = 2 * F.col("total_pages") + 1
    return totals.join(s, job, "left").select(job, F.coalesce("entries", F.lit(0)).cast("bigint").alias("entries"), expected.cast("bigint").alias("expected"), F.coalesce((F.col("entries") == expected) & (F.col("last_seq") == F.col("entries")), F.lit(False)).alias("whole"))


def subscriber_slots(log: DataFrame, keys: list[str], order: list[str], op: str, cap: int) -> DataFrame:
    """log of acquire and release: adds served and held."""

    def step(held, what):
        held, ok = C.slot_step(held or 0, what, cap)
        return held, (ok, held)

    return ordered_fold(log, keys, order, [op], step, "served boolean, held bigint")
