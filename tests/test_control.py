"""Controllers, folds and streams."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.conf import EngineConf
from quillspark.functions import controllers as C
from quillspark.operators import flow, states
from quillspark.operators import queueing as Q
from quillspark.operators import results as R
from quillspark.streaming import processors as S


def test_transition_relation():
    assert C.TERMINAL == {"DONE", "FALLBACK_DONE", "FAILED"}
    assert C.CHECKPOINT == {"LAYOUT_RUNNING": "PENDING", "VLM_RUNNING": "LAYOUT_DONE"}
    assert C.final_target("LAYOUT_DONE") == C.final_target("VLM_RUNNING") == "FALLBACK_DONE"
    assert C.final_target("PENDING") == "FAILED" and C.final_target("DONE") is None
    with pytest.raises(ValueError):
        C.page_step("PENDING", "UNHEARD_OF")
    assert C.page_step(None, "DONE") == (None, (False, "MISSING", False))
    assert C.page_step("DONE", "DONE") == ("DONE", (False, "DONE", True))


def test_apply_commands_orders_and_rejects(spark):
    rows = [("a", 3, "LAYOUT_DONE"), ("a", 1, "LAYOUT_RUNNING"), ("a", 2, "DONE"), ("b", 1, "DONE"), ("a", 4, "LAYOUT_DONE")]
    df = spark.createDataFrame(rows, "page string, seq int, to_state string")
    got = {(x.page, x.seq): (x.ok, x.observed, x.already_applied, x.state) for x in states.apply_commands(df, ["page"], ["seq"]).collect()}
    assert got["a", 1] == (True, "PENDING", False, "LAYOUT_RUNNING")
    assert got["a", 2] == (False, "LAYOUT_RUNNING", False, "LAYOUT_RUNNING")
    assert got["a", 3] == (True, "LAYOUT_RUNNING", False, "LAYOUT_DONE")
    assert got["a", 4] == (False, "LAYOUT_DONE", True, "LAYOUT_DONE")
    assert got["b", 1][0] is False


def test_bucket_reserves_and_denies():
    s, out = None, []
    for now in (0, 0, 0, 0):
        s, x = C.bucket_step(s, now, 1.0, 1.0, 1.0, 1500)
        out.append(x[:2])
    assert out == [(True, 0), (True, 1000), (False, 2000), (False, 2000)]
    s, x = C.bucket_step(s, 10_000, 1.0, 1.0, 1.0, 0)
    assert x == (True, 0, 0.0)


def test_unbounded_bucket_equals_the_fold(spark):
    draw, t, rows = random.Random(3), 0, []
    for i in range(300):
        t += draw.randint(0, 900)
        rows.append(("k", i, t))
    df = spark.createDataFrame(rows, "k string, i int, ms bigint")
    a = {x.i: (x.tokens, x.wait_ms) for x in flow.token_bucket(df, ["k"], ["i"], "ms", rate=2.0, burst=5.0, max_wait_ms=1e18).collect()}
    b = {x.i: (x.tokens, x.wait_ms) for x in flow.token_bucket_unbounded(df, ["k"], ["i"], "ms", rate=2.0, burst=5.0).collect()}
    assert all(abs(a[i][0] - b[i][0]) < 1e-6 and abs(a[i][1] - b[i][1]) <= 1 for i in a)


def test_breaker_life():
    c = EngineConf(breaker_min_volume=4)
    s = None
    for t in range(4):
        s, (_, _, state) = C.breaker_step(s, t, "failure", c)
    assert state == "open"
    s, x = C.breaker_step(s, 10, "allow", c)
    assert x[0] is False and x[1] == 5000 - 7
    s, _ = C.breaker_step(s, 4000, "failure", c)  # a late failure starts the cooldown anew
    assert C.breaker_step(s, 5500, "peek", c)[1][2] == "open"
    for k in range(3):
        s, x = C.breaker_step(s, 9000, "allow", c)
        assert x == (True, 0, "half_open"), k
    assert C.breaker_step(s, 9000, "allow", c)[1] == (False, 1250, "half_open")
    s, _ = C.breaker_step(s, 9001, "success", c)
    s, x = C.breaker_step(s, 9002, "success", c)
    assert x[2] == "closed"


def test_aimd_refractory_and_latency_floor():
    c = EngineConf()
    s, x = C.aimd_step(None, 0, "congestion", None, c)
    assert x[:2] == (7.0, "decrease")
    s, x = C.aimd_step(s, 500, "congestion", None, c)
    assert x[:2] == (7.0, "refractory")
    for t in range(20):
        s, x = C.aimd_step(s, 2000 + t, "success", 1.0, c)
    assert x[:2] == (8.0, "increase")
    low = C.Aimd(1.0, 0, None, (9999.0,) * 99)
    assert C.aimd_step(low, 0, "success", 9999.0, c)[1][:2] == (5.0, "decrease")  # below the floor it rises to it


def test_admission_hysteresis():
    s, out = None, []
    for pages, drained in ((6, 0), (5, 0), (1, 0), (0, 2), (1, 0), (0, 2), (1, 0)):
        s, x = C.admission_step(s, pages, drained, 10, 3)
        out.append(x[0])
    assert out == [True, False, False, None, False, None, True]
    assert (s.trips, s.recoveries) == (1, 1)


def test_single_flight_and_retries(spark):
    assert C.flight_step(None, 0, True, 10) == (None, "failed")
    assert C.flight_step(0, 9, True, 10) == (0, "replayed")
    assert C.flight_step(0, 10, False, 10) == (10, "executed")
    df = spark.createDataFrame([("250", None), (None, "2"), (None, "Wed, 21 Oct"), ("-5", None)], "ms string, s string")
    assert [x[0] for x in df.select(flow.retry_after_ms(F.col("ms"), F.col("s"))).collect()] == [250.0, 2000.0, None, 0.0]
    assert [x[0] for x in spark.range(7).select(flow.backoff_ceiling_ms(F.col("id"))).collect()] == [200.0, 400.0, 800.0, 1600.0, 3200.0, 5000.0, 5000.0]


def test_gates_in_order():
    c = EngineConf(breaker_min_volume=2, bucket_max_wait_ms=0, bucket_burst=3.0)
    s, out = None, []
    for what in ("ok", "throttled", "ok", "ok"):
        s, x = C.call_step(s, 0, what, 1.0, c)
        out.append(x[:2])
    assert out == [("ok", 10.0), ("throttled", 7.0), ("circuit_open", 7.0), ("circuit_open", 7.0)]
    s, x = C.call_step(C.Gates(None, None, C.Bucket(0.0, 0)), 0, "ok", 1.0, c)
    assert x[0] == "saturated" and s.breaker.successes == 0


def test_sweep_is_claimed_once():
    s, got = None, []
    for now in (0, 40, 51, 60, 102):
        s, x = C.sweep_step(s, now, 100)
        got.append(x)
    assert got == [False, False, True, False, True]


def test_result_ids_and_gaps(spark):
    df = spark.createDataFrame([("10-2",), (" 9-11 ",), ("9",), (None,), ("x-1",)], "e string")
    ids = [x.i for x in df.select(R.parse_id(F.col("e")).alias("i")).collect()]
    assert [(x.ms, x.n) if x else None for x in ids] == [(10, 2), (9, 11), None, None, None]
    assert df.where("e like '%-%' and e not like 'x%'").select((R.parse_id(F.lit("9-11")) < R.parse_id(F.lit("10-2"))).alias("b")).first().b


def test_queue_rules(spark):
    e = spark.createDataFrame([(None, 0, 0), ("DONE", 0, 0), ("PENDING", 400_000, 0), ("PENDING", 0, 400), ("PENDING", 0, 0)], "s string, age bigint, a int")
    got = [x[0] for x in e.select(Q.reap(F.col("s"), F.col("s").isin(*C.TERMINAL), F.col("age"), F.col("a"), 300_000, 360)).collect()]
    assert got == ["expired", "already_terminal", "forced_terminal", "forced_terminal", "requeued"]
    ok = spark.createDataFrame([("a-b_1",), ("../x",), ("",), ("a\n",), ("x" * 65,)], "n string").select(Q.safe_document_id(F.col("n"))).collect()
    assert [x[0] for x in ok] == [True, False, False, False, False]


def test_stream_equals_batch(spark, tmp_path):
    draw = random.Random(5)
    asks = list(C.PREDECESSORS)[1:]
    rows = [(draw.randint(0, 5), i, draw.choice(asks)) for i in range(200)]
    for part in range(4):
        pd.DataFrame(rows[part * 50 : part * 50 + 50], columns=["page", "seq", "to_state"]).to_parquet(tmp_path / f"{part}.parquet")
    want = states.apply_commands(spark.read.parquet(str(tmp_path)), ["page"], ["seq"]).select("page", "seq", "ok", "state").collect()
    live = spark.readStream.schema("page bigint, seq bigint, to_state string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    run = S.page_states(live, ["page"], ["seq"], ["seq"]).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "_check")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.table("live").select("page", "seq", "ok", "state").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_bucket_peeks_and_resets():
    s, out = None, []
    for now, op in ((0, "acquire"), (0, "acquire"), (0, "peek"), (500, "peek"), (500, "reset"), (500, "peek")):
        s, x = C.bucket_op_step(s, now, op, 1.0, 1.0, 5000)
        out.append(x[2])
    assert out == [0.0, -1.0, -1.0, -0.5, 1.0, 1.0]


def test_flights_make_room_for_the_latest():
    s, out = None, []
    for now, key in ((0, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "b"), (5, "a")):
        s, x = C.bounded_flight_step(s, key, now, False, 100, 2)
        out.append(x)
    # c makes b go, which was used before a; b then makes a go
    assert out == [("executed", 1), ("executed", 2), ("replayed", 2), ("executed", 2), ("executed", 2), ("executed", 2)]
    assert C.bounded_flight_step({}, "x", 0, True, 100, 2)[1] == ("failed", 0)


def test_tail_on_a_stream(spark, tmp_path):
    rows = [(f"{ms}-{n}", ms * 10 + n) for ms in (9, 10, 100) for n in (0, 1)]
    spark.createDataFrame(rows, "entry_id string, v int").write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("entry_id string, v int").parquet(str(tmp_path / "in"))
    q = S.tail(live, "entry_id", "9-1").writeStream.format("memory").queryName("tailed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert sorted(r.v for r in spark.table("tailed").collect()) == [100, 101, 1000, 1001]


def test_malformed_boxes_are_refused(spark):
    from quillspark.operators import boxes as B

    df = spark.createDataFrame([(1, 0, (0.0, 0.0, -1.0, 5.0))], "page int, idx int, box struct<x:double,y:double,w:double,h:double>")
    with pytest.raises(Exception, match="malformed box"):
        B.report(df, df, "page").collect()
