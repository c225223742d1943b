"""Metrics, payloads, documents, quarantine and the registry."""

import hashlib
import json
import importlib.util
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspark.conf import EngineConf
from quillspark.functions import payloads as P
from quillspark.operators import metrics as M
from quillspark.operators import payloads as G
from quillspark.sources import pdf
from quillspark.sources.tables import quarantine

DATA = "/root/testdata/sf0.001"


def test_number_spelling(spark):
    values = [(float("nan"),), (math.inf,), (-math.inf,), (3.0,), (0.5,)]
    assert [x[0] for x in spark.createDataFrame(values, "v double").select(M.number(F.col("v"))).collect()] == ["NaN", "+Inf", "-Inf", "3", "0.5"]


def test_counter_cannot_go_down(spark):
    df = spark.createDataFrame([("a", 1), ("a", -1)], "k string, v bigint")
    with pytest.raises(PySparkException):
        M.counter_total(df, ["k"], "v").collect()


def test_histogram_bounds_are_inclusive(spark):
    df = spark.createDataFrame([("s", 0.1), ("s", 0.11), ("s", 99.0)], "k string, v double")
    h = {x.le: x.bucket for x in M.histogram(df, ["k"], "v").collect()}
    assert (h[0.05], h[0.1], h[0.25], h[math.inf]) == (0, 1, 2, 3)


def test_percentile_indices_differ(spark):
    df = spark.createDataFrame([("k", float(i)) for i in range(6)], "k string, v double")
    assert M.order_statistic(df, ["k"], "v", M.bench_index(0.5)).first().value == 2.0  # 2.5 rounds to even
    assert M.order_statistic(df, ["k"], "v", M.ttfp_index(0.5)).first().value == 3.0


def test_payloads_are_stable_and_whole(spark):
    assert P.layout("job", 1) == P.layout("job", 1) != P.layout("job", 2)
    #: Digests of whole payloads, so that no rewrite changes what a job and page give.
    golden = {'job/0': '6ddf1ea5af9ce267', 'a/1': '8540cd537700a4b1', '17/9': '6941896444ab3f68', 'é/3': 'a972ce9c9daae9aa'}
    for name, digest in golden.items():
        job, number = name.split("/")
        both = [P.layout(job, int(number)), P.document(job, int(number))]
        assert hashlib.sha256(json.dumps(both, sort_keys=True).encode()).hexdigest()[:16] == digest
    assert P.markdown([["a", "b"], ["c", "d"]]) == "| a | b |\n|---|---|\n| c | d |"
    df = spark.range(20).select(G.layout(F.col("id"), F.lit(3)).alias("l"), G.document(F.col("id"), F.lit(3)).alias("d"))
    for x in df.collect():
        assert len(x.l.boxes) == len(x.l.reading_order) >= 4
        assert all(b.y + b.h <= 792 - 40 + 0.01 for b in x.l.boxes)
        assert 0.88 <= x.d.confidence <= 0.99


def make_pdf(*pages, extra=b"", text="Hello (page)"):
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /MediaBox [0 0 200 100] /Kids [" + b" ".join(b"%d 0 R" % (4 + i) for i in range(len(pages))) + b"] /Count %d >>" % len(pages), b"<< /Length 30 >> stream\nBT (Hello \\(page\\)) Tj ET\nendstream"]
    objects += [b"<< /Type /Page /Parent 2 0 R /Contents 3 0 R " + p + b" >>" for p in pages]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + extra + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_pdf_pages(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(make_pdf(b"", b"/MediaBox [0 0 300 400] /Rotate 90", b"/Rotate (ninety)"))
    (tmp_path / "empty.pdf").write_bytes(make_pdf())
    (tmp_path / "locked.pdf").write_bytes(make_pdf(b"", extra=b"9 0 obj << /Encrypt 8 0 R >> endobj\n"))
    (tmp_path / "junk.pdf").write_bytes(b"hello")
    rows = pdf.read_pages(spark, str(tmp_path), text_limit=5).collect()
    good = sorted((r.page_index, r.width, r.height, r.rotation, r.text, r.text_chars) for r in rows if r.document == "good")
    assert good == [(0, 200.0, 100.0, 0, "Hello", 12), (1, 300.0, 400.0, 90, "Hello", 12), (2, 200.0, 100.0, 0, "Hello", 12)]
    errors = {r.document: r.error for r in rows if r.error}
    assert "no pages" in errors["empty"] and "encrypted" in errors["locked"] and "not a PDF" in errors["junk"]
    assert pdf.read_pages(spark, str(tmp_path), max_bytes=1).where("error like '%larger%'").count() == 4


def test_quarantine_keeps_every_row(spark):
    df = spark.createDataFrame([("1",), (None,), ("x",)], "v string")
    good, bad = quarantine(df, {"missing": "v is not null", "number": "try_cast(v as int) is not null"})
    assert good.count() == 1 and sorted(r.reject_reason for r in bad.collect()) == ["missing", "number"]


def test_registry_is_complete():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


SMALL = ["text_wer", "box_greedy_match", "ted_star", "state_machine", "token_bucket_bounded", "breaker", "aimd", "admission", "single_flight", "result_seq", "histogram_cumulative", "percentiles", "exposition"]


@pytest.mark.parametrize("name", SMALL)
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("benchmark", "documents", "events", "lineitem", "orders", "customer", "part"):
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    sql = db.sql(entry.oracle_sql()[name])
    assert sorted(sql.columns) == sorted(df.columns)
    order = [sql.columns.index(c) for c in sorted(df.columns)]
    want = sorted((tuple(r[i] for i in order) for r in sql.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr) == want


def test_engine_stands_without_the_training_data_operators():
    spec = importlib.util.find_spec("quillspark.plans.registry")
    assert "llm" not in open(spec.origin).read()


def test_settings_from_the_environment():
    c = EngineConf.from_env({"QUILLSPARK_BUCKET_RATE": "20", "QUILLSPARK_MAX_PAGES": "7", "OTHER": "x"})
    assert (c.bucket_rate, c.max_pages, c.bucket_burst) == (20.0, 7, 10.0)
    for bad in ({"QUILLSPARK_BUCKET_RATE": "-1"}, {"QUILLSPARK_MAX_PAGES": "many"}, {"QUILLSPARK_IOU_THRESHOLD": "1.5"}, {"QUILLSPARK_AIMD_MIN_RATE": "99"}):
        with pytest.raises(ValueError):
            EngineConf.from_env(bad)
