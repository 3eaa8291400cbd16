"""Streams over several batches and restarts, against their batch twins."""

import datetime as dt
import random

import pyarrow as pa
import pytest

from corpusmill.operators import scan
from corpusmill.streaming import events

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, path string"
START = dt.datetime(2024, 3, 1)


def rows_of(n=600, seed=7, late_s=0):
    """Events in the order in which they arrive: up to `late_s` seconds after later ones."""
    rng = random.Random(seed)
    at, rows = 0, []
    for i in range(n):
        at += rng.choice([1, 5, 20, 60, 200])
        rows.append((i, START + dt.timedelta(seconds=at), rng.randrange(4), rng.choice(["click", "error", "view", "signup", "view", "purchase" if rng.random() < 0.2 else "click"]), rng.choice(["a", "b", "c", None])))
    return sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(late_s + 1))) if late_s else rows


def arrive(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return events.stream(spark, path, spark.createDataFrame([], SCHEMA).schema, "*.parquet", per_batch=1).withWatermark("ts", events.WATERMARK)


def parts(rows):
    cuts = [0, 100, 110, 350, 600]
    return [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def test_ttl_stream_goes_on_where_it_stopped(spark, tmp_path):
    rows, at = rows_of(), str(tmp_path / "kept")
    seen = []
    for part in parts(rows):
        arrive(spark, str(tmp_path / "in"), part)
        got = events.ttl_dedupe_stream(stream(spark, str(tmp_path / "in")), ["event_type"], ttl=300, at=at)  # a new query, the old checkpoint
        seen.append(got.count())
    whole = {r.event_id for r in events.ttl_dedupe(spark.createDataFrame(rows, SCHEMA), ["event_type"], ttl=300).collect()}
    assert {r.event_id for r in got.collect()} == whole and seen == sorted(seen) and seen[0] < seen[-1] == len(whole)


@pytest.mark.parametrize("restart", [False, True])
def test_ended_sessions_equal_the_batch_twins(spark, tmp_path, restart):
    rows, at = rows_of(late_s=400), str(tmp_path / "kept")
    source = str(tmp_path / "in")
    for part in parts(rows):
        arrive(spark, source, part)
        if restart:
            events.drained(events.sessions_ended(stream(spark, source), gap_s=240), "ended", at=at)
    got = events.drained(events.sessions_ended(stream(spark, source), gap_s=240), "ended", at=at)
    passed = max(r[1] for r in rows) - dt.timedelta(minutes=10)
    table = spark.createDataFrame(rows, SCHEMA)
    counts = {(r.user_id, r.start, r.end, r.tools, r.paths, r.last) for r in events.sessions(table, gap="240 seconds").collect() if r.end <= passed}
    assert len(counts) > 20 and {(r.user_id, r.start, r.end, r.calls, r.paths, r["last"]) for r in got.collect()} == counts
    closed = {tuple(r) for r in events.closed_out(table, gap="240 seconds").collect() if r.end <= passed}
    assert {tuple(r) for r in events._ended(got, "user_id").collect()} == closed
    assert {r[5] for r in closed} == {"partial", "closed"} and any("P1=" in r[6] and "INFO=" in r[6] for r in closed)


def test_closeout_and_session_streams_have_the_columns_of_their_twins(spark, tmp_path):
    arrive(spark, str(tmp_path / "in"), rows_of(50))
    s, table = stream(spark, str(tmp_path / "in")), spark.createDataFrame([], SCHEMA)
    assert events.closeout_stream(s).columns == events.closed_out(table).columns
    assert events.session_stream(s).columns == events.sessions(table).columns


def test_ended_sessions_need_no_python_worker(spark, tmp_path):
    arrive(spark, str(tmp_path / "in"), rows_of(50))
    plan = events.sessions_ended(stream(spark, str(tmp_path / "in")))._jdf.queryExecution().analyzed().toString()
    assert "SessionWindow" in plan or "session_window" in plan
    assert "Pandas" not in plan


def test_error_rate_stream_equals_its_batch_twin(spark, tmp_path):
    rows = rows_of(late_s=300)
    for part in parts(rows):
        arrive(spark, str(tmp_path / "in"), part)

    def rates(df):
        logs = df.selectExpr("ts", "concat('x [', 200 + (event_id * 37) % 400, ']') AS raw")
        return events.error_rate(scan.network_errors(logs).select("ts", "severity"), width="10 minutes")

    got = {tuple(r) for r in events.drained(rates(stream(spark, str(tmp_path / "in"))), "rates").collect()}
    passed = max(r[1] for r in rows if (r[0] * 37) % 400 + 200 >= 0) - dt.timedelta(minutes=10)
    twin = {tuple(r) for r in rates(spark.createDataFrame(rows, SCHEMA)).collect() if r.start + dt.timedelta(minutes=10) <= passed}
    assert got and got == twin


def test_ttl_stream_folds_row_after_row(spark, tmp_path):
    read = []

    def batches():
        for i in range(50):
            read.append(i)
            yield pa.RecordBatch.from_pydict({"k": ["a"] * 10, "kind": [2] * 10, "t": [i * 10 + j for j in range(10)]})

    first = next(iter(events._taken(1, 4)(batches())))
    assert first.num_rows == 3 and read == [0]  # what was read is let out before more is read


def test_ttl_stream_with_late_rows_missing_keys_and_times(spark, tmp_path):
    at, source, s = str(tmp_path / "kept"), str(tmp_path / "in"), lambda n: n and START + dt.timedelta(seconds=n)
    one = lambda rows: [(i, s(t), 1, k, None) for i, t, k in rows]
    arrive(spark, source, one([(1, 5000, "a"), (2, 5100, "a"), (3, 5300, "a"), (4, 5299, None), (5, 5001, None), (6, None, "n"), (7, None, "n"), (8, None, "a"), (9, 4000, "z")]))
    got = lambda: {r.event_id for r in events.ttl_dedupe_stream(stream(spark, source), ["event_type"], ttl=300, at=at).collect()}
    assert got() == {1, 3, 5, 6, 9}
    assert {(r.c3, r.at_micros is None) for r in spark.read.parquet(f"{at}/last/0").collect()} == {("a", False), (None, False), ("n", True)}  # z has passed
    # 4600 is later than the watermark, 4800 isn't but before a's last; 5301 is 300 after the row without a key
    arrive(spark, source, one([(11, 4600, "new"), (12, 4800, "new"), (13, 4800, "a"), (14, 5599, "a"), (15, 5600, "a"), (16, 5300, None), (17, 5301, None), (18, 9000, "n"), (19, 4701, "z")]))
    assert got() == {1, 3, 5, 6, 9, 12, 15, 17, 19}
    assert got() == {1, 3, 5, 6, 9, 12, 15, 17, 19}  # nothing new
