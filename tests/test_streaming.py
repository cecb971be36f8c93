"""Quota against a plain loop, and streams over several micro-batches against the batch operators."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kycmill.operators import audit, mutations, quota
from kycmill.streaming import operators
from kycmill.streaming.runs import file_stream, run_to_files

START = dt.datetime(2026, 1, 1)


def requests(n, seed):
    """A third of all requests come from one key, some at the same moment."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < 0.34 else f"k{rng.randrange(20)}"
        at = START + dt.timedelta(seconds=rng.randrange(n * 2), milliseconds=rng.choice([0, 0, 500]))
        out.append((key, i, at))
    return out


def loop(rows, limit, window):
    state, out = {}, {}
    for key, i, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        start, used = state.get(key, (None, 0))
        if start is None or (at - start).total_seconds() >= window:
            state[key], out[i] = (at, 1), (True, 0)
        elif used < limit:
            state[key], out[i] = (start, used + 1), (True, 0)
        else:
            out[i] = (False, int(window - (at - start).total_seconds()) + 1)
    return out


SCHEMA = "key string, request_id int, ts timestamp"


@pytest.mark.parametrize(("window", "limit", "spans"), [(60, 5, 1), (60, 5, 2), (7, 2, 3), (60, 60, 64), (1, 1, 5)])
def test_quota_equals_loop(spark, window, limit, spans):
    rows = requests(1500, window)
    got = quota.quota_admission(spark.createDataFrame(rows, SCHEMA), limit, window, spans)
    assert {r.request_id: (r.allowed, r.retry_after) for r in got.collect()} == loop(rows, limit, window)


@pytest.mark.parametrize(("window", "limit"), [(60, 5), (7, 2), (300, 3)])
def test_quota_goes_on_from_open_windows(spark, window, limit):
    """Runs over parts of the time equal one run; a window that reaches over the cut keeps its count."""
    rows = sorted(requests(900, window), key=lambda r: (r[2], r[1]))
    rows += [(None, 1000 + i, rows[-1][2] + dt.timedelta(seconds=i)) for i in range(20)]
    found, still = {}, None
    for part in (rows[:200], rows[200:210], rows[210:]):
        decided, still = quota.quota_run(spark.createDataFrame(part, SCHEMA), still, limit, window, 2)
        found |= {r.request_id: (r.allowed, r.retry_after) for r in decided.collect()}
        still = spark.createDataFrame(still.collect(), "key string, anchor bigint, used int")
    named = [("none" if k is None else k, i, at) for k, i, at in rows]
    assert found == loop(named, limit, window)
    assert still.count() == len({k for k, _, _ in rows})


def test_quota_rows_are_bounded():
    """A window with very many moments: no row holds more than a part of them, and the map of a span stays small."""
    window, rng = 60_000_000, np.random.default_rng(1)
    times = np.unique(rng.integers(0, 4 * window, 400_000))
    exits, sub = quota._Exits(0, window), window // quota._SUBS
    for n in range(4 * quota._SUBS):
        part = times[(times >= n * sub) & (times < (n + 1) * sub)]
        assert len(part) < 2 * len(times) / (4 * quota._SUBS)
        exits.extend(part)
    for free in [0, 1, int(times[5]), int(times[5]) + 1, window - 1, window]:
        at = free
        while (i := int(np.searchsorted(times, at))) < len(times):
            at = int(times[i]) + window
        assert exits.leave[np.searchsorted(exits.upto, free)] == at
    assert len(exits.leave) <= (times < window).sum() + 1


def test_quota_burst(spark):
    rows = [("k", i, START + dt.timedelta(milliseconds=i)) for i in range(65)]
    got = [r for r in quota.quota_admission(spark.createDataFrame(rows, SCHEMA)).orderBy("request_id").collect()]
    assert [r.allowed for r in got] == [True] * 60 + [False] * 5
    assert got[60].retry_after == 60


def parts(spark, rows, schema, path, n=3):
    """The rows as ``n`` files in order, read one file per micro-batch."""
    size = -(-len(rows) // n)
    for i in range(n):
        df = spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1)
        df.write.mode("append").parquet(str(path))
    return file_stream(spark.createDataFrame([], schema), str(path), 1)


def test_quota_stream(spark, tmp_path):
    rows = sorted(requests(600, 1), key=lambda r: (r[2], r[1]))
    stream = parts(spark, rows, SCHEMA, tmp_path / "in")
    got = run_to_files(operators.stream_quota(stream, 5, 60), "quota", 4)
    assert {r.request_id: (r.allowed, r.retry_after) for r in got.collect()} == loop(rows, 5, 60)


def test_chain_stream(spark, tmp_path):
    from test_audit import SCHEMA as AUDIT, collected, expected_chain, make_rows

    rows = make_rows(150)
    got = operators.run_audit_chain(parts(spark, rows, AUDIT, tmp_path / "in"))
    assert collected(got) == expected_chain(rows)
    assert audit.verify_audit_chain(got).filter(F.size("violations") > 0).count() == 0


def test_ingest_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [
        ("a", i, rng.choice([None, "hot", "hot", f"k{rng.randrange(15)}"]), START + dt.timedelta(seconds=i)) for i in range(120)
    ]
    schema = "tenant_id string, case_id int, idempotency_key string, created_at timestamp"
    stream = parts(spark, rows, schema, tmp_path / "in")
    got = run_to_files(operators.stream_ingest(stream), "ingest", 4)
    df = spark.createDataFrame(rows, schema)
    want = mutations.idempotent_ingest(df, df.limit(0))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ingest_goes_on_after_a_stop(spark, tmp_path):
    schema = "tenant_id string, case_id int, idempotency_key string, created_at timestamp"
    rows = [("a", i, f"k{i % 5}", START + dt.timedelta(seconds=i)) for i in range(40)]
    df = spark.createDataFrame(rows, schema)
    at = str(tmp_path / "lasting")
    for n, part in enumerate((df.filter("case_id < 25"), df.filter("case_id >= 25"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = file_stream(df, str(tmp_path / "in"))
        got = run_to_files(operators.stream_ingest(stream), "ingest", 4, at=at)
        assert got.count() == (25, 40)[n]
    want = mutations.idempotent_ingest(df, df.limit(0))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_status_stream(spark, tmp_path):
    rows = [(i % 7, i, ["pending", "needs_review", "approved"][(i * 5) % 3]) for i in range(60)]
    stream = parts(spark, rows, "case_id int, seq int, status string", tmp_path / "in")
    last = {case: status for case, _, status in rows}
    want = {s: list(last.values()).count(s) for s in set(last.values())}
    assert {r.status: r.n for r in operators.run_status_counts(stream).collect()} == want


def test_event_stream(spark, tmp_path):
    good = '{"tenant_id": "%s", "case_id": "c", "status": "approved", "decision": null}'
    rows = [(1, good % "a"), (2, good % "b"), (3, "{broken"), (4, "")]
    stream = parts(spark, rows, "seq int, value string", tmp_path / "in", 2)
    got = run_to_files(operators.stream_case_events(stream, "a"), "events").collect()
    assert [(r.seq, r.tenant_id, r.status, r.decision, r.payload) for r in got] == [(1, "a", "approved", None, good % "a")]
    everyone = run_to_files(operators.stream_case_events(stream), "fan-out", folders=["tenant_id"])
    assert sorted((r.seq, r.tenant_id) for r in everyone.collect()) == [(1, "a"), (2, "b")]
    assert len({f.rsplit("/", 2)[1] for f in everyone.inputFiles()}) == 2


CHANGES = "seq bigint, tenant_id string, case_id string, status string, decision string, claimed_by_reviewer_id string"


def published(spark, at, tenant=None):
    found = run_to_files(operators.stream_case_events(operators.event_channel(spark, at), tenant), "channel")
    return sorted((r.seq, r.tenant_id, r.status, r.claimed_by_reviewer_id) for r in found.collect())


@pytest.mark.parametrize("when", ["before", "after"])
def test_changes_and_events_are_committed_together(spark, tmp_path, monkeypatch, when):
    """A failure before or after a batch is published: the run that goes on publishes every event once."""
    rows = [(i, "ab"[i % 2], f"c{i}", None if i % 5 == 4 else "needs_review", None, "r1" if i % 3 == 0 else None) for i in range(30)]
    stream = parts(spark, rows, CHANGES, tmp_path / "in")
    at, publish, calls = str(tmp_path / "at"), operators.publish, []

    def failing(*args):
        calls.append(args)
        if len(calls) == 2:
            if when == "after":
                publish(*args)
            raise OSError("lost")
        return publish(*args)

    monkeypatch.setattr(operators, "publish", failing)
    with pytest.raises(Exception, match="lost"):
        operators.run_case_changes(stream, at)
    seen = 10 if when == "before" else 20
    like = spark.createDataFrame([], CHANGES)
    assert operators.committed_changes(like, at).count() == seen
    operators.run_case_changes(stream, at)
    want = [(i, t, s, by) for i, t, _, s, _, by in rows if s]
    assert published(spark, at) == want
    assert published(spark, at, "a") == [r for r in want if r[1] == "a"]
    assert sorted(map(tuple, operators.committed_changes(like, at).collect())) == rows


def test_chain_stream_keeps_rows_without_tenant(spark, tmp_path):
    """Three batches, half of the rows without a tenant: as many rows out, and one chain each."""
    from test_audit import SCHEMA as AUDIT, make_rows

    rows = [(r[0], None if r[0] % 2 else "t", *r[2:]) for r in make_rows(12)]
    got = operators.run_audit_chain(parts(spark, rows, AUDIT, tmp_path / "in"))
    assert sorted(r.id for r in got.collect()) == list(range(1, 13))
    assert audit.verify_audit_chain(got).filter(F.size("violations") > 0).count() == 0


def test_chain_stream_goes_on(spark, tmp_path):
    from test_audit import SCHEMA as AUDIT, collected, expected_chain, make_rows

    rows = make_rows(90)
    stream = parts(spark, rows[:60], AUDIT, tmp_path / "in", 2)
    at = str(tmp_path / "at")
    assert operators.run_audit_chain(stream, at).count() == 60
    spark.createDataFrame(rows[60:], AUDIT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert collected(operators.run_audit_chain(stream, at)) == expected_chain(rows)


def test_status_counts_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(operators, "COMPACTED", 2)
    rows = [(i % 7, i, ["pending", "needs_review", "approved"][(i * 5) % 3]) for i in range(60)]
    schema, at = "case_id int, seq int, status string", str(tmp_path / "at")
    stream = parts(spark, rows[:40], schema, tmp_path / "in", 4)
    operators.run_status_counts(stream, at)
    spark.createDataFrame(rows[40:], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = operators.run_status_counts(stream, at)
    last = {case: status for case, _, status in rows}
    assert {r.status: r.n for r in got.collect()} == {s: list(last.values()).count(s) for s in set(last.values())}
    assert len(got.inputFiles()) < 5 * 4


def test_status_changes_of_many_cases_come_in_groups(spark, tmp_path):
    """One sum per status and group, however many cases it has; later batches know each case's status."""
    rows = [(i, 1, "pending") for i in range(90)] + [(i, 2, "approved" if i % 3 else "pending") for i in range(90)]
    stream = parts(spark, rows, "case_id int, seq int, status string", tmp_path / "in")
    out = operators.run_to_files(operators.stream_status_changes(stream, buckets=3), "status-changes", 2).collect()
    total = {s: sum(r.delta for r in out if r.status == s) for s in {r.status for r in out}}
    assert total == {"pending": 30, "approved": 60}
    assert len(out) < 90
