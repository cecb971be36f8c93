"""The stream of a case's evidence against the rules said plainly, and against the batch form."""

import random
import time

import pytest

from kycmill.operators import decisions
from kycmill.streaming import lifecycle
from kycmill.streaming.runs import file_stream, run_to_files, state_settings

NAMES = ["case_id", *(c.split()[0] for c in lifecycle.EVENT.split(", "))]
SCHEMA = "case_id int, " + lifecycle.EVENT


def event(case, seq, kind, **values):
    row = {"case_id": case, "seq": seq, "kind": kind, "failed": False, **values}
    return tuple(row.get(n) for n in NAMES)


def docs(case, seq, **values):
    return event(case, seq, "documents", **{"id_document_key": "id", "selfie_key": "selfie", **values})


def read(case, seq, **values):
    return event(case, seq, "extraction", **{"confidence": 0.99, "method": "mrz", "needs_review": False, **values})


def batches(spark, rows, path, n):
    size = -(-len(rows) // n)
    for i in range(n):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(str(path))
    return file_stream(spark.createDataFrame([], SCHEMA), str(path), 1)


def transitions(spark, rows, path, n):
    out = run_to_files(lifecycle.stream_case_lifecycle(batches(spark, rows, path, n)), "lifecycle", 2)
    return sorted((r.case_id, r.seq, r.status, r.reason, r.risk_score, r.reviewer_id) for r in out.collect())


def test_paths_to_an_outcome(spark, tmp_path):
    """One case for every way the cascade can end, decisions early, late, escalated and after the end."""
    rows = [
        docs(1, 1), read(1, 2), event(1, 3, "face", similarity_score=0.9), event(1, 4, "screening", hit_count=0),
        event(1, 5, "decision", decision="rejected", reviewer_id=1),
        event(2, 1, "decision", decision="escalated", reviewer_id=1), event(2, 2, "decision", decision="approved", reviewer_id=2),
        event(2, 3, "decision", decision="rejected", reviewer_id=3), docs(2, 4, failed=True),
        docs(3, 1, id_document_key=None),
        read(4, 1, failed=True), docs(4, 2),
        docs(5, 1), read(5, 2, needs_review=True, reason="unsure", confidence=0.0), event(5, 3, "decision", decision="escalated"),
        docs(6, 1, selfie_key=None), read(6, 2),
        docs(7, 1), read(7, 2), event(7, 3, "face", failed=True), event(7, 4, "screening", hit_count=0),
        docs(8, 1), read(8, 2), event(8, 3, "face", similarity_score=0.95), event(8, 4, "screening", failed=True),
        docs(9, 1), read(9, 2), event(9, 3, "face"), event(9, 4, "screening", hit_count=0),
        docs(10, 1), read(10, 2), event(10, 3, "face", similarity_score=0.99), event(10, 4, "screening", hit_count=2),
        docs(11, 1), read(11, 2, confidence=0.8), event(11, 3, "face", similarity_score=0.8), event(11, 4, "screening", hit_count=0),
        docs(12, 1), read(12, 2), event(12, 3, "opened"),
    ]
    want = [
        (1, "approved", None, 0.064, None), (2, "needs_review", "failed to fetch case documents", None, None),
        (2, "approved", None, None, 2), (3, "needs_review", "no id_document found for case", None, None),
        (4, "needs_review", "extraction failed or timed out", None, None), (5, "needs_review", "unsure", None, None),
        (6, "needs_review", "no selfie found for case", None, None),
        (7, "needs_review", "face match activity failed", 1.0, None),
        (8, "needs_review", "sanctions screening activity failed", 0.034, None),
        (9, "needs_review", "no face detected for comparison", 1.0, None),
        (10, "needs_review", "sanctions list hit", 1.0, None),
        (11, "needs_review", "combined confidence 0.8000 below auto-clear threshold 0.85", 0.2, None),
    ]
    for n in (1, 5):
        random.Random(n).shuffle(rows)
        # Decisions count in order of arrival: theirs stays, everything else comes at any time.
        in_order = iter(sorted((r for r in rows if r[2] == "decision"), key=lambda r: r[1]))
        rows = [next(in_order) if r[2] == "decision" else r for r in rows]
        got = [(c, s, r, k, v) for c, _, s, r, k, v in transitions(spark, rows, tmp_path / str(n), n)]
        # Rows of case 1 may come after a decision, which then changes nothing: it is final when assessed.
        assert sorted(got, key=str) == sorted(want, key=str)


def test_equal_to_the_batch_form(spark, tmp_path):
    """Events of random cases, shuffled over batches, end as the tables do."""
    draw = random.Random(6)
    n = 120
    cases = spark.createDataFrame([(f"t{i % 3}", i) for i in range(n)], "tenant_id string, case_id int")
    keys = spark.createDataFrame(
        [(i, "id" if draw.random() < 0.9 else None, "s" if draw.random() < 0.9 else None) for i in range(n)],
        "case_id int, id_document_key string, selfie_key string",
    )
    step_names = ["fetch_case_documents", "extract_document", "face_match", "sanctions_screen"]
    steps = spark.createDataFrame(
        [(i, s, k, "failed" if draw.random() < 0.1 else "completed") for i in range(n) for k, s in enumerate(step_names)],
        "case_id int, step string, seq int, outcome string",
    )
    some = [i for i in range(n) if draw.random() < 0.9]
    score = lambda: round(draw.uniform(0.7, 1.0), 3)
    extractions = spark.createDataFrame(
        [(i, score(), "mrz", draw.random() < 0.1, "unsure") for i in some],
        "case_id int, confidence double, method string, needs_review boolean, reason string",
    )
    faces = spark.createDataFrame([(i, score() if draw.random() < 0.9 else None) for i in some], "case_id int, similarity_score double")
    screens = spark.createDataFrame([(i, draw.randrange(2) // 1 if draw.random() < 0.2 else 0) for i in some], "case_id int, hit_count int")
    kinds = ["approved", "rejected", "escalated"]
    rows = [(i, draw.randrange(n), f"t{draw.randrange(3)}", draw.choice(kinds), draw.randrange(9)) for i in range(200)]
    decided = spark.createDataFrame(rows, "decision_id bigint, case_id int, tenant_id string, decision string, reviewer_id bigint")
    decided = decided.withColumn("decided_at", decided.decision_id)
    tables = [cases, keys, steps, extractions, faces, screens]
    found = decisions.review_resolution(decisions.case_decisions(*tables), decided).collect()
    want = {r.case_id: (r.final_status, r.reason, r.reviewer_id if r.final_status != "needs_review" else None) for r in found}
    log = [tuple(r) for r in lifecycle.lifecycle_log(*tables, decided).select(*NAMES).collect()]
    draw.shuffle(log)
    log.sort(key=lambda r: r[1] if r[2] == "decision" else draw.randrange(205))
    final, reason = {}, {}
    for case, seq, status, why, _, reviewer in transitions(spark, log, tmp_path / "log", 6):
        if why:
            reason[case] = why
        if case not in final or status != "needs_review":
            final[case] = (status, reviewer)
    assert {c: (s, reason.get(c), r) for c, (s, r) in final.items()} == want


def wait_for(query, check, seconds=90):
    end = time.time() + seconds
    while time.time() < end and query.isActive:
        if check():
            return True
        time.sleep(1)
    return False


def test_timeout_and_horizon(spark, tmp_path):
    """In a running stream cases that wait too long are parked, and final cases leave the state."""
    rows = [
        event(1, 1, "opened"), docs(2, 1), event(2, 2, "decision", decision="rejected", reviewer_id=4),
        docs(3, 1), read(3, 2), event(3, 3, "screening", hit_count=0),
        docs(4, 1), read(4, 2), event(4, 3, "face", similarity_score=0.95), event(4, 4, "screening", hit_count=0),
    ]
    stream = batches(spark, rows, tmp_path / "in", 1)
    out = lifecycle.stream_case_lifecycle(stream, timeout_min=0.05, horizon_min=0.05)
    with state_settings(spark, 2, finite=False):
        q = (
            out.writeStream.format("memory").queryName("lifecycle_rows").outputMode("append")
            .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="1 second").start()
        )
    try:
        seen = lambda: sorted((r.case_id, r.status, r.reason) for r in spark.table("lifecycle_rows").collect())
        want = [
            (1, "needs_review", "failed to fetch case documents"), (2, "needs_review", "extraction failed or timed out"),
            (2, "rejected", None), (3, "needs_review", "face match activity failed"), (4, "approved", None),
        ]
        assert wait_for(q, lambda: len(seen()) == len(want))
        assert seen() == sorted(want, key=lambda r: (r[0], r[1], str(r[2])))
        # Two cases are final and forgotten, two stay parked: a phase each and nothing else.
        state = lambda: q.lastProgress["stateOperators"][0]["numRowsTotal"]
        phases = lambda: [
            r.value.phase
            for r in spark.read.format("statestore").option("stateVarName", "phase").load(str(tmp_path / "checkpoint")).collect()
        ]
        assert wait_for(q, lambda: state() is not None and phases() == ["parked", "parked"])
    finally:
        q.stop()


@pytest.mark.parametrize("value,text", [(0.84995, "0.8500"), (0.79994999, "0.7999")])
def test_rounding_as_in_the_batch_form(value, text):
    assert str(lifecycle._rounded(value)) == text


def test_cases_share_groups_of_state(spark, tmp_path):
    """State is read and written per group, whatever the number of cases; parked ones wait in it for their decision."""
    n = 60
    rows = [docs(i, 1, failed=True) for i in range(n)] + [event(i, 9, "decision", decision="approved", reviewer_id=i) for i in range(n)]
    stream = lifecycle.stream_case_lifecycle(batches(spark, rows, tmp_path / "in", 2), buckets=4)
    out = run_to_files(stream, "lifecycle", 2, at=str(tmp_path / "out"))
    got = sorted((r.case_id, r.status, r.reviewer_id) for r in out.collect())
    assert got == sorted([(i, "needs_review", None) for i in range(n)] + [(i, "approved", i) for i in range(n)], key=lambda r: (r[0], r[1]))
    state = spark.read.format("statestore").option("stateVarName", "phase").load(str(tmp_path / "out" / "checkpoint")).collect()
    assert len(state) == 4 and sum(len(r.value.cases) for r in state) == n


def test_events_and_cases_are_one_value_each(spark, tmp_path):
    """Every column of an event or a case costs Python time; what is packed comes back as it was."""
    odd = [0.1 + 0.2, 1e-7, float("inf"), -0.0, 5e-324, None]
    rows = [read(i, 2**62 + i, confidence=v, reason='a"b\\\n\u001eü😀') for i, v in enumerate(odd)] + [read(9, 1, confidence=float("nan"))]
    packed = spark.createDataFrame(rows, SCHEMA).select("case_id", lifecycle._packed().alias("e")).collect()
    got = {r.case_id: lifecycle._unpacked(r.e) for r in packed}
    kept = {r[0]: {n: v for n, v in zip(NAMES[1:], r[1:]) if v is not None} for r in rows}
    assert str(got.pop(9)) == str(kept.pop(9)) and got == kept

    waiting = [docs(1, 1), event(1, 2, "decision", decision="rejected", reviewer_id=3), docs(2, 1, failed=True)]
    stream = lifecycle.stream_case_lifecycle(batches(spark, waiting, tmp_path / "in", 1), buckets=1)
    run_to_files(stream, "lifecycle", 2, at=str(tmp_path / "out"))
    (state,) = spark.read.format("statestore").option("stateVarName", "phase").load(str(tmp_path / "out" / "checkpoint")).collect()
    assert len(state.value.cases) == 2 and all(isinstance(c, (bytes, bytearray)) for c in state.value.cases)
    assert state.value.phase == "open" and state.value.timer is not None
