"""Risk, decision cascade, reviews, mutations, lists, outbox, attribution."""

import datetime as dt
import hashlib
import hmac
import uuid

import pytest
from pyspark.sql import functions as F

from kycmill.functions.columns import entry_id, hmac_pads, hmac_sha256, json_number
from kycmill.operators import attribution, decisions, mutations, outbox, review, rules


@pytest.mark.parametrize(
    ("confidence", "face", "hits", "score", "parked", "reason"),
    [
        (1.0, 1.0, 1, 1.0, True, "sanctions list hit"),
        (1.0, None, 0, 1.0, True, "no face detected for comparison"),
        (1.0, None, 3, 1.0, True, "sanctions list hit"),
        (0.95, 0.95, 0, 0.05, False, None),
        (0.5, 0.5, 0, 0.5, True, "combined confidence 0.5000 below auto-clear threshold 0.85"),
        (0.849, 0.849, 0, 0.151, True, "combined confidence 0.8490 below auto-clear threshold 0.85"),
        (0.85, 0.85, 0, 0.15, False, None),
        (0.851, 0.851, 0, 0.149, False, None),
    ],
)
def test_risk(spark, confidence, face, hits, score, parked, reason):
    df = spark.createDataFrame([(confidence, face, hits)], "confidence double, face double, hits int")
    r = decisions.risk_assessment(df).first()
    assert r.risk_score == pytest.approx(score)
    assert (r.needs_review, r.risk_reason) == (parked, reason)


def test_risk_grid_equals_python(spark):
    grid = [(c / 1000, f / 1000, 0) for c in range(500, 1001, 7) for f in range(400, 1001, 11)]
    df = spark.createDataFrame(grid, "confidence double, face double, hits int")
    for r in decisions.risk_assessment(df).collect():
        combined = 0.6 * r.face + 0.4 * r.confidence
        assert r.risk_score == round(1.0 - combined, 4)
        assert r.needs_review == (combined < 0.85)
        if r.needs_review:
            assert r.risk_reason == f"combined confidence {combined:.4f} below auto-clear threshold 0.85"


CASES = [
    # name, id document, selfie, failed step, extraction (confidence, method, review, reason), face, hits -> status, reason
    ("fetch", 1, 1, "fetch_case_documents", (0.9, "mrz", False, None), 0.9, 0, "needs_review", "failed to fetch case documents"),
    ("no id", 0, 1, None, None, None, None, "needs_review", "no id_document found for case"),
    ("broken", 1, 1, "extract_document", None, None, None, "needs_review", "extraction failed or timed out"),
    ("unsure", 1, 1, None, (0.0, "vlm", True, "exhausted"), None, None, "needs_review", "exhausted"),
    ("no selfie", 1, 0, None, (0.99, "mrz", False, None), None, None, "needs_review", "no selfie found for case"),
    ("face", 1, 1, "face_match", (0.99, "mrz", False, None), None, 0, "needs_review", "face match activity failed"),
    ("screen", 1, 1, "sanctions_screen", (0.99, "mrz", False, None), 0.95, None, "needs_review", "sanctions screening activity failed"),
    ("faceless", 1, 1, None, (0.99, "mrz", False, None), "none", 0, "needs_review", "no face detected for comparison"),
    ("hit", 1, 1, None, (0.99, "mrz", False, None), 0.95, 2, "needs_review", "sanctions list hit"),
    ("clean", 1, 1, None, (0.99, "mrz", False, None), 0.95, 0, "approved", None),
]


def _decided(spark):
    cases = spark.createDataFrame([("t", c[0]) for c in CASES], "tenant_id string, case_id string")
    documents = spark.createDataFrame(
        [(c[0], "k" if c[1] else None, "k" if c[2] else None) for c in CASES],
        "case_id string, id_document_key string, selfie_key string",
    )
    steps = spark.createDataFrame(
        [(c[0], c[3], 1, "failed") for c in CASES if c[3]]
        + [("clean", "face_match", 1, "failed"), ("clean", "face_match", 2, "completed")],
        "case_id string, step string, seq int, outcome string",
    )
    extractions = spark.createDataFrame(
        [(c[0], *c[4]) for c in CASES if c[4]],
        "case_id string, confidence double, method string, needs_review boolean, reason string",
    )
    faces = spark.createDataFrame(
        [(c[0], None if c[5] == "none" else c[5]) for c in CASES if c[5] is not None],
        "case_id string, similarity_score double",
    )
    screens = spark.createDataFrame([(c[0], c[6]) for c in CASES if c[6] is not None], "case_id string, hit_count bigint")
    return decisions.case_decisions(cases, documents, steps, extractions, faces, screens)


def test_decision_cascade(spark):
    got = {r.case_id: r for r in _decided(spark).collect()}
    for c in CASES:
        assert (got[c[0]].status, got[c[0]].reason) == (c[7], c[8]), c[0]
    assert got["fetch"].confidence is None and got["unsure"].confidence == 0.0
    # A failed screening is scored as no hit but reported as unknown.
    assert got["screen"].sanctions_hit_count is None and got["screen"].risk_score == pytest.approx(0.034)
    assert got["face"].risk_score == 1.0 and got["no selfie"].risk_score is None


def test_review_resolution(spark):
    at = dt.datetime(2026, 1, 1)
    rows = [
        (1, "hit", "escalated", 7, at), (2, "hit", "approved", 8, at), (3, "hit", "rejected", 9, at + dt.timedelta(1)),
        (4, "fetch", "escalated", 7, at), (5, "clean", "rejected", 7, at),
    ]
    rows = [("t", *r) for r in rows] + [("u", 6, "fetch", "approved", 5, at), ("u", 0, "hit", "rejected", 5, at)]
    log = spark.createDataFrame(
        rows,
        "tenant_id string, decision_id int, case_id string, decision string, reviewer_id int, decided_at timestamp",
    )
    got = {r.case_id: r for r in decisions.review_resolution(_decided(spark), log).collect()}
    assert (got["hit"].final_status, got["hit"].reviewer_id, got["hit"].escalations) == ("approved", 8, 1)
    assert (got["fetch"].final_status, got["fetch"].escalations) == ("needs_review", 1)
    assert (got["clean"].final_status, got["clean"].reviewer_id) == ("approved", None)
    assert got["unsure"].escalations == 0


def test_idempotent_ingest(spark):
    at = dt.datetime(2026, 1, 1)
    schema = "tenant_id string, idempotency_key string, created_at timestamp, case_id int"
    hot = [("a", "k", at + dt.timedelta(seconds=i), 100 + i) for i in range(50)]
    new = spark.createDataFrame(
        [("b", "k", at, 2), ("a", None, at, 3), ("a", "", at, 4), ("a", "", at, 6), ("a", "old", at, 5), *hot], schema
    )
    existing = spark.createDataFrame([("a", "old", at + dt.timedelta(9), 1), ("a", None, at, 0)], schema)
    got = {r.request_id: (r.case_id, r.is_replay) for r in mutations.idempotent_ingest(new, existing).collect()}
    assert got[2] == (2, False) and got[3] == (3, False) and got[5] == (1, True)
    assert got[4] == (4, False) and got[6] == (6, False)
    assert got[100] == (100, False) and all(got[100 + i] == (100, True) for i in range(1, 50))


def test_entry_ids_and_upsert(spark):
    rows = [("OFAC", "José Núñez", 1), ("UN", "A:B", 1), ("UN", "A:B", 2)]
    df = spark.createDataFrame(rows, "list_source string, name string, version int")
    ids = [r[0] for r in df.select(entry_id(F.col("list_source"), F.col("name"))).collect()]
    assert ids == [str(uuid.uuid5(uuid.NAMESPACE_URL, f"{s}:{n}")) for s, n, _ in rows]
    first = mutations.watchlist_ingest(df)
    assert {(r.entry_id, r.version) for r in first.collect()} == {(ids[0], 1), (ids[1], 2)}
    again = mutations.watchlist_ingest(df.withColumn("version", F.lit(3)), first)
    assert {(r.entry_id, r.version) for r in again.collect()} == {(ids[0], 3), (ids[1], 3)}


def test_upsert_soft_delete_and_state(spark):
    at = dt.datetime(2026, 1, 1)
    later = at + dt.timedelta(1)
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, name string, role string")
    changes = spark.createDataFrame([(2, "z"), (3, "w")], "k int, role string")
    merged = mutations.keyed_upsert(base, changes.unionByName(changes), ["k"])
    assert sorted(tuple(r) for r in merged.collect()) == [(1, "a", "x"), (2, "b", "z"), (3, None, "w")]
    rows = spark.createDataFrame([(1, None), (2, at), (3, None)], "k int, ended timestamp")
    ends = spark.createDataFrame([(1, later), (1, at), (2, later)], "k int, at timestamp")
    got = {r.k: r.ended for r in mutations.soft_delete(rows, ends, "k", "ended").collect()}
    assert got == {1: at, 2: at, 3: None}
    state = "case_id int, status string, risk_score double, decision string, decided_at timestamp"
    cases = spark.createDataFrame([(1, "pending", None, None, None), (2, "pending", None, None, None)], state)
    log = spark.createDataFrame(
        [(1, 1, "needs_review", None, None, None), (1, 2, None, 0.5, None, None), (1, 3, "approved", None, "approved", at)],
        "case_id int, seq int, status string, risk_score double, decision string, decided_at timestamp",
    )
    got = {r.case_id: tuple(r)[1:] for r in mutations.case_state(cases, log).collect()}
    assert got == {1: ("approved", 0.5, "approved", at), 2: ("pending", None, None, None)}


def test_claims_and_admission(spark):
    at = dt.datetime(2026, 1, 1)
    cases = spark.createDataFrame(
        [("t", 1, "n", at, "needs_review"), ("t", 2, "n", at, "approved")],
        "tenant_id string, case_id int, subject_name string, created_at timestamp, status string",
    )
    claims = spark.createDataFrame(
        [("t", 1, 1, 7, at), ("t", 2, 1, 8, at + dt.timedelta(1)), ("t", 3, 2, 7, at), ("u", 4, 1, 9, at + dt.timedelta(2))],
        "tenant_id string, claim_id int, case_id int, reviewer_id int, claimed_at timestamp",
    )
    assert [(r.case_id, r.claimed_by_reviewer_id) for r in mutations.apply_claims(cases, claims).collect()] == [(1, 8)]
    asked = spark.createDataFrame(
        [("t", 1, 1), ("t", 2, 2), ("t", 3, 9), ("u", 4, 1)], "tenant_id string, decision_id int, case_id int"
    )
    got = {r.decision_id: r.outcome for r in mutations.decision_admission(asked, cases).collect()}
    assert got == {1: "accepted", 2: "conflict", 3: "not_found", 4: "not_found"}


def test_counts_of_an_empty_tenant(spark):
    tenants = spark.createDataFrame([("a",), ("b",)], "tenant_id string")
    cases = spark.createDataFrame(
        [("a", "needs_review"), ("a", "needs_review"), ("a", "approved")], "tenant_id string, status string"
    )
    got = {(r.tenant_id, r.status): r.n for r in review.status_counts(cases, tenants).collect()}
    assert len(got) == 10 and got["a", "needs_review"] == 2 and got["a", "approved"] == 1
    assert sum(n for (t, _), n in got.items() if t == "b") == 0
    cards = {r.tenant_id: r for r in review.overview_cards(cases, tenants).collect()}
    assert (cards["a"].needs_review, cards["a"].shown_statuses, cards["b"].shown_statuses) == (2, 2, 0)


def test_nested_hits(spark):
    hits = spark.createDataFrame(
        [(1, "L", "B", 0.5, "vector"), (1, "L", "A", 1.0, "phonetic"), (3, "L", "C", 1.0, "vector")],
        "case_id int, list_source string, matched_name string, match_score double, method string",
    )
    detail = spark.createDataFrame([(1,), (2,)], "case_id int")
    got = {r.case_id: [h.matched_name for h in r.sanctions_hits] for r in review.nest_hits(detail, hits).collect()}
    assert got == {1: ["A", "B"], 2: []}


def test_signatures(spark):
    secrets = ["s", "x" * 64, "y" * 65, "ключ"]
    body = '{"a": "é"}'
    df = spark.createDataFrame([(s,) for s in secrets], "secret string").withColumn("pads", hmac_pads(F.col("secret")))
    got = [r[0] for r in df.select(hmac_sha256(F.col("pads"), F.lit(body))).collect()]
    assert got == [hmac.new(s.encode(), body.encode(), hashlib.sha256).hexdigest() for s in secrets]


def test_outbox(spark):
    decided = spark.createDataFrame(
        [("a", 1, "approved", 0.0001), ("a", 2, "rejected", None), ("b", 3, "approved", 1.0), ("c", 4, "approved", 0.5)],
        "tenant_id string, case_id int, decision string, risk_score double",
    )
    hooks = spark.createDataFrame(
        [("a", 1, "s", None), ("a", 2, "t", None), ("b", 3, "u", dt.datetime(2026, 1, 1))],
        "tenant_id string, webhook_id int, secret string, disabled_at timestamp",
    )
    got = {(r.case_id, r.webhook_id): r for r in outbox.webhook_outbox(decided, hooks).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert got[1, 1].body == '{"case_id": "1", "decision": "approved", "event": "case.decided", "risk_score": 0.0001}'
    assert '"risk_score": null' in got[2, 1].body
    assert got[1, 2].signature == hmac.new(b"t", got[1, 2].body.encode(), hashlib.sha256).hexdigest()
    numbers = spark.createDataFrame([(0.05,), (1.0,), (0.25,), (0.0,)], "x double")
    assert [r[0] for r in numbers.select(json_number(F.col("x"))).collect()] == ["0.05", "1.0", "0.25", "0.0"]


def test_delivery_outcomes(spark):
    rows = [(1, 1, 1, False), (1, 1, 2, True), (2, 1, 1, False), (2, 1, 2, False), (2, 1, 3, False), (2, 1, 4, True), (3, 1, 1, False)]
    attempts = spark.createDataFrame(rows, "case_id int, webhook_id int, attempt int, ok boolean")
    outcomes = outbox.delivery_outcome(attempts)
    got = {r.case_id: (r.status, r.attempt_count) for r in outcomes.collect()}
    assert got == {1: ("delivered", 2), 2: ("failed", 3), 3: ("pending", 1)}
    cases = spark.createDataFrame([(1,), (2,), (9,)], "case_id int")
    summary = {tuple(r) for r in outbox.delivery_summary(cases, outcomes).collect()}
    assert summary == {(1, 1, 0, 1), (2, 0, 1, 1), (9, 0, 0, 0)}


def test_attribution(spark):
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    gone = dt.datetime(2026, 1, 1)
    reviewers = spark.createDataFrame(
        [("t1", h("both"), None), ("t1", h("ex"), gone), ("t1", h("moved"), gone)],
        "tenant_id string, token_hash string, revoked_at timestamp",
    )
    keys = spark.createDataFrame(
        [("t2", h("both"), None), ("t2", h("moved"), None), ("t2", h("key"), None)],
        "tenant_id string, key_hash string, revoked_at timestamp",
    )
    headers = ["Bearer both", "Bearer ex", "Bearer moved", "Bearer  key ", "Bearer x", "Bearer ", "bearer key", None]
    asked = spark.createDataFrame(list(enumerate(headers)), "request_id int, authorization string")
    got = {r.request_id: (r.principal, r.tenant_id, r.outcome) for r in attribution.token_attribution(asked, reviewers, keys).collect()}
    assert [got[i] for i in range(8)] == [
        ("reviewer", "t1", "ok"), (None, None, "revoked"), ("api_key", "t2", "ok"), ("api_key", "t2", "ok"),
        (None, None, "unknown"), (None, None, "empty"), (None, None, "malformed"), (None, None, "malformed"),
    ]


def test_keys(spark):
    child = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id int, ref int")
    parent = spark.createDataFrame([(5,)], "id int")
    bad = rules.fk_violations([rules.ForeignKey("fk", child, "id", "ref", parent, "id")]).collect()
    assert [(r.fk, r.row_id, r.missing) for r in bad] == [("fk", "2", "6")]
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, None), (2, "a")], "t int, email string")
    assert [tuple(r) for r in rules.unique_conflicts(rows, ["t", "email"]).collect()] == [(1, "a", 2)]


def test_many_references_and_keys_at_once(spark):
    child = spark.createDataFrame([(1, 5, 50), (2, 6, 51), (3, None, 50)], "id int, ref int, other int")
    other = spark.createDataFrame([("x", 6), ("y", 5)], "name string, ref int")
    a, b = spark.createDataFrame([(5,)], "id bigint"), spark.createDataFrame([(50,), (5,)], "id bigint")
    fk = rules.ForeignKey
    keys = [
        fk("child.a", child, "id", "ref", a, "id"), fk("child.a2", child, "id", "other", a, "id"), fk("other.a", other, "name", "ref", a, "id"),
        fk("child.b", child, "id", "other", b, "id"),
    ]
    found = rules.fk_violations(keys)
    assert sorted(tuple(r) for r in found.collect()) == [
        ("child.a", "2", "6"), ("child.a2", "1", "50"), ("child.a2", "2", "51"), ("child.a2", "3", "50"), ("child.b", "2", "51"),
        ("other.a", "x", "6"),
    ]
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, None), (2, "a")], "t int, email string")
    got = rules.key_conflicts({"both": (rows, ["t", "email"]), "one": (rows, ["email"]), "id": (child, ["id"])})
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(tuple(r) for r in got.collect()) == [("both", "1|a", 2), ("one", "a", 3)]
