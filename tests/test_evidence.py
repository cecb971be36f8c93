"""MRZ lines and checks, model responses, extraction, faces, uploads."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kycmill.functions.mrz import check_digit
from kycmill.operators import extraction, rules

AS_OF = dt.date(2025, 1, 1)
VALUES = {c: i for i, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")} | {"<": 0}


def digit(text):
    return str(sum(VALUES[c] * (7, 3, 1)[i % 3] for i, c in enumerate(text)) % 10)


def zone(number="123456789", dob="800101", expiry="300101", personal="<" * 14, check=None):
    n, d, e = number + digit(number), dob + digit(dob), expiry + digit(expiry)
    p = personal + (digit(personal) if check is None else check)
    line2 = n + "USA" + d + "M" + e + p + digit(n + d + e + p)
    return "P<USASMITH<<JOHN<ROBERT".ljust(44, "<"), line2


def validate(spark, *pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "document_id int, line1 string, line2 string")
    return [r.asDict() for r in extraction.mrz_validate(df, AS_OF).orderBy("document_id").collect()]


@pytest.mark.parametrize(("text", "want"), [("1", "7"), ("AB", "3"), ("<<<", "0"), ("D23145890734", None)])
def test_check_digit(spark, text, want):
    got = spark.range(1).select(check_digit(F.lit(text), len(text))).first()[0]
    assert got == (want or digit(text))


def test_valid_zone(spark):
    (r,) = validate(spark, zone())
    assert r["valid"] and r["failed_checks"] == []
    assert (r["full_name"], r["document_number"], r["nationality"], r["document_type"]) == (
        "JOHN ROBERT SMITH", "123456789", "USA", "P",
    )
    assert (r["date_of_birth"], r["expiry_date"]) == (dt.date(1980, 1, 1), dt.date(2030, 1, 1))


def test_zone_failures(spark):
    line1, line2 = zone()
    broken = validate(
        spark,
        (line1, "X" + line2[1:]),
        ("TOO SHORT", line2),
        zone(check="<"),
        (line1, line2[:5] + "?" + line2[6:]),
        zone(dob="801301"),
        (line1, None),
        (f"  {line1.lower()}\n", f"{line2.lower()} "),
        zone(personal="ZE184226B<<<<<"),
        (line1, line2[:9] + "K" + line2[10:]),
        ("P<USASMITH".ljust(44, "<"), line2),
    )
    checks = [r["failed_checks"] for r in broken]
    assert checks[0] == ["document_number", "composite"]
    assert checks[1] == ["line_length"] and broken[1]["full_name"] is None
    assert checks[2] == []
    assert checks[3] == ["invalid_character"]
    assert checks[4] == ["date_of_birth_format"] and broken[4]["date_of_birth"] is None
    assert checks[5] == ["line_length"]
    assert checks[6] == [] and checks[7] == []
    assert "document_number" in checks[8]
    assert broken[9]["full_name"] == "SMITH"


def test_century(spark):
    old, young = validate(spark, zone(dob="260101"), zone(dob="250101"))
    assert old["date_of_birth"].year == 1926 and young["date_of_birth"].year == 2025


def test_line_assembly(spark):
    def box(document, y, text):
        return (document, [[0.0, y + 9.0], [5.0, y + 9.0], [5.0, y + 0.0], [0.0, y + 0.0]], text, 0.9)

    rows = [
        box(1, 50, "H" * 40), box(1, 300, "second" + "x" * 30), box(1, 280, "fir st" + "y" * 29),
        box(2, 10, "short"), box(2, 20, "A" * 35),
        box(3, 10, "B" * 48), box(3, 20, "C" * 30), box(3, 30, "tiny"),
    ]
    df = spark.createDataFrame(rows, "document_id int, bbox array<array<double>>, text string, confidence double")
    got = {r.document_id: (r.line1, r.line2) for r in extraction.mrz_lines(df).collect()}
    assert got[1] == (("FIRST" + "Y" * 29).ljust(44, "<"), ("SECOND" + "X" * 30).ljust(44, "<"))
    assert got[2] == (None, None)
    assert got[3] == ("B" * 44, ("C" * 30).ljust(44, "<"))


GOOD = (
    '{"document_visible": true, "document": {"full_name": "A B", "document_number": "1", '
    '"date_of_birth": "1980-01-01", "document_type": "passport"}}'
)


@pytest.mark.parametrize(
    ("raws", "confidence", "reason"),
    [
        ([GOOD], 1.0, None),
        (["nonsense", GOOD], 0.85, None),
        (['{"document_visible": false}', "{}", GOOD], 0.7, None),
        (['{"document_visible": false}'] * 3 + [GOOD], 0.0, "exhausted 3 retries; last issue: no document visible"),
        ([GOOD.replace("1980-01-01", "1980-02-31")] * 3, 0.0, "exhausted 3 retries; last issue: date_of_birth invalid"),
        ([GOOD.replace("A B", "")] * 3, 0.0, "exhausted 3 retries; last issue: full_name empty"),
        ([GOOD.replace("true", '"yes"')], 1.0, None),
        ([GOOD.replace("true", "7")] * 3, 0.0, "exhausted 3 retries; last issue: document_visible missing"),
        ([GOOD + " and more"] * 3, 0.0, "exhausted 3 retries; last issue: not valid JSON"),
        ([GOOD + "," + GOOD] * 3, 0.0, "exhausted 3 retries; last issue: not valid JSON"),
        ([GOOD.replace('"A B"', '{"x": 1}')] * 3, 0.0, "exhausted 3 retries; last issue: full_name not a text"),
        ([GOOD.replace('"1"', "1")] * 3, 0.0, "exhausted 3 retries; last issue: document_number not a text"),
        ([GOOD[:-9]] * 2 + [GOOD], 0.7, None),
    ],
)
def test_responses(spark, raws, confidence, reason):
    df = spark.createDataFrame([(1, i + 1, r) for i, r in enumerate(raws)], "document_id int, attempt int, raw string")
    r = extraction.response_resolve(df).first()
    assert r.confidence == pytest.approx(confidence)
    assert (r.reason, r.needs_review) == (reason, reason is not None)
    assert (r.document is None) == r.needs_review


def test_zone_before_model(spark):
    good, bad = zone(), ("P<X", "Y")
    lines = spark.createDataFrame([(1, *good), (2, *bad), (3, *bad)], "document_id int, line1 string, line2 string")
    attempts = spark.createDataFrame([(1, 1, GOOD), (2, 1, GOOD)], "document_id int, attempt int, raw string")
    mrz = extraction.mrz_validate(lines, AS_OF)
    resolved = extraction.extraction_resolve(mrz, extraction.response_resolve(attempts))
    got = {r.document_id: r for r in resolved.collect()}
    assert set(got) == {1, 2}
    assert (got[1].method, got[1].confidence, got[1].model_version) == ("mrz", 0.99, "mrz-icao9303")
    assert (got[2].method, got[2].document.full_name) == ("vlm", "A B")
    documents = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "document_id int")
    assert sorted(r.document_id for r in extraction.needs_model(documents, mrz).collect()) == [2, 3, 4]


def test_faces(spark):
    same, other = [1.0, 0.0], [0.0, 1.0]

    def face(face_id, case, kind, size, vector):
        return (face_id, case, kind, (0.0, 0.0, size, size), vector)

    rows = [
        face(1, 1, "id_document", 5.0, same), face(2, 1, "id_document", 1.0, other), face(3, 1, "selfie", 1.0, same),
        face(4, 2, "id_document", 1.0, same), face(5, 2, "selfie", 1.0, other), face(6, 3, "selfie", 1.0, same),
    ]
    schema = "face_id int, case_id int, doc_type string, box struct<x1:double,y1:double,x2:double,y2:double>, embedding array<float>"
    pairs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "case_id int")
    got = {r.case_id: r for r in extraction.face_match(pairs, spark.createDataFrame(rows, schema)).collect()}
    assert (got[1].similarity_score, got[2].similarity_score) == (1.0, 0.0)
    assert not got[2].needs_review
    for case in (3, 4):
        assert got[case].similarity_score is None and got[case].reason == "no face detected in image"


def test_blobs(spark, tmp_path):
    import hashlib

    from kycmill.sources.tables import read_blobs

    (tmp_path / "t" / "1").mkdir(parents=True)
    (tmp_path / "t" / "1" / "id_document").write_bytes(b"abc")
    (tmp_path / "t" / "1" / "selfie").write_bytes(b"xyz")
    blobs = read_blobs(spark, str(tmp_path))
    docs = spark.createDataFrame([("t/1/id_document",), ("t/2/selfie",)], "s3_key string")
    got = {r.s3_key: r for r in extraction.attach_blobs(docs, blobs).collect()}
    assert got["t/1/id_document"].sha256 == hashlib.sha256(b"abc").hexdigest()
    assert not got["t/2/selfie"].is_uploaded and got["t/2/selfie"].sha256 is None
    pairs = spark.createDataFrame([("t/1/id_document", "t/1/selfie")], "id_document_key string, selfie_key string")
    assert extraction.photo_pair_digest(pairs, blobs).first().input_hash == hashlib.sha256(b"abcxyz").hexdigest()


def test_uploads_and_domains(spark):
    rows = [("image/png", 5), ("text/html", -1), ("image/png", 0), ("image/png", 11), (None, 5)]
    df = spark.createDataFrame(rows, "content_type string, size_bytes int")
    errors = [r.error for r in rules.upload_validation(df, 10).collect()]
    assert errors[0] is None
    assert errors[1] == errors[4] == "content_type must be one of ['application/pdf', 'image/jpeg', 'image/png']"
    assert errors[2:4] == ["size_bytes must be positive", "size_bytes exceeds the 10-byte limit"]
    cases = spark.createDataFrame([("approved", None), ("gone", "x"), (None, "approved")], "status string, decision string")
    domains = {"status": ["approved"], "decision": ["approved"]}
    valid, rejected = rules.domain_quarantine(cases, domains, required=["status"])
    assert valid.count() == 1
    assert {tuple(r.failed_rules) for r in rejected.collect()} == {("status_domain", "decision_domain"), ("status_required",)}


def test_tenant_scope_fails_closed(spark):
    df = spark.createDataFrame([(1,), (None,)], "tenant_id int")
    assert rules.tenant_scope(df, 1).count() == 1
    assert rules.tenant_scope(df, None).count() == 0


def test_id_spellings(spark):
    hexed = "6ba7b8119dad11d180b400c04fd430c8"
    dashed = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    texts = [hexed, dashed, "{" + dashed.upper() + "}", "urn:uuid:" + dashed, "not-an-id", hexed[1:], "", None]
    df = spark.createDataFrame([(t,) for t in texts], "id string")
    assert [r.is_valid for r in rules.id_format(df, "id").collect()] == [True] * 4 + [False] * 4
