"""User-supplied models, and reading and writing of lists and evidence."""

from kycmill.operators import clients, extraction, mutations
from kycmill.sources.tables import read_watchlist

GOOD = (
    '{"document_visible": true, "document": {"full_name": "A B", "document_number": "1", '
    '"date_of_birth": "1980-01-01", "document_type": "passport"}}'
)


def test_model_rounds(spark):
    def make_client():
        def read(content, mime, feedback):
            if content == b"good":
                return GOOD
            if content == b"second" and feedback == "not valid JSON":
                return GOOD
            return "nonsense"

        return read

    documents = spark.createDataFrame(
        [(1, b"good", "image/png"), (2, b"second", "image/png"), (3, b"never", "image/png")],
        "document_id int, content binary, mime_type string",
    )
    attempts = clients.run_model(documents, make_client)
    assert sorted((r.document_id, r.attempt) for r in attempts.collect()) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3)]
    resolved = {r.document_id: r.confidence for r in extraction.response_resolve(attempts).collect()}
    assert resolved == {1: 1.0, 2: 0.85, 3: 0.0}


def test_faces_to_similarity(spark):
    def make_client():
        def detect(content):
            one = ((0.0, 0.0, 1.0, 1.0), [1.0, 0.0])
            big = ((0.0, 0.0, 5.0, 5.0), [0.0, 1.0])
            return {b"one": [one], b"two": [one, big], b"none": []}[content]

        return detect

    rows = [(1, "id_document", b"one"), (1, "selfie", b"one"), (2, "id_document", b"one"), (2, "selfie", b"two"),
            (3, "id_document", b"one"), (3, "selfie", b"none"), (4, "selfie", None)]
    images = spark.createDataFrame(rows, "case_id int, doc_type string, content binary")
    faces = clients.detect_faces(images, make_client)
    pairs = images.select("case_id").distinct()
    got = {r.case_id: r.similarity_score for r in extraction.face_match(pairs, faces).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: None, 4: None}


def test_watchlist_file(spark, tmp_path):
    from pyspark.sql import functions as F

    path = tmp_path / "list.csv"
    path.write_text("list_source,name\nOFAC,Mohammed Al-Rashid\nUN,Muhammad Al-Rashid\nUN,Muhammad Al-Rashid\n")
    entries = read_watchlist(spark, str(path)).withColumn("version", F.lit(1))
    assert mutations.watchlist_ingest(entries).count() == 2


def test_watchlist_with_vectors(spark):
    from kycmill.operators import screening

    def make_client():
        return lambda name: [1.0, float(len(name))]

    schema = "list_source string, name string, version int"
    first = spark.createDataFrame([("UN", "Smith", 1), ("UN", "Smith", 2), ("OFAC", "Nowak", 1)], schema)
    listed = screening.ingest_watchlist(first, make_client)
    again = screening.ingest_watchlist(spark.createDataFrame([("UN", "Smith", 3)], schema), make_client, listed)
    got = {r.name: (r.version, r.vector, r.phonetic_codes) for r in again.collect()}
    assert got == {"Smith": (3, [1.0, 5.0], ["SM0", "XMT"]), "Nowak": (1, [1.0, 5.0], ["NK"])}


def test_evidence_files(spark, tmp_path):
    rows = [("a", 1, 0.12345), ("b", 2, None)]
    df = spark.createDataFrame(rows, "tenant_id string, case_id int, match_score double")
    mutations.persist_evidence(df, str(tmp_path / "hits"), ["match_score"])
    mutations.persist_evidence(df, str(tmp_path / "hits"), ["match_score"])
    stored = spark.read.parquet(str(tmp_path / "hits"))
    assert stored.count() == 4 and dict(stored.dtypes)["match_score"] == "decimal(5,4)"
    assert stored.filter("tenant_id = 'b'").agg({"match_score": "max"}).first()[0] is None
    plan = stored.filter("tenant_id = 'b'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan
