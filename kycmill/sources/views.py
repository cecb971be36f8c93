"""Domain views over the driver's tables: cases, evidence, reviewers, webhooks, logs and so on.

Each method gives one table of the domain model. ``plans/oracle.py`` states the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mrz import check_digit
from ..schemas import FACE_MODEL, MRZ_MODEL, STEPS
from .tables import Tables


def _text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def _pick(index: Column, values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.t = Tables(spark, folder)

    def tenants(self) -> DataFrame:
        tier = F.when(F.col("n_nationkey") == 24, F.lit("trial")).otherwise(
            _pick(F.col("n_regionkey") % 3, ["standard", "pro", "enterprise"])
        )
        suspended = F.col("n_nationkey") % 12 == 11
        return self.t["nation"].select(
            F.col("n_nationkey").alias("tenant_id"),
            F.col("n_name").alias("name"),
            F.lower("n_name").alias("slug"),
            tier.alias("plan_tier"),
            F.when(suspended, F.lit("suspended")).otherwise(F.lit("active")).alias("status"),
        )

    def cases(self) -> DataFrame:
        return self.cases_of(self.t["orders"])

    def cases_of(self, orders: DataFrame) -> DataFrame:
        o, c = orders, self.t["customer"]
        key = F.col("o_orderkey")
        status = (
            F.when((F.col("o_orderstatus") == "F") & (key % 5 == 0), F.lit("rejected"))
            .when(F.col("o_orderstatus") == "F", F.lit("approved"))
            .when(F.col("o_orderstatus") == "P", F.lit("needs_review"))
            .otherwise(F.lit("pending"))
        )
        decided = F.col("status").isin("approved", "rejected")
        return (
            o.join(c, F.col("o_custkey") == F.col("c_custkey"))
            .withColumn("status", status)
            .select(
                key.alias("case_id"),
                F.col("c_nationkey").alias("tenant_id"),
                F.col("c_name").alias("subject_name"),
                F.date_add(F.lit("1950-01-01").cast("date"), (F.col("c_custkey") % 18000).cast("int")).alias(
                    "subject_dob"
                ),
                "status",
                F.when(decided, F.col("status")).alias("decision"),
                F.when(F.col("status") != "pending", F.round((key % 1001) / 1000.0, 3)).alias("risk_score"),
                F.col("o_orderdate").alias("created_at"),
                F.when(decided, F.col("o_orderdate") + F.expr("interval 1 day")).alias("decided_at"),
                F.when(key % 3 != 0, F.when(F.col("o_custkey") % 200 == 0, "").otherwise(_text(F.col("o_custkey") % 200))).alias(
                    "idempotency_key"
                ),
            )
        )

    def evidence(self) -> DataFrame:
        return self.t["lineitem"].select(
            F.col("l_orderkey").alias("case_id"),
            F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("evidence_id"),
            F.round(1 - F.col("l_discount"), 3).alias("confidence"),
            F.when(F.col("l_linenumber") != 7, F.round(1 - F.col("l_tax") * 4, 3)).alias("face"),
            F.when(F.col("l_quantity") >= 49, 1).otherwise(0).alias("hits"),
            F.col("l_shipdate").alias("created_at"),
            "l_linestatus",
        )

    def documents(self) -> DataFrame:
        key = F.col("case_id")

        def doc(doc_type: str, version: int, keep: Column) -> Column:
            suffix = "" if version == 0 else f"/v{version + 1}"
            at = F.col("created_at") + F.expr(f"interval {version} hours")
            return F.when(
                keep,
                F.struct(
                    F.lit(doc_type).alias("doc_type"),
                    F.concat(_text(key), F.lit(f"-{doc_type}-{version}")).alias("document_id"),
                    F.concat(_text("tenant_id"), F.lit("/"), _text(key), F.lit(f"/{doc_type}{suffix}")).alias("s3_key"),
                    at.alias("uploaded_at"),
                ),
            )

        docs = F.array_compact(
            F.array(
                doc("id_document", 0, key % 50 != 7),
                doc("id_document", 1, key % 25 == 0),
                doc("selfie", 0, key % 40 != 3),
            )
        )
        return self.cases().select("tenant_id", "case_id", F.explode(docs).alias("d")).select(
            "tenant_id", "case_id", "d.*"
        )

    def steps(self) -> DataFrame:
        key = F.col("case_id")
        bad = {"fetch_case_documents": 97, "extract_document": 89, "face_match": 83, "sanctions_screen": 79}

        def step(name: str) -> Column:
            failed = key % bad[name] == 0 if name in bad else F.lit(False)
            died = (key % 71 == 0) if name == "sanctions_screen" else F.lit(False)
            model = {"extract_document": MRZ_MODEL, "face_match": FACE_MODEL}.get(name)
            return F.struct(
                F.lit(name).alias("step"),
                F.lit(STEPS.index(name)).alias("seq"),
                F.when(failed, F.lit("failed")).when(~died, F.lit("completed")).alias("outcome"),
                F.lit(model).cast("string").alias("model_version"),
            )

        return (
            self.cases()
            .select("tenant_id", "case_id", "created_at", F.explode(F.array(*[step(s) for s in STEPS])).alias("s"))
            .select(
                "tenant_id",
                "case_id",
                "s.*",
                F.when(F.col("s.model_version").isNotNull(), F.sha2(_text("case_id"), 256)).alias("input_hash"),
                F.concat(F.lit('{"case_id": "'), _text("case_id"), F.lit('"}')).alias("payload"),
                F.concat(F.lit('step "'), F.col("s.step"), F.lit('" '), F.repeat(F.lit("x"), F.lit(600))).alias("error"),
                (F.col("created_at") + F.make_dt_interval(mins=F.col("s.seq"))).alias("at"),
            )
        )

    def decisions(self) -> DataFrame:
        n = self.t["orders"].agg(F.floor(F.count("*") / 5)).scalar()
        decision = (
            F.when(F.col("event_type") == "purchase", F.lit("approved"))
            .when(F.col("event_type") == "error", F.lit("rejected"))
            .otherwise(F.lit("escalated"))
        )
        lost = F.col("event_id") % 101 == 0
        return self._by_reviewer(
            self.t["events"].select(
                F.col("event_id").alias("decision_id"),
                F.col("user_id").alias("reviewer_id"),
                F.when(lost, -F.col("event_id")).otherwise(F.col("event_id") % n).alias("case_id"),
                decision.alias("decision"),
                F.col("props").alias("justification"),
                F.col("ts").alias("decided_at"),
            ),
            "decision_id",
        )

    def _by_reviewer(self, rows: DataFrame, key: str) -> DataFrame:
        """The tenant of the reviewer: mostly the case's own."""
        of_case = self.cases().select("case_id", F.col("tenant_id").alias("case_tenant"))
        other = (F.coalesce("case_tenant", F.lit(0)) + F.when(F.col(key) % 13 == 5, 1).otherwise(0)) % 25
        return rows.join(of_case, "case_id", "left").withColumn("tenant_id", other.cast("long")).drop("case_tenant")

    def mutations(self) -> DataFrame:
        return self.mutations_of(self.t["events"])

    def mutations_of(self, events: DataFrame) -> DataFrame:
        n = self.t["orders"].agg(F.floor(F.count("*") / 5)).scalar()
        kind = F.col("event_type")
        final = F.when(kind == "purchase", F.lit("approved")).when(kind == "error", F.lit("rejected"))
        return events.select(
            (F.col("event_id") % n).alias("case_id"),
            F.col("event_id").alias("seq"),
            F.coalesce(final, F.when(kind == "view", F.lit("needs_review"))).alias("status"),
            F.when(kind == "click", F.round((F.col("event_id") % 1000) / 1000.0, 3)).alias("risk_score"),
            final.alias("decision"),
            F.when(final.isNotNull(), F.col("ts")).alias("decided_at"),
        )

    def claims(self) -> DataFrame:
        n = self.t["orders"].agg(F.floor(F.count("*") / 5)).scalar()
        return self._by_reviewer(
            self.t["events"].select(
                F.col("event_id").alias("claim_id"),
                (F.col("event_id") % n).alias("case_id"),
                F.col("user_id").alias("reviewer_id"),
                F.col("ts").alias("claimed_at"),
            ),
            "claim_id",
        )

    def reviewers(self) -> DataFrame:
        key = F.col("s_suppkey")
        role = F.when(key % 17 == 0, F.lit("owner")).otherwise(_pick(key % 3, ["reviewer", "admin", "auditor"]))
        start = F.lit("2023-01-01").cast("timestamp_ntz")
        return self.t["supplier"].select(
            key.alias("reviewer_id"),
            F.col("s_nationkey").alias("tenant_id"),
            F.concat(F.lit("r"), _text(key % 40), F.lit("@example.com")).alias("email"),
            role.alias("role"),
            (start + F.make_dt_interval(days=(key % 700).cast("int"))).alias("created_at"),
            F.sha2("s_name", 256).alias("token_hash"),
            F.when(F.col("s_acctbal") < 0, F.lit("2024-01-01").cast("timestamp_ntz")).alias("revoked_at"),
        )

    def api_keys(self) -> DataFrame:
        return self.t["customer"].select(
            F.col("c_custkey").alias("api_key_id"),
            F.col("c_nationkey").alias("tenant_id"),
            F.sha2("c_name", 256).alias("key_hash"),
            F.col("c_mktsegment").alias("name"),
            F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01").cast("timestamp_ntz")).alias("revoked_at"),
        )

    def webhooks(self) -> DataFrame:
        return self.t["supplier"].select(
            F.col("s_suppkey").alias("webhook_id"),
            F.col("s_nationkey").alias("tenant_id"),
            F.concat(F.lit("https://hooks.example.com/"), _text("s_suppkey")).alias("url"),
            F.concat(F.lit("secret-"), _text("s_suppkey")).alias("secret"),
            F.when(F.col("s_acctbal") < 0, F.lit("2024-01-01").cast("timestamp_ntz")).alias("disabled_at"),
        )

    def deliveries(self) -> DataFrame:
        never = (F.col("l_linestatus") == "O") & (F.col("l_linenumber") % 2 == 0)
        status = (
            F.when(F.col("l_returnflag") == "R", F.lit("failed"))
            .when(F.col("l_returnflag") == "A", F.lit("delivered"))
            .otherwise(F.lit("pending"))
        )
        return self.t["lineitem"].select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("delivery_id"),
            F.col("l_suppkey").alias("webhook_id"),
            F.col("l_orderkey").alias("case_id"),
            status.alias("status"),
            (1 + F.col("l_linenumber") % 3).alias("attempt_count"),
            F.when(~never, F.col("l_shipdate")).alias("last_attempted_at"),
        )

    def delivery_attempts(self) -> DataFrame:
        return self.t["lineitem"].select(
            F.col("l_orderkey").alias("case_id"),
            (F.col("l_suppkey") % 2).alias("webhook_id"),
            F.col("l_linenumber").alias("attempt"),
            (F.col("l_returnflag") == "A").alias("ok"),
        )

    def extractions(self) -> DataFrame:
        document = F.concat(
            F.lit('{"full_name": "P'), _text("l_partkey"), F.lit('", "document_number": "'), _text("l_suppkey"),
            F.lit('", "nationality": "UTO"}'),
        )
        return self.t["lineitem"].select(
            F.col("l_orderkey").alias("case_id"),
            F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("extraction_id"),
            F.concat(_text("l_orderkey"), F.lit("-id_document-0")).alias("document_id"),
            F.when(F.col("l_linestatus") == "O", F.lit(MRZ_MODEL)).otherwise(F.lit("model")).alias("model_version"),
            F.when(F.col("l_returnflag") == "R", F.lit("{}")).otherwise(document).alias("raw_json"),
            F.round(1 - F.col("l_discount"), 3).alias("confidence"),
            (F.col("l_returnflag") != "R").alias("valid"),
            F.col("l_shipdate").alias("created_at"),
        )

    def face_matches(self) -> DataFrame:
        return self.t["lineitem"].filter(F.col("l_quantity") > 10).select(
            F.col("l_orderkey").alias("case_id"),
            F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("face_match_id"),
            F.when(F.col("l_linenumber") != 7, F.round(1 - F.col("l_tax") * 4, 3)).alias("similarity_score"),
            F.col("l_shipdate").alias("created_at"),
        )

    def hits(self) -> DataFrame:
        return self.t["lineitem"].filter(F.col("l_quantity") >= 49).select(
            F.col("l_orderkey").alias("case_id"),
            F.concat(F.lit("LIST-"), F.col("l_returnflag")).alias("list_source"),
            F.concat(F.lit("Part "), _text("l_partkey")).alias("matched_name"),
            F.round(F.col("l_quantity") / 50, 3).alias("match_score"),
            F.when(F.col("l_linestatus") == "F", F.lit("vector")).otherwise(F.lit("phonetic")).alias("method"),
        )

    def audit(self) -> DataFrame:
        return self.audit_of(self.t["events"])

    def audit_of(self, events: DataFrame) -> DataFrame:
        return events.select(
            F.col("event_id").alias("id"),
            (F.col("user_id") % 25).alias("tenant_id"),
            (F.col("event_id") % 97).alias("case_id"),
            "event_type",
            F.concat(F.lit("user:"), _text("user_id")).alias("actor"),
            F.when(F.col("event_type") == "view", F.lit("m1")).alias("model_version"),
            F.lit(None).cast("string").alias("input_hash"),
            F.col("props").alias("payload"),
            F.col("ts").alias("created_at"),
        )

    def step_audit(self) -> DataFrame:
        phase = (
            F.when(F.col("event_type") == "purchase", F.lit("completed"))
            .when(F.col("event_type") == "error", F.lit("failed"))
            .otherwise(F.lit("started"))
        )
        step = _pick((F.col("id") % 97) % 8, list(STEPS))
        return self.audit().withColumn("event_type", F.concat_ws(".", step, phase))

    def requests(self) -> DataFrame:
        return self.t["events"].select(
            F.col("user_id").alias("key"), F.col("event_id").alias("request_id"), "ts"
        )

    def token_requests(self) -> DataFrame:
        key, kind = F.col("event_id"), F.col("event_id") % 10
        name = F.lpad(_text("user_id"), 9, "0")
        header = (
            F.when(kind == 1, F.lit("Basic abc"))
            .when(kind == 2, F.lit("Bearer  "))
            .when(kind.between(3, 5), F.concat(F.lit("Bearer Supplier#"), name))
            .when(kind.between(6, 8), F.concat(F.lit("Bearer Customer#"), name))
            .when(kind == 9, F.lit("Bearer nobody"))
        )
        return self.t["events"].select(key.alias("request_id"), header.alias("authorization"))

    def uploads(self) -> DataFrame:
        kinds = ["image/jpeg", "image/png", "application/pdf", "text/plain"]
        size = F.when(F.col("doc_id") % 5 == 0, F.lit(0)).otherwise(F.col("n_chars") * 1000)
        return self.t["documents"].select(
            "doc_id", _pick(F.col("doc_id") % 4, kinds).alias("content_type"), size.cast("bigint").alias("size_bytes")
        )

    def id_texts(self) -> DataFrame:
        h = F.md5("text")
        dashed = F.concat_ws(
            "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)
        )
        kind = F.col("doc_id") % 4
        text = (
            F.when(kind == 0, dashed)
            .when(kind == 1, h)
            .when(kind == 2, F.concat(F.lit("{"), F.upper(dashed), F.lit("}")))
            .otherwise(F.substring(dashed, 2, 40))
        )
        return self.t["documents"].select("doc_id", text.alias("id_text"))

    def blobs(self) -> DataFrame:
        return self.t["documents"].filter(F.col("doc_id") % 6 != 0).select(
            F.concat(F.lit("doc/"), _text("doc_id")).alias("s3_key"), F.encode("text", "UTF-8").alias("content")
        )

    def attempts(self) -> DataFrame:
        kind = (F.col("conv_id") * 3 + F.col("turn")) % 7
        number = F.concat(F.lit("D"), _text(F.length("text")))

        def response(name: str, birth: str, expiry: str) -> Column:
            return F.concat(
                F.lit('{"document_visible": true, "document": {"full_name": "' + name + '", "document_number": "'),
                number,
                F.lit(f'", "date_of_birth": "{birth}"{expiry}, "document_type": "passport"' + "}}"),
            )

        raw = (
            F.when(kind == 0, F.lit('{"document_visible": tru'))
            .when(kind == 1, F.lit('{"document_visible": false}'))
            .when(kind == 2, F.lit('{"document_visible": true, "document": null}'))
            .when(kind == 3, response("", "1980-01-02", ""))
            .when(kind == 4, response("ANNA MARIA", "1980-13-02", ""))
            .when((kind == 5) & (F.col("conv_id") % 11 == 3), F.concat(response("ANNA MARIA", "1980-01-02", ""), F.lit(" ok")))
            .when((kind == 5) & (F.col("conv_id") % 11 == 5), response('","nationality": 7,"x":"', "1980-01-02", ""))
            .when(kind == 5, response("ANNA MARIA", "1980-01-02", ""))
            .otherwise(response("JON DOE", "1990-12-31", ', "expiry_date": "2031-05-06"'))
        )
        return self.t["conversations"].filter(F.col("role") == "assistant").select(
            F.col("conv_id").alias("document_id"),
            F.floor((F.col("turn") + 1) / 2).cast("int").alias("attempt"),
            raw.alias("raw"),
        )

    def faces(self) -> DataFrame:
        key, image = F.col("vec_id"), F.floor(F.col("vec_id") / 2)
        box = F.struct(
            F.lit(0.0).alias("x1"),
            F.lit(0.0).alias("y1"),
            (1 + F.col("label") % 7).cast("double").alias("x2"),
            (1 + key % 5).cast("double").alias("y2"),
        )
        return self.t["embeddings"].filter(image % 10 != 0).select(
            key.alias("face_id"),
            F.floor(key / 4).alias("case_id"),
            F.when(image % 2 == 0, F.lit("id_document")).otherwise(F.lit("selfie")).alias("doc_type"),
            box.alias("box"),
            "embedding",
        )

    def face_pairs(self) -> DataFrame:
        return self.t["embeddings"].select(F.floor(F.col("vec_id") / 4).alias("case_id")).distinct()

    def mrz(self) -> DataFrame:
        key = F.col("c_custkey")
        two = lambda c: F.lpad(_text(c), 2, "0")
        month = F.when(key % 11 == 0, F.lit("13")).otherwise(two(key % 12 + 1))
        rows = self.t["customer"].select(
            key.alias("document_id"),
            F.col("c_mktsegment").alias("seg"),
            F.lpad(_text(key), 9, "0").alias("num"),
            F.concat(two(key % 100), month, two(key % 28 + 1)).alias("dob"),
            F.concat(F.lit("3"), _text(key % 10), F.lit("0101")).alias("exp"),
        )
        parts = rows.select(
            "document_id",
            "seg",
            F.concat("num", check_digit(F.col("num"), 9)).alias("n1"),
            F.concat("dob", check_digit(F.col("dob"), 6)).alias("d1"),
            F.concat("exp", check_digit(F.col("exp"), 6)).alias("e1"),
        )
        digits = F.concat("n1", "d1", "e1")
        line2 = F.concat(
            "n1", F.lit("UTO"), "d1", F.lit("F"), "e1", F.lit("<" * 15), check_digit(digits, 24)
        )
        z = F.col("z")
        return parts.withColumn("z", line2).select(
            "document_id",
            F.rpad(F.concat(F.lit("P<UTO"), F.upper("seg"), F.lit("<<ANNA<MARIA")), 44, "<").alias("line1"),
            F.when(F.col("document_id") % 13 == 0, F.substring(z, 1, 40))
            .when(F.col("document_id") % 7 == 0, F.concat(F.lit("Z"), F.substring(z, 2, 43)))
            .otherwise(z)
            .alias("line2"),
        )

    def boxes(self) -> DataFrame:
        def box(y: int, text: Column, keep: Column) -> Column:
            corner = lambda x, dy: F.array(F.lit(float(x)), F.lit(float(y + dy)))
            bbox = F.array(corner(10, 12), corner(400, 12), corner(400, 0), corner(10, 0))
            return F.when(keep, F.struct(bbox.alias("bbox"), text.alias("text"), F.lit(0.9).alias("confidence")))

        key, l1, l2 = F.col("document_id"), F.col("line1"), F.col("line2")
        spaced = F.concat(F.substring(l2, 1, 10), F.lit(" "), F.substring(l2, 11, 40))
        shown = F.array_compact(
            F.array(
                box(300, spaced, key % 17 != 0),
                box(50, F.lit("PASSPORT OF A COUNTRY THAT NEVER WAS AT ALL"), key % 3 == 0),
                box(280, F.lower(l1), F.lit(True)),
            )
        )
        return self.mrz().select("document_id", F.explode(shown).alias("b")).select("document_id", "b.*")

    def part_names(self) -> DataFrame:
        return self.t["part"].select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("name"))

    def list_entries(self) -> DataFrame:
        return self.t["part"].select(
            F.col("p_brand").alias("list_source"), F.col("p_name").alias("name"), F.col("p_partkey").alias("version")
        )

    def subjects(self) -> DataFrame:
        """Every embedding as a query, named after a part."""
        n = self.t["part"].agg(F.count("*")).scalar()
        e = self.t["embeddings"].withColumn("p_partkey", F.col("vec_id") % n)
        return e.join(self.t["part"].select("p_partkey", "p_name"), "p_partkey").select(
            F.col("vec_id").alias("query_id"), F.col("p_name").alias("name"), F.col("embedding").alias("vector"), "label"
        )

    def watchlist(self) -> DataFrame:
        """All embeddings as list entries; every one is also a query, so it finds itself."""
        from ..operators.mutations import watchlist_ingest

        entries = self.subjects().select(
            F.concat(F.lit("LIST-"), _text(F.col("query_id") % 1000)).alias("list_source"),
            "name",
            "vector",
            F.col("query_id").alias("version"),
        )
        return watchlist_ingest(entries)
