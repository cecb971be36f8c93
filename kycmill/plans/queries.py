"""The registered queries: operators applied to the domain views, with flat, plainly typed results."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import dot
from ..operators import (
    attribution,
    audit,
    decisions,
    extraction,
    mutations,
    outbox,
    quota,
    review,
    rules,
    screening,
)
from ..schemas import DOMAINS
from ..session import configure, scratch_path
from ..sources.views import Views
from ..streaming import lifecycle, operators
from ..streaming.runs import file_stream, run_to_files, table_stream

Query = Callable[[Views], DataFrame]
REGISTRY: dict[str, Query] = {}

TENANT = 3
AS_OF = dt.date(2024, 6, 30)
NOW = "2001-07-20 00:00:00"
CUTOFF = "1998-01-01"
VECTOR_THRESHOLD = 0.25
DAY_S = 86_400


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _joined(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.array_join(column, ","))


# Tenant scope, rules and keys


@query
def tenant_scope(v: Views) -> DataFrame:
    return rules.tenant_scope(v.cases(), TENANT).select("case_id", "tenant_id", "status")


@query
def domain_quarantine(v: Views) -> DataFrame:
    tables = {
        "tenants": (v.tenants(), "tenant_id"),
        "cases": (v.cases(), "case_id"),
        "reviewers": (v.reviewers(), "reviewer_id"),
        "review_decisions": (v.decisions(), "decision_id"),
        "sanctions_hits": (v.hits(), "case_id"),
        "webhook_deliveries": (v.deliveries(), "delivery_id"),
    }
    found = None
    for name, (df, key) in tables.items():
        valid, rejected = rules.domain_quarantine(df, DOMAINS[name])
        row = [F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_id")]
        both = valid.select(*row, F.lit("").alias("failed_rules")).unionByName(
            rejected.select(*row, F.array_join("failed_rules", ",").alias("failed_rules"))
        )
        found = both if found is None else found.unionByName(both)
    return found.groupBy("table_name", "failed_rules").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


@query
def upload_validation(v: Views) -> DataFrame:
    return rules.upload_validation(v.uploads())


@query
def id_format(v: Views) -> DataFrame:
    return rules.id_format(v.id_texts(), "id_text").select("doc_id", "is_valid")


@query
def webhook_url_check(v: Views) -> DataFrame:
    return rules.webhook_url_check(v.t["pages"].select("page_id", "url"))


@query
def lane_routing(v: Views) -> DataFrame:
    return rules.lane_routing(v.cases(), v.tenants())


@query
def case_lookup(v: Views) -> DataFrame:
    ids = v.t["events"].select(F.col("event_id").alias("case_id"))
    return rules.case_lookup(v.cases(), TENANT, ids).select("case_id", "status")


@query
def fk_violations(v: Views) -> DataFrame:
    """All references of the model; where a view has no such column it is made up, with some values that are lost."""
    tenant = (F.col("case_id") % 25 + F.when(F.col("case_id") % 500 == 7, 25).otherwise(0)).alias("tenant_id")
    key = F.col("case_id")
    cases = v.cases().select("case_id", "tenant_id", F.when(key % 7 == 0, key % 110).alias("claimed_by_reviewer_id"))
    documents, reviewers, webhooks, tenants = v.documents(), v.reviewers(), v.webhooks(), v.tenants()
    decided, api_keys, log = v.decisions(), v.api_keys(), v.audit()
    extractions = v.extractions().select("extraction_id", "case_id", "document_id", tenant)
    faces = v.face_matches().select("face_match_id", "case_id", tenant)
    hits = v.hits().select("matched_name", "case_id", tenant)
    deliveries = v.deliveries().select("delivery_id", "webhook_id", "case_id", tenant)
    children = {
        "case": (cases, "case_id", {"tenant": "tenant_id", "reviewer": "claimed_by_reviewer_id"}),
        "document": (documents, "document_id", {"case": "case_id", "tenant": "tenant_id"}),
        "extraction": (extractions, "extraction_id", {"case": "case_id", "document": "document_id", "tenant": "tenant_id"}),
        "face_match": (faces, "face_match_id", {"case": "case_id", "tenant": "tenant_id"}),
        "hit": (hits, "matched_name", {"case": "case_id", "tenant": "tenant_id"}),
        "decision": (decided, "decision_id", {"case": "case_id", "reviewer": "reviewer_id", "tenant": "tenant_id"}),
        "audit": (log, "id", {"case": "case_id", "tenant": "tenant_id"}),
        "api_key": (api_keys, "api_key_id", {"tenant": "tenant_id"}),
        "reviewer": (reviewers, "reviewer_id", {"tenant": "tenant_id"}),
        "webhook": (webhooks, "webhook_id", {"tenant": "tenant_id"}),
        "delivery": (deliveries, "delivery_id", {"tenant": "tenant_id", "webhook": "webhook_id", "case": "case_id"}),
    }
    parents = {
        "tenant": (tenants, "tenant_id"),
        "case": (cases, "case_id"),
        "reviewer": (reviewers, "reviewer_id"),
        "webhook": (webhooks, "webhook_id"),
        "document": (documents, "document_id"),
    }
    return rules.fk_violations(
        [
            rules.ForeignKey(f"{child}.{parent}", df, row_id, column, *parents[parent])
            for child, (df, row_id, columns) in children.items()
            for parent, column in columns.items()
        ]
    )


@query
def unique_conflicts(v: Views) -> DataFrame:
    """Every unique key, those with conflicts as (constraint, key, rows)."""
    reviewers = v.reviewers()
    return rules.key_conflicts(
        {
            "reviewer_email": (reviewers, ["tenant_id", "email"]),
            "reviewer_token": (reviewers, ["token_hash"]),
            "tenant_slug": (v.tenants(), ["slug"]),
            "api_key_hash": (v.api_keys(), ["key_hash"]),
            "case_idempotency": (v.cases(), ["tenant_id", "idempotency_key"]),
            "hit_name": (v.hits(), ["case_id", "list_source", "matched_name"]),
        }
    )


# Lists, detail and dashboard


@query
def list_cases(v: Views) -> DataFrame:
    columns = ["case_id", "status", "subject_name", "subject_dob", "decision", "created_at", "risk_score"]
    return review.list_cases(v.cases(), TENANT, "approved").select(*columns)


@query
def review_queue(v: Views) -> DataFrame:
    columns = ["case_id", "subject_name", "subject_dob", "risk_score", "created_at"]
    return review.review_queue(v.cases(), TENANT).select(*columns)


@query
def admin_listing(v: Views) -> DataFrame:
    columns = ["reviewer_id", "email", "role", "created_at", "revoked_at"]
    return review.admin_listing(v.reviewers(), TENANT, "reviewer_id").select(*columns)


@query
def latest_extraction(v: Views) -> DataFrame:
    return review.latest_evidence(v.evidence()).select(
        "case_id", "evidence_id", "confidence", "face", "created_at"
    )


@query
def risk_bands(v: Views) -> DataFrame:
    return review.risk_bands(v.cases()).select("case_id", "risk_score", "band")


@query
def json_fields(v: Views) -> DataFrame:
    return review.json_fields(v.t["events"].select("event_id", "props"), "props", "k bigint").drop("props")


@query
def doc_types(v: Views) -> DataFrame:
    return _joined(review.doc_types(v.documents()), "doc_types")


@query
def case_detail(v: Views) -> DataFrame:
    detail = review.case_detail(v.cases(), v.documents(), v.extractions(), v.face_matches(), v.hits())
    hits = F.transform("sanctions_hits", lambda h: F.concat_ws("|", h["list_source"], h["matched_name"], h["method"]))
    return detail.withColumns(
        {"extraction_id_raw": F.coalesce("extraction_id", F.lit("")), "sanctions_hits": F.array_join(hits, ";")}
    ).drop("extraction_id")


@query
def case_hits(v: Views) -> DataFrame:
    return review.case_hits(v.cases(), v.hits())


@query
def status_counts(v: Views) -> DataFrame:
    return review.status_counts(v.cases(), v.tenants())


@query
def overview_cards(v: Views) -> DataFrame:
    return review.overview_cards(v.cases(), v.tenants())


@query
def weekly_volume(v: Views) -> DataFrame:
    return review.weekly_volume(v.cases(), NOW)


@query
def recent_activity(v: Views) -> DataFrame:
    return review.recent_activity(v.cases(), v.decisions(), v.reviewers())


@query
def delivery_log(v: Views) -> DataFrame:
    return review.delivery_log(v.deliveries(), v.webhooks(), TENANT)


# Mutations


@query
def idempotent_ingest(v: Views) -> DataFrame:
    late = F.col("created_at") >= F.lit(CUTOFF).cast("timestamp_ntz")
    cases = v.cases()
    return mutations.idempotent_ingest(cases.filter(late), cases.filter(~late))


@query
def watchlist_ingest(v: Views) -> DataFrame:
    return mutations.watchlist_ingest(v.list_entries())


@query
def keyed_upsert(v: Views) -> DataFrame:
    base = v.reviewers().select("reviewer_id", "tenant_id", "email", "role")
    key = F.col("reviewer_id")
    old = base.filter(key % 3 == 0).select("reviewer_id", "tenant_id")
    new = base.filter((key % 6 == 0) & (key > 0)).select((-key).alias("reviewer_id"), "tenant_id")
    changes = old.unionByName(new).withColumns({"role": F.lit("auditor"), "at": F.lit(2)})
    earlier = changes.withColumns({"role": F.lit("owner"), "at": F.lit(1)})
    return mutations.keyed_upsert(base, earlier.unionByName(changes), ["reviewer_id", "tenant_id"], ["at"])


@query
def soft_delete(v: Views) -> DataFrame:
    errors = v.t["events"].filter(F.col("event_type") == "error")
    changes = errors.select(F.col("user_id").alias("webhook_id"), F.col("ts").alias("at"))
    return mutations.soft_delete(v.webhooks().select("webhook_id", "disabled_at"), changes, "webhook_id", "disabled_at")


@query
def apply_claims(v: Views) -> DataFrame:
    return mutations.apply_claims(v.cases(), v.claims())


@query
def decision_admission(v: Views) -> DataFrame:
    admitted = mutations.decision_admission(v.decisions(), v.cases())
    return admitted.select("decision_id", "case_id", "decision", "outcome")


@query
def case_state(v: Views) -> DataFrame:
    base = v.cases().select("case_id", "status", "risk_score", "decision", "decided_at")
    return mutations.case_state(base, v.mutations())


@query
def case_events(v: Views) -> DataFrame:
    changed = v.mutations().filter(F.col("status").isNotNull())
    rows = changed.join(v.cases().select("case_id", "tenant_id"), "case_id")
    return mutations.case_events(rows).select("seq", "payload")


@query
def evidence_numeric(v: Views) -> DataFrame:
    rows = mutations.evidence_rows(v.evidence(), ["confidence", "face"])
    return rows.select(
        "case_id",
        "evidence_id",
        "created_at",
        F.col("confidence").cast("double").alias("confidence"),
        F.col("face").cast("double").alias("face"),
    )


@query
def token_attribution(v: Views) -> DataFrame:
    return attribution.token_attribution(v.token_requests(), v.reviewers(), v.api_keys())


@query
def quota_admission(v: Views) -> DataFrame:
    decided = quota.quota_admission(v.requests(), limit=2, window_s=DAY_S, windows_per_span=4)
    return decided.select("key", "request_id", "allowed", "retry_after")


# Outbox


def _decided(v: Views) -> DataFrame:
    return v.cases().filter(F.col("decision").isNotNull())


@query
def webhook_outbox(v: Views) -> DataFrame:
    return outbox.webhook_outbox(_decided(v), v.webhooks())


@query
def delivery_outcome(v: Views) -> DataFrame:
    return outbox.delivery_outcome(v.delivery_attempts())


@query
def delivery_summary(v: Views) -> DataFrame:
    return outbox.delivery_summary(v.cases(), outbox.delivery_outcome(v.delivery_attempts()))


# Document and face evidence


@query
def blob_digest(v: Views) -> DataFrame:
    key = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("s3_key")
    documents = v.t["documents"].select("doc_id", key)
    return extraction.attach_blobs(documents, v.blobs()).select("doc_id", "sha256", "is_uploaded")


@query
def photo_pair_digest(v: Views) -> DataFrame:
    first = v.t["documents"].filter(F.col("doc_id") % 2 == 0).select(F.col("doc_id").alias("case_id"))
    key = lambda step: F.concat(F.lit("doc/"), (F.col("case_id") + step).cast("string"))
    pairs = first.select("case_id", key(0).alias("id_document_key"), key(1).alias("selfie_key"))
    return extraction.photo_pair_digest(pairs, v.blobs()).select("case_id", "input_hash")


@query
def mrz_lines(v: Views) -> DataFrame:
    return extraction.mrz_lines(v.boxes())


@query
def mrz_validate(v: Views) -> DataFrame:
    return _joined(extraction.mrz_validate(v.mrz(), AS_OF), "failed_checks")


@query
def needs_model(v: Views) -> DataFrame:
    mrz = v.mrz()
    return extraction.needs_model(mrz.select("document_id"), extraction.mrz_validate(mrz, AS_OF))


@query
def response_resolve(v: Views) -> DataFrame:
    r = extraction.response_resolve(v.attempts())
    names = ["full_name", "document_number", "date_of_birth", "expiry_date"]
    fields = [F.col(f"document.{c}").alias(c) for c in names]
    return r.select("document_id", *fields, "confidence", "needs_review", "reason")


@query
def extraction_resolve(v: Views) -> DataFrame:
    mrz = extraction.mrz_validate(v.mrz(), AS_OF)
    r = extraction.extraction_resolve(mrz, extraction.response_resolve(v.attempts()))
    fields = [F.col(f"document.{c}").alias(c) for c in ("full_name", "document_number", "date_of_birth")]
    return r.select("document_id", *fields, "confidence", "method", "needs_review", "reason", "model_version")


@query
def face_match(v: Views) -> DataFrame:
    return _rounded(extraction.face_match(v.face_pairs(), v.faces()), "similarity_score")


# Screening


def _queries(v: Views) -> DataFrame:
    return screening.with_codes(v.subjects())


@query
def vector_screen(v: Views) -> DataFrame:
    hits = screening.vector_screen(v.subjects(), v.watchlist(), threshold=VECTOR_THRESHOLD)
    return _rounded(hits.select("query_id", "entry_id", "score"), "score")


@query
def phonetic_codes(v: Views) -> DataFrame:
    coded = screening.with_codes(v.part_names())
    return coded.select("query_id", "name", F.array_join("phonetic_codes", ",").alias("codes"))


@query
def phonetic_screen(v: Views) -> DataFrame:
    entries = screening.with_codes(mutations.watchlist_ingest(v.list_entries()))
    hits = screening.phonetic_screen(screening.with_codes(v.part_names()), entries)
    return hits.select("query_id", "entry_id")


def _screened(v: Views) -> DataFrame:
    watchlist = screening.with_codes(v.watchlist())
    return screening.screen_names(_queries(v), watchlist, threshold=VECTOR_THRESHOLD)


@query
def screen_names(v: Views) -> DataFrame:
    return _rounded(_screened(v), "match_score")


@query
def screen_summary(v: Views) -> DataFrame:
    return _rounded(screening.screen_summary(v.subjects(), _screened(v)), "highest_score")


@query
def embed_names(v: Views) -> DataFrame:
    """A trigram counter stands in for the hosted model: any callable can be plugged in."""

    def make_client():
        def embed(name: str) -> list[float]:
            vector = [0.0] * 16
            for i in range(len(name) - 2):
                vector[sum(name[i : i + 3].encode()) % 16] += 1.0
            length = sum(x * x for x in vector) ** 0.5 or 1.0
            return [x / length for x in vector]

        return embed

    embedded = screening.embed_names(v.part_names(), make_client)
    norm = F.round(F.sqrt(dot(F.col("vector"), F.col("vector"))), 5)
    return embedded.select("query_id", "name", F.size("vector").alias("dimension"), norm.alias("norm"))


# Risk and decisions


@query
def risk_assessment(v: Views) -> DataFrame:
    scored = decisions.risk_assessment(v.evidence())
    return scored.select("case_id", "evidence_id", "created_at", "risk_score", "needs_review", "risk_reason")


def _evidence_tables(v: Views) -> list[DataFrame]:
    """Document keys, steps, and the newest evidence of each kind, one row per case."""
    latest = review.latest_evidence(v.evidence())
    unsure = F.col("confidence") < 0.905
    issue = "exhausted 3 retries; last issue: no document visible"
    extractions = latest.select(
        "case_id",
        F.when(unsure, F.lit(0.0)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("l_linestatus") == "O", F.lit("mrz")).otherwise(F.lit("vlm")).alias("method"),
        unsure.alias("needs_review"),
        F.when(unsure, F.lit(issue)).alias("reason"),
    )
    faces = latest.select("case_id", F.col("face").alias("similarity_score"))
    screens = latest.select("case_id", F.col("hits").alias("hit_count"))
    return [review.document_keys(v.documents()), v.steps(), extractions, faces, screens]


def decided_cases(v: Views) -> DataFrame:
    """The whole decision path over all cases: newest evidence of each kind, then the cascade."""
    return decisions.case_decisions(v.cases(), *_evidence_tables(v))


@query
def case_decisions(v: Views) -> DataFrame:
    return decided_cases(v)


@query
def review_resolution(v: Views) -> DataFrame:
    return decisions.review_resolution(decided_cases(v), v.decisions())


# Audit


@query
def audit_events(v: Views) -> DataFrame:
    tiers = v.tenants().select("tenant_id", "plan_tier")
    created = v.cases().join(tiers, "tenant_id").select(
        "tenant_id",
        "case_id",
        "subject_name",
        "plan_tier",
        "created_at",
        (F.col("case_id") % 1500).alias("api_key_id"),
        (F.col("case_id") % 3 == 1).alias("is_replay"),
    )
    recorded = v.decisions().drop("tenant_id").join(v.cases().select("case_id", "tenant_id"), "case_id")
    return audit.audit_events(v.steps(), created, recorded)


@query
def step_payloads(v: Views) -> DataFrame:
    key = F.col("case_id")
    results = {
        "doc_types": F.array_compact(
            F.array(F.when(key % 40 != 3, F.lit("selfie")), F.when(key % 50 != 7, F.lit("id_document")))
        ),
        "method": F.when(key % 2 == 0, F.lit("mrz")).otherwise(F.lit("vlm")),
        "confidence": (key % 101) / 100,
        "needs_review": key % 3 == 0,
        "reason": F.when(key % 3 == 0, F.lit('score "low"')),
        "similarity_score": F.when(key % 83 != 0, (key % 1001) / 1000),
        "hit_count": key % 4,
        "highest_score": F.when(key % 4 != 0, (key % 97) / 100),
        "delivered_count": key % 3,
        "failed_count": key % 2,
        "webhook_count": key % 3 + key % 2,
    }
    facts = v.cases().select("case_id", "status", "decision", "risk_score")
    done = v.steps().filter(F.col("outcome") == "completed").select("case_id", "step").join(facts, "case_id")
    return audit.step_payloads(done.withColumns(results)).select("case_id", "step", "payload")


@query
def audit_log(v: Views) -> DataFrame:
    """Events to chain to verdict: what a tenant's log looks like once all its events are linked."""
    log = audit.build_audit_chain(audit.assign_ids(audit_events(v)).drop("seq"))
    path = scratch_path(v.spark, "audit-log")
    audit.append_audit(log, path, dealt=True)
    stored = v.spark.read.schema(log.schema).parquet(path)
    report = audit.audit_chain_report(audit.verify_audit_chain(stored))
    last = stored.groupBy("tenant_id").agg(F.max("id").alias("last_id"))
    return report.join(last, "tenant_id").select("tenant_id", "n", "n_broken", "status", "last_id")


@query
def build_audit_chain(v: Views) -> DataFrame:
    return audit.build_audit_chain(v.audit()).select("id", "tenant_id", "prev_row_hash", "row_hash")


def _tampered(v: Views) -> DataFrame:
    """The chain after somebody changed some payloads, erased some hashes and removed some rows."""
    payload = F.when(F.col("id") % 500 == 3, F.lit("{}")).otherwise(F.col("payload"))
    kept_hash = F.when(F.col("id") % 500 != 7, F.col("row_hash"))
    chain = audit.build_audit_chain(v.audit()).withColumns({"payload": payload, "row_hash": kept_hash})
    return chain.filter(F.col("id") % 700 != 5)


@query
def verify_audit_chain(v: Views) -> DataFrame:
    return _joined(audit.verify_audit_chain(_tampered(v)), "violations")


@query
def audit_chain_report(v: Views) -> DataFrame:
    return audit.audit_chain_report(audit.verify_audit_chain(_tampered(v)))


@query
def orphan_steps(v: Views) -> DataFrame:
    return audit.orphan_steps(v.step_audit())


@query
def step_durations(v: Views) -> DataFrame:
    return _rounded(audit.step_durations(v.step_audit()), "seconds")


# Streams: each runs over everything there is and is read back


def _case_changes(v: Views) -> DataFrame:
    """Status changes and claims of all tenants as they come in."""
    events = table_stream(v.spark, v.t.folder, "events")
    claimed = F.col("event_type") == "click"
    return events.select(
        F.col("event_id").alias("seq"),
        (F.col("user_id") % 25).alias("tenant_id"),
        F.col("event_id").alias("case_id"),
        F.when(claimed, F.lit("needs_review")).otherwise(F.col("event_type")).alias("status"),
        F.lit(None).cast("string").alias("decision"),
        F.when(claimed, F.col("user_id")).alias("claimed_by_reviewer_id"),
    )


@query
def stream_case_events(v: Views) -> DataFrame:
    """Changes are stored and published; the channel is read by all tenants. Some texts are cut off on the way."""
    channel = operators.event_channel(v.spark, operators.run_case_changes(_case_changes(v)))
    text = F.col("value")
    cut = F.when(F.col("seq") % 13 == 0, F.substring(text, 1, 30)).otherwise(text)
    return run_to_files(operators.stream_case_events(channel.select("seq", cut.alias("value"))), "case-events")


@query
def stream_quota(v: Views) -> DataFrame:
    events = table_stream(v.spark, v.t.folder, "events")
    requests = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("request_id"), "ts")
    return run_to_files(operators.stream_quota(requests, limit=2, window_s=DAY_S), "quota")


@query
def stream_audit_chain(v: Views) -> DataFrame:
    stream = v.audit_of(table_stream(v.spark, v.t.folder, "events"))
    return operators.run_audit_chain(stream).select("id", "tenant_id", "prev_row_hash", "row_hash")


@query
def stream_ingest(v: Views) -> DataFrame:
    requests = v.cases_of(table_stream(v.spark, v.t.folder, "orders"))
    return run_to_files(operators.stream_ingest(requests), "ingest")


@query
def stream_status_counts(v: Views) -> DataFrame:
    stream = v.mutations_of(table_stream(v.spark, v.t.folder, "events"))
    return operators.run_status_counts(stream.filter(F.col("status").isNotNull()))


@query
def stream_case_lifecycle(v: Views) -> DataFrame:
    """All evidence and decisions as events. They come in two batches: decisions in their order, and every eighth
    case's evidence partly before and partly after its first decisions."""
    log = lifecycle.lifecycle_log(v.cases(), *_evidence_tables(v), v.decisions())
    path = scratch_path(v.spark, "lifecycle-log")
    decided = F.col("kind") == "decision"
    middle = v.decisions().agg(F.max("decision_id") / 2).first()[0] or 0
    torn = (F.col("case_id") % 8 == 0) & (F.xxhash64("case_id", "kind") % 2 == 0)
    late = F.when(decided, F.col("seq") > middle).otherwise(torn)
    # Both parts are cut from one stored table, so that the evidence is joined once.
    whole = scratch_path(v.spark, "lifecycle-events")
    log.write.parquet(whole)
    log = v.spark.read.schema(log.schema).parquet(whole)
    for part in (log.filter(~late), log.filter(late)):
        part.repartition(4).write.mode("append").parquet(path)
    transitions = run_to_files(lifecycle.stream_case_lifecycle(file_stream(log, path, 4)), "lifecycle")
    # A decision may follow the parking with the same number: the later of the two is the final one.
    rank = F.struct("seq", F.col("status") != "needs_review")
    return transitions.groupBy("case_id").agg(F.max_by("status", rank).alias("final_status"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: fn(Views(configure(spark), folder))

    return {name: bind(fn) for name, fn in REGISTRY.items()}
