"""Case lists, review queue, case detail and dashboard figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import latest_per, top_per
from ..schemas import CASE_CREATED, CASE_STATUSES, DOC_TYPES, MRZ_MODEL, NO_FACE_SHOWN
from .rules import tenant_scope


def list_cases(
    cases: DataFrame, tenant_id: object, status: str | None = None, limit: int = 200
) -> DataFrame:
    """The tenant's newest cases, of one status or of all."""
    rows = tenant_scope(cases, tenant_id)
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), F.desc("case_id")).limit(limit)


def review_queue(cases: DataFrame, tenant_id: object) -> DataFrame:
    waiting = tenant_scope(cases, tenant_id).filter(F.col("status") == "needs_review")
    return waiting.orderBy("created_at", "case_id")


def admin_listing(df: DataFrame, tenant_id: object, key: str) -> DataFrame:
    return tenant_scope(df, tenant_id).orderBy(F.desc("created_at"), F.desc(key))


def latest_evidence(evidence: DataFrame) -> DataFrame:
    """Newest evidence row per case. The id only breaks ties: ids are random, not ordered in time."""
    return latest_per(evidence, ["case_id"], ["created_at", "evidence_id"])


def risk_band(score: Column) -> Column:
    return (
        F.when(score.isNull(), F.lit("unscored"))
        .when(score <= 0.15, F.lit("low"))
        .when(score <= 0.5, F.lit("medium"))
        .otherwise(F.lit("high"))
    )


def risk_bands(cases: DataFrame) -> DataFrame:
    return cases.withColumn("band", risk_band(F.col("risk_score")))


def extraction_method(model_version: Column) -> Column:
    return F.when(model_version == MRZ_MODEL, F.lit("mrz")).otherwise(F.lit("vlm"))


def json_fields(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Fields of a JSON text column; an empty object gives nulls."""
    parsed = df.withColumn("__json", F.from_json(F.col(column), schema))
    return parsed.select(*df.columns, "__json.*")


def doc_types(documents: DataFrame) -> DataFrame:
    """Sorted distinct types of a case's documents, whatever they are."""
    return documents.groupBy("case_id").agg(F.array_sort(F.collect_set("doc_type")).alias("doc_types"))


def document_keys(documents: DataFrame) -> DataFrame:
    """One row per case with the object key of each document type; the last upload wins."""
    order = F.struct("uploaded_at", "document_id")

    def last(column: str, doc_type: str):
        return F.max_by(column, F.when(F.col("doc_type") == doc_type, order))

    keys = [last("s3_key", t).alias(f"{t}_key") for t in DOC_TYPES]
    ids = [last("document_id", t).alias(f"{t}_id") for t in DOC_TYPES]
    return documents.groupBy("case_id").agg(*keys, *ids)


_RAW_JSON = (
    "full_name string, date_of_birth string, document_number string, nationality string, "
    "expiry_date string"
)


HIT_FIELDS = ("list_source", "matched_name", "match_score", "method")
_HITS = "array<struct<list_source:string,matched_name:string,match_score:double,method:string>>"


def case_detail(
    cases: DataFrame,
    documents: DataFrame,
    extractions: DataFrame,
    face_matches: DataFrame,
    hits: DataFrame,
) -> DataFrame:
    """One row per case with its documents, newest extraction and face match, and its hits as an array.

    Every child is reduced to one row per case before it is joined. A screening keeps a few hits per name,
    so a case's array is short (``[]`` without hits); ``case_hits`` lists them as rows.
    """
    extraction = latest_per(
        extractions,
        ["case_id"],
        ["created_at", "extraction_id"],
        ["extraction_id", "document_id", "model_version", "raw_json", "confidence", "valid"],
    ).select("*", F.lit(True).alias("has_extraction"), F.from_json("raw_json", _RAW_JSON).alias("doc"))
    face = latest_per(
        face_matches, ["case_id"], ["created_at", "face_match_id"], ["similarity_score"]
    ).withColumn("has_face_match", F.lit(True))
    hit_figures = hits.groupBy("case_id").agg(
        F.count("*").alias("hit_count"),
        F.max("match_score").alias("highest_score"),
        F.array_sort(F.collect_list(F.struct(*HIT_FIELDS))).alias("sanctions_hits"),
    )
    no_face = F.col("has_face_match") & F.col("similarity_score").isNull()
    return (
        cases.join(document_keys(documents), "case_id", "left")
        .join(extraction, "case_id", "left")
        .join(face, "case_id", "left")
        .join(hit_figures, "case_id", "left")
        .select(
            "tenant_id",
            "case_id",
            "status",
            "subject_name",
            "subject_dob",
            "decision",
            "created_at",
            "risk_score",
            "id_document_key",
            "selfie_key",
            "extraction_id",
            "document_id",
            F.when(F.col("has_extraction"), extraction_method(F.col("model_version"))).alias("method"),
            "confidence",
            "valid",
            "doc.full_name",
            "doc.date_of_birth",
            "doc.document_number",
            "doc.nationality",
            "doc.expiry_date",
            F.coalesce("has_face_match", F.lit(False)).alias("has_face_match"),
            "similarity_score",
            F.when(no_face, F.lit(NO_FACE_SHOWN)).alias("face_reason"),
            F.coalesce("hit_count", F.lit(0)).cast("bigint").alias("hit_count"),
            "highest_score",
            F.coalesce("sanctions_hits", F.array().cast(_HITS)).alias("sanctions_hits"),
        )
    )


def case_hits(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """The hit rows of the given cases, one row per hit."""
    return hits.join(cases.select("tenant_id", "case_id"), "case_id").select(
        "tenant_id", "case_id", "list_source", "matched_name", "match_score", "method"
    )


def nest_hits(detail: DataFrame, hits: DataFrame) -> DataFrame:
    """Detail rows with their hits as an array, ``[]`` when there are none.

    For the page of cases a reviewer has open: give it the detail of selected cases.
    """
    item = F.struct(*HIT_FIELDS)
    arrays = (
        hits.join(detail.select("case_id"), "case_id", "left_semi")
        .groupBy("case_id")
        .agg(F.array_sort(F.collect_list(item)).alias("sanctions_hits"))
    )
    return detail.join(arrays, "case_id", "left").withColumn(
        "sanctions_hits", F.coalesce("sanctions_hits", F.array().cast(_HITS))
    )


def status_counts(cases: DataFrame, tenants: DataFrame) -> DataFrame:
    """Cases per tenant and status, with a zero for every status that has none."""
    statuses = F.explode(F.array(*[F.lit(s) for s in CASE_STATUSES])).alias("status")
    spine = tenants.select("tenant_id", statuses)
    counts = cases.groupBy("tenant_id", "status").agg(F.count("*").alias("n"))
    return spine.join(counts, ["tenant_id", "status"], "left").select(
        "tenant_id", "status", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def overview_cards(cases: DataFrame, tenants: DataFrame) -> DataFrame:
    """The four figures of the overview and the number of statuses that occur, per tenant."""

    def total(*statuses: str):
        return F.coalesce(F.sum(F.when(F.col("status").isin(*statuses), F.col("n"))), F.lit(0))

    return (
        status_counts(cases, tenants)
        .groupBy("tenant_id")
        .agg(
            total("needs_review").cast("bigint").alias("needs_review"),
            total("processing", "pending").cast("bigint").alias("in_progress"),
            total("approved").cast("bigint").alias("approved"),
            total("rejected").cast("bigint").alias("rejected"),
            F.count_if(F.col("n") > 0).cast("bigint").alias("shown_statuses"),
        )
    )


def weekly_volume(cases: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Cases per tenant and ISO week created in the last ``days``; weeks without cases are absent."""
    since = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    recent = cases.filter(F.col("created_at") > since)
    week = F.date_trunc("week", "created_at").cast("date").alias("week")
    return recent.groupBy("tenant_id", week).agg(F.count("*").alias("n"))


def recent_activity(
    cases: DataFrame, decisions: DataFrame, reviewers: DataFrame, n: int = 10
) -> DataFrame:
    """Newest ``n`` happenings per tenant: case creations and reviewer decisions.

    Each branch is cut to ``n`` per tenant on its own, then the union once more.
    """
    newest = [F.desc("at"), F.desc("case_id"), F.desc("event")]
    created = cases.select(
        "tenant_id", "case_id", "subject_name", F.lit(CASE_CREATED).alias("event"), F.col("created_at").alias("at")
    )
    staff = reviewers.select("tenant_id", "reviewer_id", "email")
    named = cases.select("tenant_id", "case_id", "subject_name")
    decided = (
        decisions.select("case_id", "reviewer_id", "decision", "decided_at")
        .join(named, "case_id")
        .join(staff, ["tenant_id", "reviewer_id"])
        .select(
            "tenant_id",
            "case_id",
            "subject_name",
            F.concat_ws(" by ", "decision", "email").alias("event"),
            F.col("decided_at").alias("at"),
        )
    )
    both = top_per(created, ["tenant_id"], newest, n).unionByName(
        top_per(decided, ["tenant_id"], newest, n)
    )
    return top_per(both, ["tenant_id"], newest, n)


def delivery_log(deliveries: DataFrame, webhooks: DataFrame, tenant_id: object) -> DataFrame:
    """Deliveries of the tenant's webhooks, latest attempt first, never attempted last."""
    own = tenant_scope(webhooks, tenant_id).select("webhook_id")
    return deliveries.join(own, "webhook_id", "left_semi").orderBy(
        F.desc_nulls_last("last_attempted_at"), "delivery_id"
    )
