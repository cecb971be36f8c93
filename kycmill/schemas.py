"""Value domains and nested shapes of the case data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Legal values of the status-like columns.
CASE_STATUSES = ("pending", "processing", "needs_review", "approved", "rejected")
CASE_DECISIONS = ("approved", "rejected")
REVIEW_DECISIONS = ("approved", "rejected", "escalated")
HIT_METHODS = ("vector", "phonetic")
REVIEWER_ROLES = ("reviewer", "admin", "auditor")
PLAN_TIERS = ("standard", "pro", "enterprise")
TENANT_STATUSES = ("active", "suspended")
DELIVERY_STATUSES = ("pending", "delivered", "failed")
DOC_TYPES = ("id_document", "selfie")
CONTENT_TYPES = ("application/pdf", "image/jpeg", "image/png")
STEPS = (
    "fetch_case_documents",
    "extract_document",
    "face_match",
    "sanctions_screen",
    "update_case_status",
    "risk_score",
    "finalize_case",
    "deliver_webhooks",
)
MRZ_MODEL = "mrz-icao9303"
FACE_MODEL = "insightface-buffalo_l"
WORKER_ACTOR = "system:pipeline-worker"

# Limits and weights.
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
VECTOR_LIMIT, VECTOR_THRESHOLD, PHONETIC_LIMIT = 5, 0.55, 10
FACE_WEIGHT, CONFIDENCE_WEIGHT, CLEAR_THRESHOLD = 0.6, 0.4, 0.85
MODEL_ATTEMPTS = DELIVERY_ATTEMPTS = 3
QUOTA_LIMIT, QUOTA_WINDOW_S = 60, 60

# Texts that appear in results.
NO_DOCUMENTS = "failed to fetch case documents"
NO_ID_DOCUMENT = "no id_document found for case"
NO_EXTRACTION = "extraction failed or timed out"
NO_SELFIE = "no selfie found for case"
NO_FACE_MATCH = "face match activity failed"
NO_SCREENING = "sanctions screening activity failed"
LIST_HIT = "sanctions list hit"
NO_FACE_TO_COMPARE = "no face detected for comparison"
BELOW_THRESHOLD = "combined confidence %.4f below auto-clear threshold {threshold}"
NO_FACE_IN_IMAGE = "no face detected in image"
NO_FACE_SHOWN = "No face detected in one or both images"
RETRIES_EXHAUSTED = "exhausted {attempts} retries; last issue: "
BAD_CONTENT_TYPE = "content_type must be one of [{allowed}]"
BAD_SIZE = "size_bytes must be positive"
SIZE_LIMIT = "size_bytes exceeds the {limit}-byte limit"
CASE_CREATED = "case created"

DOCUMENT = T.StructType(
    [
        T.StructField("full_name", T.StringType()),
        T.StructField("document_number", T.StringType()),
        T.StructField("date_of_birth", T.StringType()),
        T.StructField("expiry_date", T.StringType()),
        T.StructField("nationality", T.StringType()),
        T.StructField("document_type", T.StringType()),
    ]
)

#: ``document_visible`` is read as text: several spellings of a truth value are accepted.
MODEL_RESPONSE = T.StructType(
    [
        T.StructField("document_visible", T.StringType()),
        T.StructField("document", DOCUMENT),
        T.StructField("_corrupt", T.StringType()),
    ]
)

#: Allowed values per (table, column), used for quarantine.
DOMAINS = {
    "tenants": {"plan_tier": PLAN_TIERS, "status": TENANT_STATUSES},
    "cases": {"status": CASE_STATUSES, "decision": CASE_DECISIONS},
    "reviewers": {"role": REVIEWER_ROLES},
    "review_decisions": {"decision": REVIEW_DECISIONS},
    "sanctions_hits": {"method": HIT_METHODS},
    "webhook_deliveries": {"status": DELIVERY_STATUSES},
}
