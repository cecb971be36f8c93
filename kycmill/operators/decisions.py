"""Risk score, the decision cascade over all evidence of a case, and review outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import (
    BELOW_THRESHOLD,
    CLEAR_THRESHOLD,
    CONFIDENCE_WEIGHT,
    FACE_WEIGHT,
    LIST_HIT,
    NO_DOCUMENTS,
    NO_EXTRACTION,
    NO_FACE_MATCH,
    NO_FACE_TO_COMPARE,
    NO_ID_DOCUMENT,
    NO_SCREENING,
    NO_SELFIE,
)


def risk_columns(confidence: Column, face: Column, hits: Column) -> dict[str, Column]:
    """``risk_score``, ``needs_review`` and ``risk_reason``; any hit or missing face overrules the score.

    Rounding is half-up on the decimal text, the same as rounding the binary value except on exact
    ties in the fifth decimal; scores with three decimals have none.
    """
    combined = F.lit(FACE_WEIGHT) * face + F.lit(CONFIDENCE_WEIGHT) * confidence
    below = F.format_string(BELOW_THRESHOLD.format(threshold=CLEAR_THRESHOLD), combined)
    hit, faceless = hits > 0, face.isNull()
    return {
        "risk_score": F.when(hit | faceless, F.lit(1.0)).otherwise(F.round(1.0 - combined, 4)),
        "needs_review": hit | faceless | (combined < CLEAR_THRESHOLD),
        "risk_reason": F.when(hit, F.lit(LIST_HIT))
        .when(faceless, F.lit(NO_FACE_TO_COMPARE))
        .when(combined < CLEAR_THRESHOLD, below),
    }


def risk_assessment(evidence: DataFrame) -> DataFrame:
    """Score every evidence row of ``(confidence, face, hits)``."""
    return evidence.withColumns(risk_columns(F.col("confidence"), F.col("face"), F.col("hits")))


def step_outcomes(steps: DataFrame) -> DataFrame:
    """Whether each step of a case failed for good, one row per case."""
    names = ["fetch_case_documents", "extract_document", "face_match", "sanctions_screen"]

    def failed(step: str):
        # The last attempt counts. Attempt and outcome in one number keep the aggregate hashed.
        coded = F.col("seq").cast("bigint") * 2 + F.coalesce(F.col("outcome") == "failed", F.lit(False)).cast("int")
        last = F.max(F.when(F.col("step") == step, coded))
        return (last % 2 == 1).alias(f"{step}_failed")

    return steps.groupBy("case_id").agg(*[failed(s) for s in names])


def case_decisions(
    cases: DataFrame,
    documents: DataFrame,
    steps: DataFrame,
    extractions: DataFrame,
    faces: DataFrame,
    screens: DataFrame,
) -> DataFrame:
    """Decide every case: approve it, or park it for review with the first reason that applies.

    ``documents`` and the evidence tables hold one row per case (see ``document_keys``,
    ``latest_evidence``, ``face_match``, ``screen_summary``); all joins are on ``case_id``.
    """
    joined = (
        cases.select("tenant_id", "case_id")
        .join(documents.select("case_id", "id_document_key", "selfie_key"), "case_id", "left")
        .join(step_outcomes(steps), "case_id", "left")
        .join(
            extractions.select(
                "case_id",
                "confidence",
                "method",
                F.col("needs_review").alias("extraction_review"),
                F.col("reason").alias("extraction_reason"),
            ),
            "case_id",
            "left",
        )
        .join(
            faces.select(
                "case_id", F.col("similarity_score").alias("face_score"), F.lit(True).alias("face_ran")
            ),
            "case_id",
            "left",
        )
        .join(screens.select("case_id", "hit_count"), "case_id", "left")
    )

    def failed(step: str) -> Column:
        return F.coalesce(F.col(f"{step}_failed"), F.lit(False))

    fetch_failed = failed("fetch_case_documents")
    no_id = F.col("id_document_key").isNull()
    no_extraction = failed("extract_document") | F.col("confidence").isNull()
    unsure = F.coalesce("extraction_review", F.lit(False))
    no_selfie = F.col("selfie_key").isNull()
    face_failed = failed("face_match") | F.col("face_ran").isNull()
    screen_failed = failed("sanctions_screen") | F.col("hit_count").isNull()

    # How far the case got: later evidence is reported only by cases that reached it.
    has_extraction = ~(fetch_failed | no_id | no_extraction)
    scored = has_extraction & ~unsure & ~no_selfie
    face_score = F.when(~face_failed, F.col("face_score"))
    hits = F.when(~screen_failed, F.col("hit_count"))
    risk = risk_columns(F.col("confidence"), face_score, F.coalesce(hits, F.lit(0)))
    reason = (
        F.when(fetch_failed, F.lit(NO_DOCUMENTS))
        .when(no_id, F.lit(NO_ID_DOCUMENT))
        .when(no_extraction, F.lit(NO_EXTRACTION))
        .when(unsure, F.col("extraction_reason"))
        .when(no_selfie, F.lit(NO_SELFIE))
        .when(face_failed, F.lit(NO_FACE_MATCH))
        .when(screen_failed, F.lit(NO_SCREENING))
        .otherwise(risk["risk_reason"])
    )
    parked = ~scored | face_failed | screen_failed | risk["needs_review"]
    return joined.select(
        "tenant_id",
        "case_id",
        F.when(parked, F.lit("needs_review")).otherwise(F.lit("approved")).alias("status"),
        reason.alias("reason"),
        F.when(has_extraction, F.col("confidence")).alias("confidence"),
        F.when(has_extraction, F.col("method")).alias("method"),
        F.when(scored, face_score).alias("face_match_score"),
        F.when(scored, hits).cast("bigint").alias("sanctions_hit_count"),
        F.when(scored, risk["risk_score"]).alias("risk_score"),
    )


def first_final(decisions: DataFrame) -> DataFrame:
    """First decision per case, in order of arrival, that is not an escalation.

    ``decisions`` carry the reviewer's ``tenant_id``: those of another tenant never meet the case.
    """
    arrival = F.when(F.col("decision") != "escalated", F.struct("decided_at", "decision_id"))
    chosen = F.min_by(F.struct("decision", "reviewer_id", "decided_at"), arrival)
    return decisions.groupBy("tenant_id", "case_id").agg(
        chosen.alias("final"),
        F.count_if(F.col("decision") == "escalated").cast("bigint").alias("escalations"),
    )


def review_resolution(decided: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply reviewer decisions to parked cases; a case without a final decision keeps waiting.

    Decisions that arrived before the case was parked count. Approved cases pass through unchanged.
    """
    parked = F.col("status") == "needs_review"
    joined = decided.join(first_final(decisions), ["tenant_id", "case_id"], "left")
    final = F.when(parked, F.col("final.decision"))
    return joined.select(
        "tenant_id",
        "case_id",
        F.coalesce(final, F.col("status")).alias("final_status"),
        "reason",
        "risk_score",
        F.when(parked, F.col("final.reviewer_id")).alias("reviewer_id"),
        F.when(parked, F.col("final.decided_at")).alias("decided_at"),
        F.when(parked, F.coalesce("escalations", F.lit(0))).cast("bigint").alias("escalations"),
    )
