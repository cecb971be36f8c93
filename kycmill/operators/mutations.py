"""Idempotent inserts, upserts, soft deletes, claims, decisions and the current case row.

Plain files have no MERGE: each function returns the new snapshot (or the rows to append).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import entry_id, json_text, numeric_5_4, ordered_json_object
from ..functions.ordering import latest_per


def without_empty_keys(requests: DataFrame) -> DataFrame:
    """An empty idempotency key is no key."""
    return requests.withColumn("idempotency_key", F.nullif(F.col("idempotency_key"), F.lit("")))


def idempotent_ingest(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Resolve each request of ``new`` to a case: ``(request_id, tenant_id, case_id, is_replay)``.

    The first row of a (tenant, key) wins, stored rows before new ones. Requests without a key (null or
    empty) always create a case: they are not equal to each other.
    """
    columns = ["tenant_id", "idempotency_key", "created_at", "case_id"]
    new, existing = without_empty_keys(new), without_empty_keys(existing)
    keyed = new.select(*columns).filter(F.col("idempotency_key").isNotNull())
    stored = existing.select(*columns).filter(F.col("idempotency_key").isNotNull())
    # The smallest (stored first, oldest, id) per key is a partial aggregate, so a key that arrives
    # very often is one row per task before the shuffle.
    claims = stored.withColumn("late", F.lit(0)).unionByName(keyed.withColumn("late", F.lit(1)))
    winners = (
        claims.groupBy("tenant_id", "idempotency_key")
        .agg(F.min(F.struct("late", "created_at", "case_id")).alias("w"))
        .select("tenant_id", "idempotency_key", F.col("w.case_id").alias("winner"))
    )
    resolved = keyed.join(winners, ["tenant_id", "idempotency_key"])
    fresh = new.filter(F.col("idempotency_key").isNull())
    return resolved.select(
        F.col("case_id").alias("request_id"),
        "tenant_id",
        F.col("winner").alias("case_id"),
        (F.col("winner") != F.col("case_id")).alias("is_replay"),
    ).unionByName(
        fresh.select(
            F.col("case_id").alias("request_id"), "tenant_id", "case_id", F.lit(False).alias("is_replay")
        )
    )


def watchlist_ingest(entries: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Upsert list entries by deterministic id; the highest ``version`` of an id wins."""
    keyed = entries.withColumn("entry_id", entry_id(F.col("list_source"), F.col("name")))
    if current is not None:
        keyed = current.unionByName(keyed.select(*current.columns))
    return latest_per(keyed, ["entry_id"], ["version"])


def keyed_upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Insert or overwrite on a natural key; columns absent from ``changes`` keep their value.

    Of several changes to a key the last by ``order`` wins (then by the values themselves), so a key stays
    one row.
    """
    tie = [c for c in changes.columns if c not in keys and c not in order]
    changes = latest_per(changes, list(keys), [*order, *tie])
    rest = [c for c in base.columns if c not in keys]
    b = base.select(*keys, F.struct(*rest).alias("__old"))
    c = changes.select(*keys, F.struct(*[x for x in rest if x in changes.columns]).alias("__new"))
    merged = b.join(c, list(keys), "full_outer")
    values = [
        F.coalesce(F.col("__new")[x], F.col("__old")[x]).alias(x)
        if x in changes.columns
        else F.col("__old")[x].alias(x)
        for x in rest
    ]
    return merged.select(*keys, *values)


def soft_delete(df: DataFrame, changes: DataFrame, key: str, ended_at: str) -> DataFrame:
    """Set ``ended_at`` from ``changes(key, at)``; a row that already ended keeps its first time."""
    first = changes.groupBy(key).agg(F.min("at").alias("__at"))
    ended = F.coalesce(F.col(ended_at), F.col("__at"))
    return df.join(first, key, "left").withColumn(ended_at, ended).drop("__at")


def apply_claims(cases: DataFrame, claims: DataFrame) -> DataFrame:
    """Waiting cases with their latest claim. A claim is a note: it never blocks, the last one shows.

    ``claims`` carry the reviewer's ``tenant_id``; for another tenant the case does not exist.
    """
    key = ["tenant_id", "case_id"]
    last = latest_per(claims, key, ["claimed_at", "claim_id"], ["reviewer_id", "claimed_at"])
    waiting = cases.filter(F.col("status") == "needs_review").select(
        "tenant_id", "case_id", "subject_name", "created_at"
    )
    return waiting.join(last, key).withColumnRenamed("reviewer_id", "claimed_by_reviewer_id")


def decision_admission(decisions: DataFrame, cases: DataFrame) -> DataFrame:
    """Add ``outcome``: accepted while the case waits for review, conflict otherwise, or not_found.

    ``decisions`` carry the reviewer's ``tenant_id``; a case of another tenant is not found.
    """
    state = cases.select("tenant_id", "case_id", F.col("status").alias("case_status"))
    outcome = (
        F.when(F.col("case_status").isNull(), F.lit("not_found"))
        .when(F.col("case_status") == "needs_review", F.lit("accepted"))
        .otherwise(F.lit("conflict"))
    )
    return decisions.join(state, ["tenant_id", "case_id"], "left").withColumn("outcome", outcome)


def case_state(base: DataFrame, mutations: DataFrame) -> DataFrame:
    """Current case rows: per column the last value set by ``mutations(case_id, seq, ...)``."""
    fields = ["status", "risk_score", "decision", "decided_at"]

    def last_set(c: str):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"__{c}")

    last = mutations.groupBy("case_id").agg(*[last_set(c) for c in fields])
    joined = base.join(last, "case_id", "left")
    for c in fields:
        joined = joined.withColumn(c, F.coalesce(F.col(f"__{c}"), F.col(c))).drop(f"__{c}")
    return joined


def case_events(mutations: DataFrame) -> DataFrame:
    """Notification text of each committed status change, for the shared event channel.

    A change with ``claimed_by_reviewer_id`` is a claim, and says who claims.
    """
    members = [(c, json_text(F.col(c).cast("string"))) for c in ("tenant_id", "case_id", "status", "decision")]
    text = ordered_json_object(members)
    if "claimed_by_reviewer_id" in mutations.columns:
        by = F.col("claimed_by_reviewer_id").cast("string")
        claim = ordered_json_object([*members, ("claimed_by_reviewer_id", json_text(by))])
        text = F.when(by.isNull(), text).otherwise(claim)
    return mutations.withColumn("payload", text)


def evidence_rows(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Evidence rows as stored: scores as NUMERIC(5,4)."""
    return df.withColumns({c: numeric_5_4(F.col(c)) for c in scores})


def persist_evidence(df: DataFrame, path: str, scores: Sequence[str]) -> None:
    """Append evidence rows below ``path``, one folder per tenant, in few files each."""
    evidence_rows(df, scores).hint("rebalance", "tenant_id").write.mode("append").partitionBy("tenant_id").parquet(path)
