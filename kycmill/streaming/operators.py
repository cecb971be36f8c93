"""Streaming forms of the operators: event fan-out, ingest, quota, audit chain, counts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.audit import append_log, read_log
from ..operators.mutations import case_events, without_empty_keys
from ..schemas import QUOTA_LIMIT, QUOTA_WINDOW_S
from ..session import scratch_path
from ..sources.published import names_in, publish
from .runs import run_batches, run_to_files

EVENT = "tenant_id string, case_id string, status string, decision string, claimed_by_reviewer_id string"


def stream_case_events(stream: DataFrame, tenant_id: object | None = None) -> DataFrame:
    """Events from the shared channel of JSON texts, with the text as it came; what does not parse is ignored.

    With a tenant only its events pass. Without one all do: write them to one folder per tenant.
    """
    parsed = stream.withColumn(
        "e",
        F.from_json("value", EVENT + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}),
    )
    good = parsed.filter(F.col("e._corrupt").isNull() & F.col("e.tenant_id").isNotNull())
    if tenant_id is not None:
        good = good.filter(F.col("e.tenant_id") == str(tenant_id))
    names = [c.split()[0] for c in EVENT.split(", ")]
    return good.select("seq", *(f"e.{n}" for n in names), F.col("value").alias("payload"))


def run_case_changes(
    changes: DataFrame, at: str | None = None, trigger: Mapping[str, object] | None = None
) -> str | StreamingQuery:
    """Store changes of cases and publish their events, both or neither, each batch once; see ``run_batches``.

    ``changes`` have ``tenant_id``, ``case_id``, ``seq``, ``status``, ``decision`` and whatever else is to be stored;
    changes without a status have no event. A batch is written aside and then published under its number in one
    step. A batch that is repeated after a failure is published already, or has been seen by nobody.
    """

    def each(batch: DataFrame, n: int, path: str) -> None:
        spark = batch.sparkSession
        if f"batch={n}" in names_in(spark, f"{path}/committed"):
            return
        aside = f"{path}/aside/{uuid.uuid4().hex}"
        batch.write.parquet(f"{aside}/changes")
        stored = spark.read.schema(batch.schema).parquet(f"{aside}/changes")
        events = case_events(stored.filter(F.col("status").isNotNull()))
        events.select("seq", F.col("payload").alias("value")).write.parquet(f"{aside}/events")
        publish(spark, aside, f"{path}/committed/batch={n}")

    return run_batches(changes, "case-changes", each, at=at, trigger=trigger)


def committed_changes(like: DataFrame, path: str) -> DataFrame:
    """The stored changes of ``run_case_changes``, with the columns of ``like``."""
    return like.sparkSession.read.schema(like.schema).parquet(f"{path}/committed/batch=*/changes")


def event_channel(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The events of ``run_case_changes`` as a stream, for ``stream_case_events``."""
    reader = spark.readStream.schema("seq bigint, value string").option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path}/committed/batch=*/events")


def stream_quota(
    stream: DataFrame, limit: int = QUOTA_LIMIT, window_s: int = QUOTA_WINDOW_S
) -> DataFrame:
    """Quota of ``quota_admission`` on a stream: per key, the open window and how much of it is used."""
    window = window_s * 1_000_000

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (None, 0)
        rows = pd.concat(batches).sort_values(["t", "request_id"], ignore_index=True)
        t = rows["t"].to_numpy()
        allowed, retry = np.zeros(len(t), bool), np.zeros(len(t), "int32")
        i = 0
        while i < len(t):
            if start is None or t[i] - start >= window:
                start, used = int(t[i]), 0
            j = int(np.searchsorted(t, start + window, "left"))
            ok = used + np.arange(1, j - i + 1) <= limit
            allowed[i:j] = ok
            retry[i:j] = np.where(ok, 0, (window - (t[i:j] - start)) // 1_000_000 + 1)
            used, i = min(limit, used + j - i), j
        state.update((start, used))
        yield pd.DataFrame(
            {"key": key[0], "request_id": rows["request_id"], "allowed": allowed, "retry_after": retry}
        )

    timed = stream.select("key", "request_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    key_type = timed.schema["key"].dataType.simpleString()
    id_type = timed.schema["request_id"].dataType.simpleString()
    return timed.groupBy("key").applyInPandasWithState(
        admit,
        f"key {key_type}, request_id {id_type}, allowed boolean, retry_after int",
        "start bigint, used int",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def run_audit_chain(
    stream: DataFrame, at: str | None = None, trigger: Mapping[str, object] | None = None
) -> DataFrame | StreamingQuery:
    """Link a stream of audit rows, micro-batch by micro-batch, each from the heads the log has then.

    The log below ``at`` may have other writers. A later run with the same ``at`` goes on; a batch that is repeated
    is not appended again. A lasting run (``trigger``) is returned as it runs; ``read_log`` reads what it has linked.
    """
    spark = stream.sparkSession
    out = at or scratch_path(spark, "audit-stream")

    def each(batch: DataFrame, n: int, path: str) -> None:
        append_log(batch, path, f"batch-{n}")

    done = run_batches(stream, "audit-stream", each, at=out, trigger=trigger)
    return done if trigger is not None else read_log(spark, out)


def stream_ingest(requests: DataFrame) -> DataFrame:
    """Idempotent ingest of a stream: ``(request_id, tenant_id, case_id, is_replay)``.

    State holds the case of every (tenant, key) for good, so a key is recognised however late it comes
    again, and a batch costs what the batch holds. Requests without a key (null or empty) never meet the state.
    """
    requests = without_empty_keys(requests)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values(["created_at", "case_id"])
        ids = rows["case_id"].to_numpy()
        case = state.get[0] if state.exists else ids[0].item() if hasattr(ids[0], "item") else ids[0]
        if not state.exists:
            state.update((case,))
        yield pd.DataFrame({"request_id": ids, "tenant_id": key[0], "case_id": case, "is_replay": ids != case})

    columns = ["tenant_id", "idempotency_key", "created_at", "case_id"]
    types = {f.name: f.dataType.simpleString() for f in requests.schema}
    out = f"request_id {types['case_id']}, tenant_id {types['tenant_id']}, case_id {types['case_id']}, is_replay boolean"
    keyed = (
        requests.filter(F.col("idempotency_key").isNotNull())
        .select(*columns)
        .groupBy("tenant_id", "idempotency_key")
        .applyInPandasWithState(run, out, f"case_id {types['case_id']}", "append", GroupStateTimeout.NoTimeout)
    )
    fresh = requests.filter(F.col("idempotency_key").isNull()).select(
        F.col("case_id").alias("request_id"), "tenant_id", "case_id", F.lit(False).alias("is_replay")
    )
    return keyed.unionByName(fresh)


def stream_ingest_within(requests: DataFrame, horizon: str = "7 days") -> DataFrame:
    """The cases of new requests, for streams whose state must not grow for good.

    A request is new if its (tenant, key) has not come within the horizon before it, by ``created_at``. Keys older
    than that leave the state and count as new when they come again; rows later than the horizon are dropped.
    ``stream_ingest`` keeps keys for good and also answers replays. Requests without a key are always new.
    """
    requests = without_empty_keys(requests)
    timed = requests.withColumn("created_at", F.col("created_at").cast("timestamp"))
    keyed = timed.filter(F.col("idempotency_key").isNotNull()).withWatermark("created_at", horizon)
    first = keyed.dropDuplicatesWithinWatermark(["tenant_id", "idempotency_key"])
    fresh = timed.filter(F.col("idempotency_key").isNull())
    return first.unionByName(fresh)


#: Cases are counted in so many groups, fixed for the life of a checkpoint: a call per case costs far more than the case.
BUCKETS = 1 << 15


def stream_status_changes(changes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """What each batch of ``changes(case_id, seq, status)`` does to the counts: ``(status, delta)`` rows.

    State holds the newest status of every case, in ``buckets`` groups by the hash of the id. A group gives the sum of
    what its cases did.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {c: (q, s) for c, q, s in zip(*state.get)} if state.exists else {}
        newest: dict[str | None, tuple[int, str]] = {}
        for b in batches:
            for case, seq, status in zip(b["case"], b["seq"].tolist(), b["status"]):
                if case not in newest or seq > newest[case][0]:
                    newest[case] = (seq, status)
        deltas: dict[str, int] = {}
        for case, (seq, status) in newest.items():
            old = known.get(case)
            if old is None or seq > old[0]:
                known[case] = (seq, status)
                deltas[status] = deltas.get(status, 0) + 1
                if old is not None:
                    deltas[old[1]] = deltas.get(old[1], 0) - 1
        state.update((list(known), [q for q, _ in known.values()], [s for _, s in known.values()]))
        moved = [(s, n) for s, n in deltas.items() if n]
        if moved:
            yield pd.DataFrame(moved, columns=["status", "delta"])

    # Ids as texts and numbers without nulls: pandas would make floats of numbers with a null among them.
    rows = changes.select(
        F.pmod(F.xxhash64("case_id"), F.lit(buckets)).alias("bucket"),
        F.col("case_id").cast("string").alias("case"),
        F.coalesce(F.col("seq").cast("bigint"), F.lit(-(1 << 63))).alias("seq"),
        "status",
    )
    return rows.groupBy("bucket").applyInPandasWithState(
        run,
        "status string, delta bigint",
        "cases array<string>, seqs array<bigint>, statuses array<string>",
        "append",
        GroupStateTimeout.NoTimeout,
    )


#: Sums of so many batches are put together in one folder.
COMPACTED = 64


def run_status_counts(
    changes: DataFrame, at: str | None = None, trigger: Mapping[str, object] | None = None
) -> DataFrame | StreamingQuery:
    """Cases per status, kept current: every batch adds a handful of sums, and their total is the count.

    Each ``COMPACTED`` batches the total so far is written as one, so what is read stays small however long the
    stream runs. ``at`` and ``trigger`` as in ``run_audit_chain``; ``read_status_counts`` reads the counts.
    """
    spark = changes.sparkSession
    out = at or scratch_path(spark, "status-stream")

    def each(batch: DataFrame, n: int, path: str) -> None:
        sums = batch.groupBy("status").agg(F.sum("delta").alias("delta"))
        sums.write.mode("overwrite").parquet(f"{path}/sums/batch={n}")
        if n % COMPACTED == COMPACTED - 1:
            total = _sums(batch.sparkSession, path, n)
            total.groupBy("status").agg(F.sum("delta").alias("delta")).coalesce(1).write.mode("overwrite").parquet(
                f"{path}/totals/batch={n}"
            )

    done = run_batches(stream_status_changes(changes), "status-stream", each, at=out, trigger=trigger)
    return done if trigger is not None else read_status_counts(spark, out)


def _sums(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The newest total before batch ``upto`` and the sums of the batches after it."""

    def numbers(kind: str) -> list[int]:
        return sorted(int(x.split("=")[1]) for x in names_in(spark, f"{path}/{kind}") if x.startswith("batch="))

    total = [n for n in numbers("totals") if upto is None or n < upto][-1:]
    rest = [n for n in numbers("sums") if n > (total[0] if total else -1) and (upto is None or n <= upto)]
    folders = [f"{path}/totals/batch={n}" for n in total] + [f"{path}/sums/batch={n}" for n in rest]
    if not folders:
        return spark.createDataFrame([], "status string, delta bigint")
    return spark.read.schema("status string, delta bigint").parquet(*folders)


def read_status_counts(spark: SparkSession, path: str) -> DataFrame:
    counts = _sums(spark, path).groupBy("status").agg(F.sum("delta").alias("n"))
    return counts.filter(F.col("n") > 0)


__all__ = [
    "committed_changes",
    "event_channel",
    "read_status_counts",
    "run_case_changes",
    "run_audit_chain",
    "run_status_counts",
    "run_to_files",
    "stream_ingest_within",
    "stream_case_events",
    "stream_ingest",
    "stream_quota",
    "stream_status_changes",
]
