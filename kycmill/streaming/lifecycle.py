"""The life of a case as a stream of its evidence: documents, extraction, face, screening, reviewer decisions.

Events come in any order and any number of times. ``assess`` is the decision cascade for one case; the batch form
over whole tables is ``case_decisions`` with ``review_resolution``.
"""

from __future__ import annotations

import json
import pickle
from collections import namedtuple
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.decisions import step_outcomes
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

UPLOAD_TIMEOUT_MIN, HORIZON_MIN = 20, 24 * 60
#: Columns of an event after ``case_id``; those that do not belong to its kind are null.
EVENT = (
    "seq bigint, kind string, failed boolean, id_document_key string, selfie_key string, confidence double, method string, "
    "needs_review boolean, reason string, similarity_score double, hit_count bigint, decision string, reviewer_id bigint"
)
#: Evidence by kind of event, with the columns that are kept of it.
EVIDENCE = {
    "documents": "id_document_key string, selfie_key string",
    "extraction": "confidence double, method string, needs_review boolean, reason string",
    "face": "similarity_score double",
    "screening": "hit_count bigint",
}
TRANSITION = (
    "seq bigint, status string, reason string, confidence double, method string, face_match_score double, "
    "sanctions_hit_count bigint, risk_score double, reviewer_id bigint"
)


class Assessment(NamedTuple):
    status: str
    reason: str | None = None
    confidence: float | None = None
    method: str | None = None
    face_match_score: float | None = None
    sanctions_hit_count: int | None = None
    risk_score: float | None = None


def _rounded(value: float) -> Decimal:
    return Decimal(repr(value)).quantize(Decimal("0.0001"), ROUND_HALF_UP)


def assess(documents, extraction, face, screening) -> Assessment | None:
    """What a case's evidence says, or None while it does not suffice.

    Each argument is None (not there yet) or has ``failed`` and the columns of its kind.
    """
    parked = "needs_review"
    if documents is None:
        return None
    if documents.failed:
        return Assessment(parked, NO_DOCUMENTS)
    if documents.id_document_key is None:
        return Assessment(parked, NO_ID_DOCUMENT)
    if extraction is None:
        return None
    if extraction.failed or extraction.confidence is None:
        return Assessment(parked, NO_EXTRACTION)
    read = (extraction.confidence, extraction.method)
    if extraction.needs_review:
        return Assessment(parked, extraction.reason, *read)
    if documents.selfie_key is None:
        return Assessment(parked, NO_SELFIE, *read)
    if face is None or screening is None:
        return None
    score = None if face.failed else face.similarity_score
    hits = None if screening.failed else screening.hit_count
    combined = None if score is None else FACE_WEIGHT * score + CONFIDENCE_WEIGHT * extraction.confidence
    if (hits or 0) > 0:
        risk, reason = 1.0, LIST_HIT
    elif combined is None:
        risk, reason = 1.0, NO_FACE_TO_COMPARE
    else:
        risk, reason = float(_rounded(1.0 - combined)), None
        if combined < CLEAR_THRESHOLD:
            reason = BELOW_THRESHOLD.format(threshold=CLEAR_THRESHOLD).replace("%.4f", str(_rounded(combined)))
    if face.failed:
        reason = NO_FACE_MATCH
    elif screening.failed or hits is None:
        reason = NO_SCREENING
    return Assessment(parked if reason else "approved", reason, *read, score, hits, risk)


#: Cases are kept in so many groups, fixed for the life of a checkpoint. Calls to the state cost far more than the cases.
BUCKETS = 1 << 15
_KEPT = {
    kind: namedtuple(kind, ["seq", "failed", *(c.split()[0] for c in columns.split(", "))])
    for kind, columns in EVIDENCE.items()
}
_MOVE = Row("case_id", *(c.split()[0] for c in TRANSITION.split(", ")))
_MISSING = Row("failed")(True)
_DOUBLES = {c.split()[0] for c in EVENT.split(", ") if c.endswith(" double")}

#: A group's least advanced phase, highest number of an event and next timer, and its cases, each as one value: a
#: column costs Python more than what it holds.
_STATE = "phase string, seq bigint, timer bigint, cases array<binary>"


def _packed() -> Column:
    """An event in one text, without its nulls. Doubles are texts in it, so that all of them come back as they were."""
    names = [c.split()[0] for c in EVENT.split(", ")]
    return F.to_json(F.struct(*[F.col(n).cast("string").alias(n) if n in _DOUBLES else F.col(n) for n in names]))


def _unpacked(text: str) -> dict:
    event = json.loads(text)
    for name in _DOUBLES & event.keys():
        event[name] = float(event[name])
    return event


class _Case:
    """One case: phase, highest number of an event so far, when its time is over (None: never), and what it waits with."""

    __slots__ = ("phase", "seq", "timer", "evidence", "decisions")

    def __init__(self, phase="open", seq=-1, timer=None, evidence=(), decisions=()):
        self.phase, self.seq, self.timer = phase, seq, timer
        self.evidence = dict.fromkeys(EVIDENCE)
        self.evidence.update((kind, _KEPT[kind](*row)) for kind, row in evidence)
        self.decisions = list(decisions)

    def packed(self, key) -> bytes:
        row = (key, self.phase, self.seq, self.timer)
        if self.phase == "open":
            row += ([(kind, tuple(row)) for kind, row in self.evidence.items() if row is not None], self.decisions)
        return pickle.dumps(row, pickle.HIGHEST_PROTOCOL)


class CaseLifecycle(StatefulProcessor):
    """Open, then parked or final. Final cases are remembered for a horizon, so that late events change nothing.

    A case that is settled by the events of one batch leaves nothing but its phase. Cases lie in groups by their
    hash, and a group is read and written once per batch that meets it.
    """

    def __init__(self, timeout_ms: int, horizon_ms: int):
        self.timeout_ms, self.horizon_ms = timeout_ms, horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.phase = handle.getValueState("phase", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        cases, timer = self._cases()
        came: dict = {}
        for _, case_id, text in rows:
            came.setdefault(case_id, []).append(text)
        changed = False
        for case_id, texts in came.items():
            case = cases.setdefault(case_id, _Case())
            if case.phase != "final":
                changed = True
                yield from self._advance(case_id, case, [_unpacked(t) for t in texts], now)
        if changed:
            self._keep(cases, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs())
        cases, _ = self._cases()
        for case_id, case in list(cases.items()):
            if case.timer is None or case.timer > now:
                continue
            if case.phase == "final":
                del cases[case_id]
            else:
                # What is missing once the time is over counts as failed.
                evidence = {kind: row or _MISSING for kind, row in case.evidence.items()}
                yield from self._settled(case_id, case, assess(**evidence), [], now)
        self._keep(cases, None)

    def _cases(self) -> tuple[dict, int | None]:
        known = self.phase.get()
        if known is None:
            return {}, None
        rows = (pickle.loads(case) for case in known[3])
        return {row[0]: _Case(*row[1:]) for row in rows}, known[2]

    def _keep(self, cases: dict, timer: int | None) -> None:
        """Write the group. ``timer`` is the one that runs: it may fire early, but never late."""
        if not cases:
            self.phase.clear()
            return
        due = min((c.timer for c in cases.values() if c.timer is not None), default=None)
        if due is not None and (timer is None or due < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        phases = {c.phase for c in cases.values()}
        least = next(p for p in ("open", "parked", "final") if p in phases)
        self.phase.update((least, max(c.seq for c in cases.values()), timer, [c.packed(k) for k, c in cases.items()]))

    def _advance(self, case_id, case: _Case, events: list[dict], now: int) -> Iterator[Row]:
        decided = []
        for event in events:
            seq, kind = event["seq"], event.get("kind")
            case.seq = max(case.seq, seq)
            if kind == "decision":
                decided.append((seq, event.get("decision"), event.get("reviewer_id")))
            elif kind in _KEPT and case.phase == "open":
                # Of repeated evidence the newest counts.
                old, kept = case.evidence[kind], _KEPT[kind]
                if old is None or old.seq < seq:
                    case.evidence[kind] = kept(seq, bool(event.get("failed")), *map(event.get, kept._fields[2:]))
        found = assess(**case.evidence) if case.phase == "open" else None
        if case.phase == "open" and found is None:
            case.decisions += sorted(decided)
            if case.timer is None:
                case.timer = now + self.timeout_ms
            return
        yield from self._settled(case_id, case, found, sorted(decided), now)

    def _settled(self, case_id, case: _Case, found, decided, now: int) -> Iterator[Row]:
        """An assessment, if there is one, and then the decisions in order of arrival."""
        if case.phase == "open":
            decided = [*case.decisions, *decided]
            case.evidence, case.decisions = dict.fromkeys(EVIDENCE), []
            case.phase = "parked" if found.status == "needs_review" else "final"
            yield _MOVE(case_id, case.seq, *found, None)
        for at, decision, reviewer in decided:
            # Escalations are used up; the first other decision is final.
            if case.phase == "parked" and decision != "escalated":
                case.phase = "final"
                yield _MOVE(case_id, max(case.seq, at), decision, *[None] * 6, reviewer)
        case.timer = now + self.horizon_ms if case.phase == "final" else None

    def close(self) -> None:
        pass


def stream_case_lifecycle(
    events: DataFrame,
    timeout_min: float = UPLOAD_TIMEOUT_MIN,
    horizon_min: float = HORIZON_MIN,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Transitions of every case from its events (``case_id`` and the columns of ``EVENT``).

    Kinds: ``opened``; ``documents``, ``extraction``, ``face`` and ``screening`` (``failed``: the step failed for
    good); ``decision``. A case is assessed as soon as its evidence suffices. Decisions that come early are kept.
    A case that is not assessed within the timeout is parked, and what is missing counts as failed. A final case
    leaves the state after the horizon; events that come later than that open it anew. State is kept for ``buckets``
    groups of cases, by the hash of their ids.
    """
    id_type = events.schema["case_id"].dataType.simpleString()
    bucket = F.pmod(F.xxhash64("case_id"), F.lit(buckets)).alias("__bucket")
    return events.select(bucket, "case_id", _packed().alias("__event")).groupBy("__bucket").transformWithState(
        CaseLifecycle(int(timeout_min * 60_000), int(horizon_min * 60_000)),
        f"case_id {id_type}, {TRANSITION}",
        "append",
        "processingTime",
    )


def lifecycle_log(
    cases: DataFrame,
    documents: DataFrame,
    steps: DataFrame,
    extractions: DataFrame,
    faces: DataFrame,
    screens: DataFrame,
    decisions: DataFrame,
) -> DataFrame:
    """Stored evidence and decisions as events, to replay them; inputs as for ``case_decisions``.

    A step without a result counts as failed. Decisions carry the reviewer's ``tenant_id``: those of another tenant
    are no events of the case.
    """
    names = [c.split() for c in EVENT.split(", ")]

    def event(place: int, kind: str, failed: Column, *columns: str) -> Column:
        own = {"seq": F.lit(place), "kind": F.lit(kind), "failed": F.coalesce(failed, F.lit(False)), **{c: F.col(c) for c in columns}}
        return F.struct(*[own.get(n, F.lit(None)).cast(t).alias(n) for n, t in names])

    known = (
        cases.select("case_id")
        .join(documents.select("case_id", "id_document_key", "selfie_key"), "case_id", "left")
        .join(step_outcomes(steps), "case_id", "left")
        .join(extractions.select("case_id", "confidence", "method", "needs_review", "reason"), "case_id", "left")
        .join(faces.select("case_id", "similarity_score", F.lit(True).alias("face_ran")), "case_id", "left")
        .join(screens.select("case_id", "hit_count"), "case_id", "left")
    )
    kinds = [
        event(1, "documents", F.col("fetch_case_documents_failed"), "id_document_key", "selfie_key"),
        event(
            2, "extraction", F.col("extract_document_failed") | F.col("confidence").isNull(),
            "confidence", "method", "needs_review", "reason",
        ),
        event(3, "face", F.col("face_match_failed") | F.col("face_ran").isNull(), "similarity_score"),
        event(4, "screening", F.col("sanctions_screen_failed") | F.col("hit_count").isNull(), "hit_count"),
    ]
    evidence = known.select("case_id", F.explode(F.array(*kinds)).alias("e")).select("case_id", "e.*")
    own = decisions.join(cases.select("tenant_id", "case_id"), ["tenant_id", "case_id"], "left_semi")
    decided = own.select(
        "case_id",
        event(0, "decision", F.lit(False), "decision", "reviewer_id").alias("e"),
        (F.col("decision_id") + len(kinds) + 1).alias("__seq"),
    )
    return evidence.unionByName(decided.select("case_id", "e.*", "__seq").withColumn("seq", F.col("__seq")).drop("__seq"))
