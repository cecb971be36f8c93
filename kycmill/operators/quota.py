"""Request quota per key over windows that start at the first request."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..schemas import QUOTA_LIMIT, QUOTA_WINDOW_S
from ..session import scratch_path

_LONG_LIST = pa.list_(pa.int64())
#: Sub-intervals of a window: a row holds the times of one of them.
_SUBS = 4
#: Times of a span that are worked on together, if they come in several rows; pieces of a map in one row.
_TOGETHER, _PIECES = 1 << 13, 1 << 16


class _Exits:
    """Where windows leave a span, by where they enter it: a map that is extended sub-interval by sub-interval.

    ``free`` is the moment the window before ends: the first request from then on opens the next one. Entering with
    free <= upto, and above the piece before, the span is left with ``leave``. Pieces with the same leave are one.
    """

    def __init__(self, start: int, window: int):
        self.last_entry, self.window = start + window, window
        self.upto = self.leave = np.zeros(0, np.int64)

    def extend(self, times: np.ndarray) -> None:
        n = len(times)
        after = np.searchsorted(times, times + self.window, "left")
        last = np.where(after < n, after, np.arange(n))
        while True:
            further = last[last]
            if (further == last).all():
                break
            last = further
        # From a window that starts at one of the times to the end of the last that starts among them.
        ends = times[last] + self.window
        at = np.searchsorted(times, self.leave, "left")
        leave = np.where(at < n, ends[np.minimum(at, n - 1)], self.leave)
        upto = self.upto
        if not len(upto) or upto[-1] < self.last_entry:
            entries = int(np.searchsorted(times, self.last_entry, "left")) + 1
            upto, leave = np.r_[upto, times[:entries]], np.r_[leave, ends[:entries]]
        run_end = np.r_[leave[1:] != leave[:-1], True]
        self.upto, self.leave = upto[run_end], leave[run_end]


def _gathered(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Rows of one key and span after another: the values of ``names`` and its times, in parts of some size."""
    now, held, n = None, [], 0
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in names)
        for *own, times in zip(*columns, batch.column("times")):
            if now is not None and (own[:2] != now[:2] or n >= _TOGETHER):
                yield tuple(now), np.concatenate(held)
                held, n = [], 0
            now = own
            held.append(np.asarray(times.values))
            n += len(held[-1])
    if held:
        yield tuple(now), np.concatenate(held)


def _span_exits(window: int, width: int, key_type: pa.DataType):
    names = ["key", "span", "piece", "upto", "leave"]
    schema = pa.schema(list(zip(names, (key_type, pa.int64(), pa.int32(), _LONG_LIST, _LONG_LIST))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        now, exits = None, None

        def pieces() -> list[dict]:
            cuts = range(0, len(exits.upto), _PIECES)
            parts = [(exits.upto[n : n + _PIECES].tolist(), exits.leave[n : n + _PIECES].tolist()) for n in cuts]
            return [dict(zip(names, (*now, i, *p))) for i, p in enumerate(parts)]

        for own, times in _gathered(batches, "key", "span"):
            if own != now:
                if now is not None:
                    out += pieces()
                    if sum(len(r["upto"]) for r in out) >= _PIECES or len(out) >= 1024:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                now, exits = own, _Exits(own[1] * width, window)
            exits.extend(times)
        if now is not None:
            yield pa.RecordBatch.from_pylist(out + pieces(), schema)

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk spans in order and carry the moment the open window ends; of a span's pieces one is looked up."""
    key, span, free, seen, looking = None, None, None, False, False
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        columns = (batch.column(c).to_pylist() for c in ("key", "span"))
        for k, s, upto, leave in zip(*columns, batch.column("upto"), batch.column("leave")):
            if not seen or k != key:
                key, span, free, seen = k, None, None, True
            if s != span:
                span, looking = s, True
                for column, value in zip(out, (k, s, free)):
                    column.append(value)
            if looking:
                pieces = np.asarray(upto.values)
                at = 0 if free is None else int(np.searchsorted(pieces, free, "left"))
                if at < len(pieces):
                    free, looking = leave.values[at].as_py(), False
        types = (batch.schema.field("key").type, pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["key", "span", "free"])


def _anchors(window: int, key_type: pa.DataType):
    schema = pa.schema([("key", key_type), ("span", pa.int64()), ("anchors", _LONG_LIST)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        now, free = None, None
        for own, times in _gathered(batches, "key", "span", "free"):
            if own[:2] != now:
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
                now, free = own[:2], own[2]
                out.append({"key": now[0], "span": now[1], "anchors": [] if free is None else [free - window]})
            at = 0 if free is None else int(np.searchsorted(times, free, "left"))
            while at < len(times):
                out[-1]["anchors"].append(int(times[at]))
                free = int(times[at]) + window
                at = int(np.searchsorted(times, free, "left"))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _timed(requests: DataFrame, width: int) -> DataFrame:
    # Inside a struct a null key is equal to itself, so it is a key like any other.
    return (
        requests.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
        .withColumn("span", F.floor(F.col("t") / F.lit(width)))
        .withColumn("key", F.struct("key"))
        .filter(F.col("span").isNotNull())
    )


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _window_starts(timed: DataFrame, window: int, width: int, opened: DataFrame) -> DataFrame:
    """``key``, ``span``, ``anchors``: where windows start in a span, and first where the one that reaches into it does.

    Each window starts at the first request after the one before has ended, so windows of a key depend on each other
    from the first to the last. A busy key is still not one task: time is cut into spans of some windows. Every span
    works out, for all the ways it may be entered, how it is left; walking these answers in order tells how it *is*
    entered, and then all spans find their windows on their own. A span is read in sub-intervals, so that a row never
    holds more than the moments of a part of a window.
    """
    key_type, arrow_type = timed.schema["key"].dataType.simpleString(), to_arrow_type(timed.schema["key"].dataType)
    sub = F.floor((F.col("t") - F.col("span") * F.lit(width)) / F.lit(-(-window // _SUBS)))
    # A window that is open from before starts where it started: its key has no request before that.
    moments = timed.select("key", "span", "t").unionByName(
        opened.select("key", F.floor(F.col("anchor") / F.lit(width)).alias("span"), F.col("anchor").alias("t"))
    )
    # Only distinct times matter for where windows start; tasks drop repeats before the shuffle.
    times = (
        moments.groupBy("key", "span", sub.alias("sub"))
        .agg(F.sort_array(F.collect_set("t")).alias("times"))
        .repartition("key", "span")
    )
    exits = times.sortWithinPartitions("key", "span", "sub").mapInArrow(
        _span_exits(window, width, arrow_type), f"key {key_type}, span bigint, piece int, upto array<bigint>, leave array<bigint>"
    )
    entered = (
        exits.repartition("key")
        .sortWithinPartitions("key", "span", "piece")
        .mapInArrow(_entries, f"key {key_type}, span bigint, free bigint")
    )
    return (
        times.join(entered, ["key", "span"])
        .sortWithinPartitions("key", "span", "sub")
        .select("key", "span", "times", "free")
        .mapInArrow(_anchors(window, arrow_type), f"key {key_type}, span bigint, anchors array<bigint>")
    )


def admission_columns(allowed: Column, t: Column, anchor: Column, window_s: int) -> dict[str, Column]:
    """``allowed`` and ``retry_after`` (whole seconds)."""
    left = (F.lit(window_s * 1_000_000) - (t - anchor)) / F.lit(1_000_000)
    return {
        "allowed": allowed,
        "retry_after": F.when(allowed, F.lit(0)).otherwise(F.floor(left) + 1).cast("int"),
    }


def quota_run(
    requests: DataFrame,
    open_windows: DataFrame | None = None,
    limit: int = QUOTA_LIMIT,
    window_s: int = QUOTA_WINDOW_S,
    windows_per_span: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """Decide ``requests(key, request_id, ts)`` from the windows that are open, and say which are open after them.

    The first ``limit`` of a window are allowed. Requests without a key share one; a request without a time fits no
    window and is not allowed. Open windows are ``(key, anchor, used)``, one per key: where the last window starts
    (microseconds) and how many requests it has let through. Requests must not be older than those of earlier runs.
    """
    window = window_s * 1_000_000
    width = window * windows_per_span
    timed = _timed(requests, width)
    key_type = timed.schema["key"].dataType
    if open_windows is None:
        empty = f"key {key_type['key'].dataType.simpleString()}, anchor bigint, used int"
        open_windows = requests.sparkSession.createDataFrame([], empty)
    opened = open_windows.select(F.struct(F.col("key").cast(key_type["key"].dataType).alias("key")).alias("key"), "anchor", "used")

    # What is joined back is written first: a narrow table, so that Spark can split a hot window of the join.
    starts = _stored(_window_starts(timed, window, width, opened), "quota-starts")
    own = F.array_max(F.filter("anchors", lambda a: a <= F.col("t")))
    placed = timed.select("key", "span", "t", "request_id").join(starts, ["key", "span"]).withColumn("anchor", own)
    # Only the first ``limit`` of a window matter, and each task passes on no more than that many; the last of
    # those still free tells for every other request of the window whether it came too late.
    place = F.struct("t", "request_id")
    order = Window.partitionBy("key", "anchor").orderBy("t", "request_id")
    first = placed.select("key", "anchor", "t", "request_id").withColumn("rank", F.row_number().over(order))
    left = F.lit(limit) - F.coalesce("used", F.lit(0))
    ranked = first.filter(F.col("rank") <= limit).join(opened, ["key", "anchor"], "left")
    cuts = _stored(
        ranked.groupBy("key", "anchor").agg(
            F.max(F.when(F.col("rank") <= left, place)).alias("cut"),
            F.least(F.lit(limit), F.max("rank") + F.coalesce(F.max("used"), F.lit(0))).cast("int").alias("used"),
        ),
        "quota-cuts",
    )
    # A span has a bounded number of windows, so their cuts fit a row next to where they start.
    window_cut = F.struct("anchor", "cut")
    windows = _stored(
        starts.select("key", "span", F.explode("anchors").alias("anchor"))
        .join(cuts, ["key", "anchor"])
        .groupBy("key", "span")
        .agg(F.collect_list(window_cut).alias("windows")),
        "quota-windows",
    )
    mine = F.array_max(F.filter("windows", lambda w: w["anchor"] <= F.col("t")))
    decided = timed.join(windows, ["key", "span"]).withColumn("w", mine)
    allowed = F.coalesce(place <= F.col("w.cut"), F.lit(False))
    columns = ["key", "request_id", "ts", "allowed", "retry_after"]
    timely = (
        decided.withColumns(admission_columns(allowed, F.col("t"), F.col("w.anchor"), window_s))
        .withColumn("key", F.col("key.key"))
        .select(*columns)
    )
    untimed = requests.filter(F.col("ts").isNull()).withColumns(
        {"allowed": F.lit(False), "retry_after": F.lit(None).cast("int")}
    )
    after = opened.unionByName(cuts.select("key", "anchor", "used")).groupBy("key")
    still = after.agg(F.max(F.struct("anchor", "used")).alias("w")).select("key.key", "w.anchor", "w.used")
    return timely.unionByName(untimed.select(*columns)), still


def quota_admission(
    requests: DataFrame,
    limit: int = QUOTA_LIMIT,
    window_s: int = QUOTA_WINDOW_S,
    windows_per_span: int = 64,
) -> DataFrame:
    """The decisions of ``quota_run``, with no window open before."""
    return quota_run(requests, None, limit, window_s, windows_per_span)[0]
