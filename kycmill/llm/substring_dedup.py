"""Passages that repeat across documents: seeds by winnowing, extended both ways, long ones removed.

A word is removed if a run of ``LENGTH`` words that covers it also starts in a document with a smaller id.

* Seeds. The hashes of all ``SEED`` neighbouring words are winnowed over the runs of ``LENGTH`` words, so each
  run has exactly one anchor, which depends on its words alone: equal runs have equal anchors. The runs of an
  anchor lie side by side; together they reach as far to both sides as this anchor can extend a match.
* Anchors whose seed occurs in one document only are dropped. The others are joined by seed and by the hash
  of their whole reach: where the whole reach is equal, all its runs repeat, and the first document keeps
  them. No pairs are formed, so a passage in a third of all documents costs one row per document and anchor.
* Where one seed has several different reaches (the ends of a passage), only the first of each reach is
  extended run by run to both sides, and equal runs are compared by their hash.
* Runs that repeat are joined to maximal passages per document.

Defined cases: null text has no words; a null id is larger than every other and equal to itself; repeated
rows repeat nothing in a smaller document, so they stay; documents under ``LENGTH`` words lose nothing; an
empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, packed, small, stored
from .hashing import U, byte_set, run_hashes, run_sums, sliding_min, text_words, word_bounds

LENGTH = 50
SEED = 8
#: Words are what stands between these bytes: blank, and tab to carriage return.
GAP = byte_set([(0x20, 0x20), (0x09, 0x0D)])
_PLACE = U((1 << 24) - 1)
_LAST = (1 << 63) - 1


def anchors(words: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Seed hash, hash of the reach, first and last run start of every anchor of a text."""
    if len(words) < length:
        return (np.zeros(0, U),) * 2 + (np.zeros(0, np.int64),) * 2
    total = run_sums(words)
    seeds = run_hashes(total, np.arange(len(words) - seed + 1), seed)
    # The least hash and its place in one number, so that a minimum finds both; ties go to the left.
    keyed = (seeds & ~_PLACE) | (np.arange(len(seeds), dtype=U) & _PLACE)
    least = sliding_min(keyed, length - seed + 1)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    last = np.r_[first[1:] - 1, len(least) - 1]
    place = first + ((least[first] & _PLACE).astype(np.int64) - first) % (1 << 24)
    return seeds[place], run_hashes(total, first, last - first + length), first, last


def _anchor_rows(length: int, seed: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found, counts = [], []
            for text in batch.column("text"):
                found.append(anchors(text_words(text.as_py(), GAP), length, seed))
                counts.append(len(found[-1][0]))
            if not sum(counts):
                continue
            row = np.repeat(np.arange(len(counts)), counts)
            h, reach, first, last = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(row)),
                    batch.column("th").take(pa.array(row)),
                    pa.array(h.view(np.int64)),
                    pa.array(reach.view(np.int64)),
                    pa.array(first.astype(np.int32)),
                    pa.array(last.astype(np.int32)),
                ],
                ["id", "th", "h", "reach", "first", "last"],
            )

    return rows


def _run_rows(length: int):
    """The runs of the given anchors, one by one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids, th = batch.column("id").to_numpy(), batch.column("th").to_numpy()
            for i, text in enumerate(batch.column("text")):
                todo = batch.column("todo")[i].as_py()
                total = run_sums(text_words(text.as_py(), GAP))
                start = np.concatenate([np.arange(t["first"], t["last"] + 1) for t in todo])
                h = np.repeat([t["h"] for t in todo], [t["last"] - t["first"] + 1 for t in todo])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(start), ids[i])),
                        pa.array(np.full(len(start), th[i])),
                        pa.array(h),
                        pa.array(run_hashes(total, start, length).view(np.int64)),
                        pa.array(start.astype(np.int32)),
                    ],
                    ["id", "th", "h", "run", "first"],
                )

    return rows


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        out: tuple[list, ...] = ([], [], [], [])
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            data = text.as_py().encode("utf-8", "surrogatepass")
            starts, ends = word_bounds(np.frombuffer(data, np.uint8), GAP)
            gone = np.zeros(len(starts) + 1, np.int32)
            for span in spans.as_py() or ():
                gone[span["first"]] += 1
                gone[span["past"]] -= 1
            removed = np.cumsum(gone[:-1]) > 0
            edge = np.diff(np.r_[False, removed, False].astype(np.int8))
            out[0].append(len(starts))
            out[1].append(int(removed.sum()))
            out[2].append(b" ".join([data[starts[i] : ends[i]] for i in np.flatnonzero(~removed)]).decode("utf-8"))
            out[3].append([(int(a), int(b)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(out[0], pa.int64()),
                pa.array(out[1], pa.int64()),
                pa.array(out[2], pa.string()),
                pa.array(
                    [[{"first": a, "past": b} for a, b in x] for x in out[3]],
                    pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())])),
                ),
            ],
            ["doc_id", "n_words", "n_removed", "kept_text", "passages"],
        )


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``id``, ``th``, ``first``, ``past``: runs of words that repeat one of a document with a smaller id."""
    found = stored(
        docs.select("id", "th", "text").mapInArrow(
            _anchor_rows(length, seed), "id long, th long, h long, reach long, first int, last int"
        ),
        "substring-anchors",
    )
    # Aggregates are cut off before they are joined back, so that Spark can split a hot seed in the join.
    shared = checkpointed(
        found.groupBy("h")
        .agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min("reach").alias("c"), F.max("reach").alias("d"))
        .filter("a < b")
        .select("h", (F.col("c") != F.col("d")).alias("several"))
    )
    seeds = stored(found.join(shared, "h"), "substring-seeds")
    reaches = checkpointed(seeds.groupBy("h", "reach").agg(F.min("id").alias("least")))
    placed = seeds.join(reaches, ["h", "reach"])
    whole = placed.filter("id > least").select("id", "th", "first", (F.col("last") + length).alias("past"))
    todo = (
        placed.filter("id = least AND several")
        .groupBy("id", "th")
        .agg(F.collect_list(F.struct("h", "first", "last")).alias("todo"))
    )
    runs = stored(
        docs.select("id", "th", "text")
        .join(todo, ["id", "th"])
        .mapInArrow(_run_rows(length), "id long, th long, h long, run long, first int"),
        "substring-runs",
    )
    least = checkpointed(
        runs.groupBy("h", "run").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    )
    single = (
        runs.join(least, ["h", "run"])
        .filter("id > least")
        .select("id", "th", "first", (F.col("first") + length).alias("past"))
    )
    return whole.unionByName(single)


def drop_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` (words joined by a blank) and removed ``passages``."""
    texts = packed(docs, key).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("th")
    )
    spans = (
        repeated_spans(texts, length, seed)
        .groupBy("id", "th")
        .agg(F.collect_set(F.struct("first", "past")).alias("spans"))
    )
    return (
        texts.join(spans, ["id", "th"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(
            _kept_rows,
            "doc_id long, n_words long, n_removed long, kept_text string, "
            "passages array<struct<first:int,past:int>>",
        )
    )
