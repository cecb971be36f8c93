"""Repeated runs of lines: fingerprints by winnowing, extended both ways, later repeats deleted.

A line is deleted if a run of lines with at least ``CHARS`` characters that covers it also stands at an earlier
place: in a document with a smaller id, or further up in the same one. Blank lines are passed over and stay. It is
enough to look at windows, the runs that have ``CHARS`` characters but not without their first or without their
last line: they cover every line of every longer run. A line of ``CHARS`` characters is a window by itself.

Every window has exactly one fingerprint, the least line hash in it, so equal windows have equal fingerprints.
The windows of a fingerprint lie side by side and reach as far up and down as it can extend a match. Positions
are joined by fingerprint and by the hash of the whole reach: where that is equal, all windows of the reach
repeat, and the first position keeps them. Where a fingerprint has several reaches, only the first position of
each is compared window by window. No pairs of positions are formed.

Defined cases: null text counts as empty; lines end at a line feed and are compared as they are; a line of
blanks and tabs alone is blank; a null id is larger than every other; of rows equal in id and text one is the
earliest and the others repeat it; rows equal in id only are ordered by a hash of their text; an empty table
gives an empty table; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, packed, small, stored
from .hashing import U, run_hashes, run_sums, word_hashes

CHARS = 20
_BLANK = b" \t\r\x0b\x0c"
_LAST = (1 << 63) - 1
_PLACE = U((1 << 24) - 1)


def _lines(text: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All lines, the numbers of those that are not blank, and how many characters those have."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    filled = np.array([i for i, line in enumerate(lines) if line.strip(_BLANK)], np.int64)
    chars = lines if text.isascii() else text.split("\n")
    return lines, filled, np.array([len(chars[i]) for i in filled], np.int64)


def _line_hashes(lines: list[bytes], filled: np.ndarray) -> np.ndarray:
    data = b"".join(lines[i] for i in filled)
    ends = np.cumsum([len(lines[i]) for i in filled], dtype=np.int64)
    return word_hashes(np.frombuffer(data, np.uint8), np.r_[0, ends[:-1]][: len(ends)], ends)


def _windows(sizes: np.ndarray, chars: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line (among those that are not blank) of the windows, in order."""
    size = np.cumsum(sizes)
    before, line = np.r_[0, size[:-1]][: len(size)], np.arange(len(size))
    down, up = np.searchsorted(size, before + chars, "left"), np.searchsorted(before, size - chars, "right") - 1
    pairs = np.r_[(line * len(size) + down)[down < len(size)], (up * len(size) + line)[up >= 0]]
    return np.divmod(np.unique(pairs), max(1, len(size)))


def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The minimum from each first to its last: two overlapping stretches of a power of two."""
    level = np.log2(last - first + 1).astype(np.int64)
    out, table = np.empty(len(first), values.dtype), values
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[first[at]], table[last[at] - (1 << k) + 1])
        table = np.minimum(table[: -(1 << k)], table[1 << k :]) if len(table) > 1 << k else table
    return out


def fingerprints(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Line hash, hash of the reach, first and last window of every fingerprint of a text."""
    if not len(ends):
        return (np.zeros(0, U),) * 2 + (np.zeros(0, np.int64),) * 2
    # The least hash and its place in one number, so that a minimum finds both; ties go to the upper line.
    keyed = (hashes & ~_PLACE) | (np.arange(len(hashes), dtype=U) & _PLACE)
    least = _range_min(keyed, starts, ends)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    last = np.r_[first[1:] - 1, len(least) - 1]
    top = starts[first]
    place = top + ((least[first] & _PLACE).astype(np.int64) - top) % (1 << 24)
    return hashes[place], run_hashes(run_sums(hashes), top, ends[last] - top + 1), first, last


def _fingerprint_rows(chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for k, text in enumerate(batch.column("text")):
                lines, filled, sizes = _lines(text.as_py())
                hashes, (starts, ends) = _line_hashes(lines, filled), _windows(sizes, chars)
                every = run_hashes(run_sums(hashes), starts, ends - starts + 1)
                for h, reach, first, last in zip(*fingerprints(hashes, starts, ends)):
                    runs = every[first : last + 1]
                    for column, value in zip(out, (k, h.view(np.int64), reach.view(np.int64), first, runs.view(np.int64))):
                        column.append(value)
            take = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(take),
                    batch.column("th").take(take),
                    pa.array(out[1], pa.int64()),
                    pa.array(out[2], pa.int64()),
                    pa.array(out[3], pa.int32()),
                    pa.array(out[4], pa.list_(pa.int64())),
                ],
                ["id", "th", "h", "reach", "first", "runs"],
            )

    return rows


def _kept_rows(chars: int):
    def kept(text: str, firsts: list[int] | None) -> tuple[int, int, str]:
        lines, filled, sizes = _lines(text)
        (starts, ends), gone = _windows(sizes, chars), np.zeros(len(lines), bool)
        for n in range(len(ends)) if firsts is None else firsts:
            gone[filled[starts[n] : ends[n] + 1]] = True
        left = b"\n".join(line for line, g in zip(lines, gone) if not g)
        return len(lines), int(gone.sum()), left.decode("utf-8")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text", "firsts", "copies")]
            for doc_id, text, firsts, copies in zip(*columns):
                # Rows equal in id and text: one keeps what is new in it, all windows of the others repeat.
                for n, some in ((1, firsts or []), (copies - 1, None)):
                    if not n:
                        continue
                    result = (text.count("\n") + 1, 0, text) if some == [] else kept(text, some)
                    for done in range(0, n, 1024):
                        m = min(1024, n - done)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([doc_id] * m, pa.int64()),
                                pa.array([result[0]] * m, pa.int64()),
                                pa.array([result[1]] * m, pa.int64()),
                                pa.array([result[2]] * m, pa.string()),
                            ],
                            ["doc_id", "n_lines", "n_removed", "kept_text"],
                        )

    return rows


def repeated_runs(docs: DataFrame, chars: int = CHARS) -> DataFrame:
    """``id``, ``th``, ``first``: the windows, by their number in the text, that repeat."""
    found = stored(
        docs.select("id", "th", "text").mapInArrow(
            _fingerprint_rows(chars), "id long, th long, h long, reach long, first int, runs array<long>"
        ),
        "line-fingerprints",
    )
    place = F.struct("id", "th", "first")
    shared = checkpointed(
        found.groupBy("h")
        .agg(F.min(place).alias("a"), F.max(place).alias("b"), F.min("reach").alias("c"), F.max("reach").alias("d"))
        .filter("a < b")
        .select("h", (F.col("c") != F.col("d")).alias("several"))
    )
    seeds = stored(found.join(shared, "h"), "line-seeds")
    reaches = checkpointed(seeds.groupBy("h", "reach").agg(F.min(place).alias("earliest")))
    placed = seeds.join(reaches, ["h", "reach"]).withColumn("later", place > F.col("earliest"))
    runs = placed.select("id", "th", "h", "several", "later", F.posexplode("runs").alias("i", "run"), "first").withColumn(
        "first", F.col("first") + F.col("i")
    )
    whole = runs.filter("later").select("id", "th", "first")
    rest = stored(runs.filter("several AND NOT later").select("id", "th", "h", "run", "first"), "line-runs")
    least = checkpointed(
        rest.groupBy("h", "run").agg(F.min(place).alias("earliest"), F.max(place).alias("latest")).filter("earliest < latest")
    )
    single = rest.join(least, ["h", "run"]).filter(place > F.col("earliest")).select("id", "th", "first")
    return whole.unionByName(single)


def drop_repeated_lines(docs: DataFrame, chars: int = CHARS, key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_removed``, ``kept_text``."""
    texts = packed(docs, key).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("th")
    )
    gone = repeated_runs(texts, chars).groupBy("id", "th").agg(F.collect_set("first").alias("firsts"))
    whole = texts.groupBy("id", "th").agg(
        F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), F.count("*").alias("copies")
    )
    return (
        whole.join(gone, ["id", "th"], "left")
        .select("doc_id", "text", "firsts", "copies")
        .mapInArrow(_kept_rows(chars), "doc_id long, n_lines long, n_removed long, kept_text string")
    )
