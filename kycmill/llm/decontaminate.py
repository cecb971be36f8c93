"""Benchmark passages in documents: q-gram lemma filter, then banded alignment.

Texts are compared in lower case, with every run of characters that are neither letters, marks nor digits as one
blank. A leak is any stretch of ``SEGMENT`` characters of a benchmark item, wherever it starts (a shorter
item is one stretch), with at most ``EDIT_RATE`` edits. A stretch of m characters with at most e edits shares
at least m - q + 1 - q e of its q-grams with the document, on diagonals at most e apart. The q-grams an item
shares with a document are gathered in overlapping bands of diagonals; a stretch that reaches the bound
within a band is aligned with the document in that band, which decides.

The index of the benchmark has a fixed bound: a larger benchmark is dealt into several indexes, and the
documents pass through one after another; between two of them they are written to the shared folder, so a task
holds one index. Documents are never shuffled. A text is read in pieces that overlap by more than a stretch, and
a piece with very many shared q-grams (a page of one letter) is cut further and taken some items at a time, so
that no more than about ``PAIRS`` shared places are held at once.

Defined cases: null text counts as empty; items under ``Q`` characters are not searched; repeated rows and
items get the same answer; an empty benchmark or table finds nothing; other columns do not matter.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import short_batches, small, stored
from .hashing import U

Q = 12
SEGMENT, STRIDE = 100, 50
#: Edits allowed per character of a segment.
EDIT_RATE = 0.05
#: Half the width of a band of diagonals; more than the edits of a segment.
BAND = 16
#: Stretches aligned at a time.
GROUP = 128
#: Characters of the benchmark in one index.
INDEX_CHARS = 4_000_000
#: Characters of a text read at a time, characters by which pieces overlap, shared places held at a time.
PIECE, OVERLAP, PAIRS = 1 << 20, 2 * SEGMENT + 4 * BAND, 1 << 20
#: Longer items are indexed in parts of so many characters.
PART = 4096
_BLANK = 0
_BITS = 22

LEAKS = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("n_edits", T.IntegerType()),
            T.StructField("first", T.LongType()),
            T.StructField("past", T.LongType()),
        ]
    )
)


@functools.cache
def _separates() -> np.ndarray:
    """For every code point whether it is neither letter, mark nor digit."""
    return np.array([unicodedata.category(chr(c))[0] not in "LMN" for c in range(0x110000)])


def normalised(text: str, after_blank: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the compared characters (0: blank), and where in ``text`` each stands."""
    lower = text.lower()
    if len(lower) != len(text):  # a few characters grow in lower case; these stay as they are
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    points = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = _separates()[points]
    kept = np.flatnonzero(~(blank & np.r_[after_blank, blank[:-1]]))
    return np.where(blank, _BLANK, points).astype(np.int32)[kept], kept


def grams(code: np.ndarray) -> np.ndarray:
    """A number for the q-gram that starts at each place: five bits of every character."""
    if len(code) < Q:
        return np.zeros(0, U)
    five = (code & 31).astype(U)
    two = (five[:-1] << U(5)) | five[1:]
    four = (two[:-2] << U(10)) | two[2:]
    eight = (four[:-4] << U(20)) | four[4:]
    return (eight[:-4] << U(20)) | four[8:]


def _limits(chars: int) -> tuple[int, int, int]:
    """Length of the stretches of an item, the edits they may have, and the q-grams they must share."""
    size = min(chars, SEGMENT)
    edits = min(int(size * EDIT_RATE), (size - Q) // Q)
    return size, edits, size - Q + 1 - Q * edits


def _parts(code: np.ndarray) -> Iterator[np.ndarray]:
    """A long item in parts; every stretch lies in one of them."""
    for start in range(0, max(1, len(code) - SEGMENT + 1), PART - SEGMENT + 1):
        yield code[start : start + PART]


class Segment(NamedTuple):
    item_id: int
    code: np.ndarray
    n_edits: int
    bound: int


def _item_code(text: str) -> np.ndarray:
    code = normalised(text)[0]
    return code[:-1] if len(code) and code[-1] == _BLANK else code


def segments(item_id: int, text: str, stride: int = STRIDE) -> Iterator[Segment]:
    """Stretches of an item at every ``stride``-th place and at its end; a stride of 1 gives all there are."""
    code = _item_code(text)
    if len(code) < Q:
        return
    size, edits, bound = _limits(len(code))
    for start in sorted({*range(0, len(code) - size + 1, stride), len(code) - size}):
        yield Segment(item_id, code[start : start + size], edits, bound)


class Index:
    """q-grams of some items, with a table that rules out most q-grams of a text."""

    def __init__(self, items: Iterable[tuple[int, str]]):
        coded = [(item_id, part) for item_id, text in items for part in _parts(_item_code(text))]
        self.items = [(item_id, code) for item_id, code in coded if len(code) >= Q]
        found = [grams(code) for _, code in self.items]
        every = np.concatenate([np.zeros(0, U), *found])
        which = np.repeat(np.arange(len(found)), [len(g) for g in found])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in found)])
        order = np.argsort(every, kind="stable")
        self.which, self.place = which[order], place[order]
        self.grams, self.first = np.unique(every[order], return_index=True)
        self.past = np.r_[self.first[1:], len(every)]
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self._slot(self.grams)] = True
        limits = np.array([_limits(len(code)) for _, code in self.items], np.int64).reshape(-1, 3)
        self.size, self.edits, self.bound = limits.T
        self.chars = np.array([len(code) for _, code in self.items], np.int64)

    @staticmethod
    def _slot(gram: np.ndarray) -> np.ndarray:
        return (gram * U(0x9E3779B97F4A7C15)) >> U(64 - _BITS)

    def regions(self, code: np.ndarray, done: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Item, lowest diagonal of a band, and the stretches that share enough q-grams with the text in it.

        ``done`` flags items that are not looked for any more; the caller may set flags between results.
        """
        if not len(self.grams):
            return
        gram = grams(code)
        at = np.flatnonzero(self.maybe[self._slot(gram)])
        slot = np.searchsorted(self.grams, gram[at])
        slot[slot == len(self.grams)] = 0
        real = self.grams[slot] == gram[at]
        at, slot = at[real], slot[real]
        upto = np.cumsum(self.past[slot] - self.first[slot])
        first = 0
        while first < len(at):
            before = int(upto[first - 1]) if first else 0
            past = int(np.searchsorted(upto, before + PAIRS, "right"))
            past = min(len(at), max(past, int(np.searchsorted(at, at[first] + 2 * OVERLAP))))
            yield from self._found(at[first:past], slot[first:past], len(code), done)
            if past == len(at):
                return
            first = int(np.searchsorted(at, at[past] - OVERLAP))

    def _shared(self, at: np.ndarray, slot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Place in the text, item and place in the item of the shared q-grams, some at a time."""
        n = self.past[slot] - self.first[slot]
        upto = np.cumsum(n)
        for total in range(0, int(upto[-1]), PAIRS):
            some = slice(*np.searchsorted(upto, (total, total + PAIRS), "right"))
            m = n[some]
            entry = np.repeat(self.first[slot[some]] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
            yield np.repeat(at[some], m), self.which[entry], self.place[entry]

    def _found(self, at: np.ndarray, slot: np.ndarray, chars: int, done: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        if not len(at):
            return
        share = np.zeros(len(self.items), np.int64)
        parts = self._shared(at, slot)
        if (self.past[slot] - self.first[slot]).sum() <= PAIRS:
            parts = list(parts)
        else:
            for _, which, _ in parts:
                share += np.bincount(which, minlength=len(share))
            parts = None
        # Items are taken together up to the bound; each item's places are needed at once.
        group = np.cumsum(share) // PAIRS
        for g in np.unique(group):
            mine = (group == g) & ~done
            some = [tuple(x[mine[p[1]]] for x in p) for p in (parts or self._shared(at, slot))]
            spots, which, place = (np.concatenate(x) for x in zip(*some))
            if len(spots):
                yield from self._bands(spots, which, place, chars)

    def _bands(self, spots: np.ndarray, which: np.ndarray, place: np.ndarray, chars: int) -> Iterator[tuple[int, int, np.ndarray]]:
        longest = (int(self.chars.max()) // BAND + 1) * BAND
        band = (spots - place + longest) // BAND
        wide = (chars + longest) // BAND + 2  # more than any band number
        # A band is two steps wide: what lies in step b belongs to the bands b and b - 1.
        key = which * wide + band + 1
        keys, counts = np.unique(key, return_counts=True)
        near = np.r_[counts, 0][np.where(np.isin(keys + 1, keys), np.searchsorted(keys, keys + 1), len(keys))]
        back = np.r_[counts, 0][np.where(np.isin(keys - 1, keys), np.searchsorted(keys, keys - 1), len(keys))]
        full = counts + np.maximum(near, back) >= self.bound[keys // wide]
        kept = full[np.searchsorted(keys, key)]
        if not kept.any():
            return
        key, place = np.r_[key[kept], key[kept] - 1], np.r_[place[kept], place[kept]]
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (place[1:] != place[:-1])]
        key, place = key[new], place[new]
        item = key // wide
        # ``bound`` q-grams from each on, if one stretch holds them all.
        last = np.arange(len(key)) + self.bound[item] - 1
        inside = last < len(key)
        last[~inside] = 0
        inside &= (key[last] == key) & (place[last] - place <= self.size[item] - Q)
        low = np.maximum(place[last] - (self.size[item] - Q), 0)
        high = np.minimum(place, self.chars[item] - self.size[item])
        inside &= low <= high
        hits = np.flatnonzero(inside)
        for group in np.split(hits, np.flatnonzero(np.diff(key[hits])) + 1):
            if len(group):
                n = int(item[group[0]])
                edge = np.zeros(self.chars[n] + 2, np.int64)
                np.add.at(edge, low[group], 1)
                np.add.at(edge, high[group] + 1, -1)
                yield n, int(key[group[0]] % wide - 1) * BAND - longest, np.flatnonzero(np.cumsum(edge) > 0)


def align(parts: np.ndarray, code: np.ndarray, diagonals: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits and end of the best place in ``code`` for each of the parts (rows of equal length).

    A part starts within the band from its own diagonal. Only cells whose diagonal is at most ``most``
    outside the band are computed.
    """
    size = parts.shape[1]
    width = 2 * BAND + 2 * most
    step = np.arange(width, dtype=np.int32)
    low = diagonals - most
    cell = low[:, None] + np.arange(size + width)
    known = (cell >= 0) & (cell < len(code))
    padded = np.where(known, code[np.clip(cell, 0, len(code) - 1)], -1)
    start = low[:, None] + step
    costs = np.where((start >= 0) & (start <= len(code)), 0, size + 1).astype(np.int32)
    outside = np.full((len(parts), 1), size + 1, np.int32)
    for i in range(size):
        change = costs + (padded[:, i : i + width] != parts[:, i : i + 1])
        drop = np.concatenate([costs[:, 1:], outside], axis=1) + 1
        best = np.minimum(change, drop)
        costs = np.minimum.accumulate(best - step, axis=1) + step
    least = costs.argmin(axis=1)
    return costs[np.arange(len(parts)), least], low + size + least


def leaks(text: str, index: Index) -> list[dict]:
    """Each item of the index with a stretch in the text: the fewest edits of one, and a place that has them."""
    best: dict[int, tuple[int, int, int]] = {}
    done = np.zeros(len(index.items), bool)
    code, where = np.zeros(0, np.int32), np.zeros(0, np.int64)
    for base in range(0, len(text), PIECE):
        new, place = normalised(text[base : base + PIECE], not len(code) or code[-1] == _BLANK)
        code, where = np.r_[code[-OVERLAP:], new], np.r_[where[-OVERLAP:], place + base]
        for number, diagonal, starts in index.regions(code, done):
            item_id, item = index.items[number]
            size, most = int(index.size[number]), int(index.edits[number])
            for first in range(0, len(starts), GROUP):
                if best.get(item_id, (1,))[0] == 0:
                    done[number] = True
                    break
                some = starts[first : first + GROUP]
                edits, past = align(item[some[:, None] + np.arange(size)], code, diagonal + some, most)
                for e, end in zip(edits[edits <= most].tolist(), past[edits <= most].tolist()):
                    value = (e, int(where[max(0, end - size)]), int(where[min(end, len(where)) - 1]) + 1)
                    best[item_id] = min(best.get(item_id, value), value)
            done[number] |= best.get(item_id, (1,))[0] == 0
    return [{"item_id": i, "n_edits": e, "first": a, "past": b} for i, (e, a, b) in sorted(best.items())]


def _leak_rows(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        kind = pa.list_(
            pa.struct([("item_id", pa.int64()), ("n_edits", pa.int32()), ("first", pa.int64()), ("past", pa.int64())])
        )
        for batch in small(batches):
            row, before = batch.column("row"), batch.column("leaks").to_pylist()
            found = [
                had + leaks(value.as_py() or "", index)
                for had, value in zip(before, row.field(row.type.get_field_index(text)))
            ]
            yield pa.RecordBatch.from_arrays([row, pa.array(found, kind)], ["row", "leaks"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", index_chars: int = INDEX_CHARS) -> DataFrame:
    """All rows: ``row`` (the columns they came with) and ``leaks``, by item; empty for a clean document."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-chars // index_chars)
    rows = short_batches(docs).select(F.struct("*").alias("row"), F.array().cast(LEAKS).alias("leaks"))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, parts))))
    for part in range(parts):
        texts = dealt.filter(F.col("part") == part).select("item_id", "text").distinct().collect()
        shared = docs.sparkSession.sparkContext.broadcast(Index((r["item_id"], r["text"]) for r in texts))
        rows = rows.mapInArrow(_leak_rows(shared, text), rows.schema)
        if part + 1 < parts:
            rows = stored(rows, "decontaminate")
            shared.destroy()
    return rows


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows in which no benchmark passage was found."""
    return find_leaks(docs, benchmark, text).filter(F.size("leaks") == 0).select("row.*")
