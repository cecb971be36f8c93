"""Licence phrases, notices and texts in documents, by diagonal voting.

Every rolling word k-gram of a document is joined by hash with the positions of the same k-gram in the templates, a
fixed list that is broadcast; the join also compares the words themselves. A match votes for the diagonal (position
in the document minus position in the template), and votes are counted by diagonal.

Base phrases: a phrase counts where one diagonal has all its k-grams, so all its words stand one after the other.

Notices and licence texts: one is found where at most ``1 - COVER`` of its words are left out, changed, or have up to
``NEIGHBOUR`` words put in before them. Each edit takes at most k of its k-grams and moves the diagonal by at most
``NEIGHBOUR``. So diagonals that lie near each other are merged, those with too few votes for that many edits are
let go, and only the spans that are left are verified by an alignment of words.

Texts are told apart by their SHA-256: copies vote for one text, and what is found holds for all of them.

Defined cases: null text counts as empty and has no words; rows are judged one by one, so repeated rows and
null ids do not matter; an empty table gives an empty table; other columns do not matter. Input is read twice (once
for the k-grams, once for the texts that have spans to verify), so it must give the same texts each time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import packed, small, stored
from .license_texts import LICENCES, NOTICES

#: Words per k-gram at most; shorter where a template's edits could leave no k-gram of this size.
GRAM = 3
#: Words put in at one place that count as one edit, and share of a template's words a finding needs unedited.
NEIGHBOUR, COVER = 3, 0.8
#: Texts whose findings a task remembers, for their copies.
REMEMBERED = 4096

#: Base phrases.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAPS, _LOWER = re.compile(GAPS), str.maketrans(UPPER, LOWER)
#: One edit, in costs that hold edits in the high part and the place where an alignment starts in the low one.
_UNIT = np.int64(1) << 32


def words_of(text: str) -> list[str]:
    return [w for w in _GAPS.split(text.translate(_LOWER)) if w]


class Template(NamedTuple):
    number: int
    label: str
    words: tuple[str, ...]
    base: bool

    @property
    def most(self) -> int:
        """Edits that a finding may have."""
        return 0 if self.base else int(len(self.words) * (1 - COVER) + 1e-9)

    def left(self, gram: int) -> int:
        """k-grams of this size that stay whatever the edits are."""
        return len(self.words) - gram + 1 - gram * self.most

    @property
    def gram(self) -> int:
        return next(g for g in range(min(GRAM, len(self.words)), 0, -1) if self.left(g) > 0)

    @property
    def n_grams(self) -> int:
        return len(self.words) - self.gram + 1

    @property
    def step(self) -> int:
        """How far apart the diagonals of one finding can lie."""
        return NEIGHBOUR * self.most


def templates(
    base: Sequence[tuple[str, str]] = BASE, notices: Sequence[tuple[str, str]] = NOTICES + LICENCES
) -> list[Template]:
    every = [(label, text, True) for label, text in base] + [(label, text, False) for label, text in notices]
    split = [(label, tuple(words_of(text)), is_base) for label, text, is_base in every]
    return [Template(i, label, words, is_base) for i, (label, words, is_base) in enumerate(split) if words]


def text_digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(text, 256))


def _gram_hash(gram: int) -> Column:
    words = [F.col(f"w{i}") for i in range(gram)]
    return F.when(words[-1].isNotNull(), F.xxhash64(*words))


def _positions(spark: SparkSession, known: list[Template], gram: int) -> DataFrame:
    """Hash, words, and all ``(template, at)`` of every k-gram of this size in the templates; one row per k-gram."""
    rows = [
        (t.number, i, *t.words[i : i + gram]) for t in known if t.gram == gram for i in range(t.n_grams)
    ]
    names = [f"w{i}" for i in range(gram)]
    made = spark.createDataFrame(rows, "template int, at int, " + ", ".join(f"{n} string" for n in names))
    grouped = made.groupBy(*names).agg(F.collect_list(F.struct("template", "at")).alias(f"hits{gram}"))
    return grouped.withColumn("key", _gram_hash(gram)).select(
        F.col("key").alias(f"key{gram}"), f"hits{gram}", *(F.col(n).alias(f"t{gram}_{n}") for n in names)
    )


def license_hits(docs: DataFrame, known: list[Template]) -> DataFrame:
    """``doc_id``, ``digest``, ``n_words``, ``at``, ``hits``: k-grams that templates have, and the first of each row.

    ``docs`` has ``doc_id`` and ``text``. The row at the first word (or without a place, if there is no word) is
    there for every document, so these rows are the documents.
    """
    words = F.filter(F.split(F.translate("text", UPPER, LOWER), GAPS), lambda w: w != "")
    rows = docs.select("doc_id", text_digest().alias("digest"), words.alias("words"))
    n = F.size("words")
    shifted = [F.slice("words", i + 1, F.greatest(n, F.lit(1))).alias(f"w{i}") for i in range(GRAM)]
    grams = rows.select("doc_id", "digest", n.alias("n_words"), F.arrays_zip(*shifted).alias("grams"))
    exploded = grams.select("doc_id", "digest", "n_words", F.posexplode_outer("grams").alias("at", "gram")).select(
        "doc_id", "digest", "n_words", "at", "gram.*"
    )
    sizes = sorted({t.gram for t in known})
    for size in sizes:
        exploded = exploded.withColumn(f"own{size}", _gram_hash(size))
        same = F.col(f"own{size}") == F.col(f"key{size}")
        for i in range(size):
            same = same & (F.col(f"w{i}") == F.col(f"t{size}_w{i}"))
        exploded = exploded.join(F.broadcast(_positions(docs.sparkSession, known, size)), same, "left")
    none = F.array().cast("array<struct<template:int,at:int>>")
    wanted = F.coalesce(F.col("at"), F.lit(0)) == 0
    for size in sizes:
        wanted = wanted | F.col(f"hits{size}").isNotNull()
    hits = F.concat(none, *(F.coalesce(F.col(f"hits{size}"), none) for size in sizes))
    return exploded.filter(wanted).select("doc_id", "digest", "n_words", "at", hits.alias("hits"))


def vote(found: DataFrame) -> DataFrame:
    """``digest``, ``template``, ``diagonal``, ``n_places``: different k-grams of the template on this diagonal.

    A set of places holds no more than the template has k-grams.
    """
    votes = found.select("digest", "at", F.explode("hits").alias("hit")).select(
        "digest", "hit.template", F.col("hit.at").alias("place"), (F.col("at") - F.col("hit.at")).alias("diagonal")
    )
    counted = votes.groupBy("digest", "template", "diagonal").agg(F.collect_set("place").alias("places"))
    return counted.select("digest", "template", "diagonal", F.size("places").alias("n_places"))


def candidate_spans(diagonals: DataFrame) -> DataFrame:
    """``digest``, ``spans``: stretches of words that may hold a template, from merged neighbouring diagonals.

    ``diagonals`` has the template's ``step``, ``needed`` votes and ``n_words_own`` beside the votes. The list of a text is bounded
    by its own words.
    """
    order = Window.partitionBy("digest", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > F.col("step")
    chained = diagonals.withColumn("begins", F.coalesce(apart, F.lit(True)).cast("int"))
    chained = chained.withColumn("chain", F.sum("begins").over(order))
    merged = chained.groupBy("digest", "template", "chain", "step", "needed", "n_words_own").agg(
        F.min("diagonal").alias("least"), F.max("diagonal").alias("most"), F.sum("n_places").alias("votes")
    )
    low = F.greatest(F.lit(0), F.col("least") - F.col("step")).cast("int")
    high = (F.col("most") + F.col("n_words_own") + F.col("step")).cast("int")
    spans = merged.filter("votes >= needed").select("digest", F.struct("template", low.alias("low"), high.alias("high")).alias("span"))
    return spans.groupBy("digest").agg(F.collect_list("span").alias("spans"))


def _put_in(costs: np.ndarray) -> np.ndarray:
    """Costs once words may be put in before the next one: every ``NEIGHBOUR`` of them, or fewer, are one edit."""
    n = len(costs)
    rows = -(-n // NEIGHBOUR)
    lanes = np.full(rows * NEIGHBOUR, _UNIT << 29)
    lanes[:n] = costs
    rise = _UNIT * np.arange(rows)[:, None]
    whole = (np.minimum.accumulate(lanes.reshape(rows, NEIGHBOUR) - rise, axis=0) + rise).ravel()[:n]
    best = whole.copy()
    for back in range(1, NEIGHBOUR):
        best[back:] = np.minimum(best[back:], whole[:-back] + _UNIT)
    return best


def word_places(own: np.ndarray, code: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """First and past-last word, and edits, of the best place in every stretch where ``own`` has few edits."""
    # The start is in the low part, so that of equal edits the shortest place wins.
    costs = _UNIT - 1 - np.arange(len(code) + 1, dtype=np.int64)
    for i, word in enumerate(own):
        best = costs + _UNIT
        best[1:] = np.minimum(best[1:], costs[:-1] + _UNIT * (code != word))
        costs = _put_in(best) if i + 1 < len(own) else best
    edits = costs // _UNIT
    ends = np.flatnonzero(edits <= most)
    out = []
    for group in np.split(ends, np.flatnonzero(np.diff(ends) > 1) + 1):
        if len(group):
            end = int(group[edits[group].argmin()])
            out.append((int(_UNIT - 1 - costs[end] % _UNIT), end, int(edits[end])))
    return out


class Aligner:
    """Verifies spans of texts against the templates, as numbers of words."""

    def __init__(self, known: Sequence[Template]):
        self.known = {t.number: t for t in known}
        self.number = {w: i for i, w in enumerate(sorted({w for t in known for w in t.words}), 1)}
        self.coded = {t.number: np.array([self.number[w] for w in t.words], np.int64) for t in known}

    def find(self, text: str, spans: Sequence[dict]) -> list[tuple[int, int, int, float]]:
        """Template, first and past-last word, and share of unedited words, of all findings in the spans."""
        code = np.array([self.number.get(w, 0) for w in words_of(text)], np.int64)
        out = []
        for span in spans:
            own, low = self.coded[span["template"]], span["low"]
            for a, b, edits in word_places(own, code[low : span["high"]], self.known[span["template"]].most):
                out.append((span["template"], low + a, low + b, 1 - edits / len(own)))
        return out


FOUND = "digest binary, template int, first int, past int, cover double"


def _verified_rows(known: list[Template]):
    kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    names = ("digest", "template", "first", "past", "cover")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, remembered = Aligner(known), set()
        for batch in small(batches):
            out = []
            for digest, text, spans in zip(*(batch.column(c) for c in ("digest", "text", "spans"))):
                key = digest.as_py()
                if key in remembered:
                    continue
                if len(remembered) >= REMEMBERED:
                    remembered.clear()
                remembered.add(key)
                out += [(key, *x) for x in aligner.find(text.as_py(), spans.as_py())]
            columns = zip(*out) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return rows


def verify(texts: DataFrame, spans: DataFrame, known: list[Template]) -> DataFrame:
    """``digest``, ``template``, ``first``, ``past``, ``cover`` of what the alignment finds inside the spans."""
    found = texts.join(spans, "digest").select("digest", "text", "spans").mapInArrow(_verified_rows(known), FOUND)
    return found.groupBy("digest", "template", "first", "past").agg(F.max("cover").alias("cover"))


def scan_licenses(docs: DataFrame, key: str = "doc_id", known: list[Template] | None = None) -> DataFrame:
    """One row per document: counts, places and labels of base phrases, all ``findings``, ``labels``, ``score``."""
    known = known or templates()
    spark = docs.sparkSession
    texts = packed(docs, key).select("doc_id", "text")
    found = stored(license_hits(texts, known), "license-hits")
    facts = F.broadcast(
        spark.createDataFrame(
            [(t.number, t.label, t.base, t.n_grams, t.left(t.gram), t.step, len(t.words)) for t in known],
            "template int, label string, base boolean, n_grams int, needed int, step int, n_words_own int",
        )
    )
    diagonals = stored(vote(found).join(facts, "template"), "license-votes")
    # Spans and judgements are cut off before they are joined back, so that Spark can split a text with many copies.
    spans = stored(candidate_spans(diagonals.filter("NOT base")), "license-spans")
    notices = verify(texts.select(text_digest().alias("digest"), "text"), spans, known).join(facts, "template")
    base = diagonals.filter("base AND n_places = n_grams").select(
        "digest", "label", "base", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("n_words_own")).alias("past"),
        F.lit(1.0).alias("cover"),
    )
    every = base.unionByName(notices.select("digest", "label", "base", "first", "past", "cover"))
    only = F.when(F.col("base"), F.col("first"))
    judged = every.groupBy("digest").agg(
        F.count(only).alias("n_base"),
        F.min(only).cast("long").alias("first_word"),
        F.max(only).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
        F.array_sort(F.collect_list(F.struct("first", "past", "label", "cover"))).alias("findings"),
    )
    rows = found.filter("coalesce(at, 0) = 0").select("doc_id", "digest", F.col("n_words").cast("long").alias("n_words"))
    return rows.join(stored(judged, "license-judged"), "digest", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "findings",
    )
