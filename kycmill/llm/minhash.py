"""Near duplicates by ProbMinHash signatures, banding and exact verification.

A document is a multiset of word shingles; the similarity is the probability Jaccard index of two multisets,
which equals the plain Jaccard index where no shingle repeats.

* Signature. Every distinct shingle is a Poisson process whose rate is its weight; each arrival falls on a
  random one of ``m`` components, and a component keeps the shingle that arrived first. A shingle stops as
  soon as its next arrival is later than the latest first arrival of all components, so a text costs about
  (shingles + m log m) arrivals. Two components agree with a probability equal to the similarity.
* Texts with the same shingles are one node from here on, so exact copies cost one row each.
* Banding. ``BANDS`` hashes of ``ROWS`` components; at the threshold a pair is missed with probability
  (1 - 0.8 ** ROWS) ** BANDS, below 3e-5.
* Verification. First one member of each bucket is compared with all others; where all of a bucket is then one
  class, it is closed. The other buckets are cut into chunks of at most about ``CHUNK`` members, and each pair
  of chunks meets in one task, where shared weights are matrix products, an upper bound of the similarity
  rules out most pairs, and the rest is compared exactly. So no link between two classes of a bucket is
  missed, and no pairs of a bucket leave a task, only links that join two classes.
* Classes are the connected components of the verified links.

Defined cases: null text counts as empty; words are runs of letters and digits in lower case; a text with
fewer words than a shingle is one shingle; a text without words is alone in its class; the smallest
``doc_id`` of a class stays (null is largest), of equal ids the text with the least hash; rows equal in both
are one document, of which ``drop_near`` keeps one row; an empty table gives an empty table; other columns do
not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, packed, small, stored
from .graph import components
from .hashing import U, byte_set, mixed, run_hashes, run_sums, text_words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
#: Members of a large bucket that stand together in a task.
CHUNK = 400
_COLUMNS = 4096
#: Everything in ASCII that is neither letter nor digit separates words.
GAP = byte_set([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def shingles(text: str, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of a text, sorted, and how often each occurs."""
    words = text_words(text.lower(), GAP)
    if not len(words):
        return np.zeros(0, U), np.zeros(0, np.int64)
    size = min(size, len(words))
    found = run_hashes(run_sums(words), np.arange(len(words) - size + 1), size)
    return np.unique(found, return_counts=True)


def signature(items: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """The item that arrives first at each of ``m`` components; needs at least one item."""
    best, winner = np.full(m, np.inf), np.zeros(m, U)
    time, number = np.zeros(len(items)), 0
    weights = weights.astype(np.float64)
    while len(items):
        step = max(1, -(-2 * m // len(items)))
        numbers = np.arange(number, number + step, dtype=U)
        draw = mixed(items[:, None] + (numbers + U(1)) * U(0x9E3779B97F4A7C15))
        gaps = -np.log(((draw >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[:, None]
        arrival = time[:, None] + np.cumsum(gaps, axis=1)
        slot = (mixed(draw ^ U(0xA0761D6478BD642F)) % U(m)).astype(np.int64).ravel()
        who, when = np.repeat(items, step), arrival.ravel()
        useful = when < best[slot]
        who, when, slot = who[useful], when[useful], slot[useful]
        order = np.lexsort((who, -when))  # the earliest is written last
        best[slot[order]], winner[slot[order]] = when[order], who[order]
        time, number = arrival[:, -1], number + step
        going = time < best.max()
        items, weights, time = items[going], weights[going], time[going]
    return winner


def band_keys(winner: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash per band, different from band to band."""
    key = mixed(np.arange(1, bands + 1, dtype=U))
    for column in winner.reshape(bands, rows).T:
        key = mixed(key * U(0xD1342543DE82EF95) + column)
    return key.view(np.int64)


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Probability Jaccard index of two weighted sets: sorted items, and their positive weights.

    For a shared item with weights x, y it adds 1 / sum over all items of max(x' / x, y' / y); which of the
    two is larger depends on how the ratio x' / y' compares with x / y, so sums in the order of that ratio
    give every term.
    """
    both, in_a, in_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = x.astype(np.float64), y.astype(np.float64)
    only_x, only_y = x.sum() - x[in_a].sum(), y.sum() - y[in_b].sum()
    x, y = x[in_a], y[in_b]
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    above = only_x + np.cumsum(x[::-1])[::-1]  # of items with a ratio at least as large
    below = only_y + np.cumsum(y) - y
    return float((1.0 / (above / x + below / y)).sum())


def _signature_rows(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            profile, keys = [], []
            for text in batch.column("text"):
                items, weights = shingles(text.as_py(), size)
                if len(items):
                    packed_items = items.tobytes() + weights.tobytes()
                    profile.append(hashlib.blake2b(packed_items, digest_size=16).digest())
                    keys.append(band_keys(signature(items, weights, bands * rows), bands, rows))
                else:
                    profile.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("th"),
                    pa.array(profile, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "th", "profile", "keys"],
            )

    return run


def _shingle_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [shingles(text.as_py(), size) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("uid"),
                    pa.array([items.tobytes() for items, _ in found], pa.binary()),
                    # Weights only where a shingle repeats.
                    pa.array([n.astype(np.int32).tobytes() if (n > 1).any() else b"" for _, n in found], pa.binary()),
                ],
                ["uid", "items", "weights"],
            )

    return run


def _unpacked(items: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(items, U)
    return found, np.frombuffer(weights, np.int32) if weights else np.ones(len(found), np.int32)


def _link_rows(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sides = [[batch.column(c) for c in (f"items_{s}", f"weights_{s}")] for s in "ab"]
            close = [
                similarity(*(part for side in sides for part in _unpacked(*(c[i].as_py() for c in side)))) >= threshold
                for i in range(batch.num_rows)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(close, pa.bool_()))

    return run


def _verified(pairs: DataFrame, profiles: DataFrame, threshold: float) -> DataFrame:
    side = {
        s: profiles.select(F.col("uid").alias(s), F.col("items").alias(f"items_{s}"), F.col("weights").alias(f"weights_{s}"))
        for s in "ab"
    }
    joined = pairs.join(side["a"], "a").join(side["b"], "b")
    return joined.mapInArrow(_link_rows(threshold), "a long, b long")


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    named = roots.withColumnRenamed("node", "uid")
    return members.join(named, "uid", "left").withColumn("root", F.coalesce("root", "uid"))


class _Chunk:
    """Documents of one side of a comparison, with the weights of their shingles by local numbers."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray, np.ndarray]], known: np.ndarray):
        self.rows = rows
        doc = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        items = np.concatenate([np.zeros(0, U), *(r[2] for r in rows)])
        weights = np.concatenate([np.zeros(0), *(r[3] for r in rows)])
        self.total = np.array([r[3].sum() for r in rows], np.float64)
        column = np.searchsorted(known, items)
        shared = (column < len(known)) & (known[np.minimum(column, max(0, len(known) - 1))] == items) if len(known) else items < 0
        order = np.argsort(column[shared], kind="stable")
        self.column, self.doc, self.weight = column[shared][order], doc[shared][order], weights[shared][order]

    def dense(self, first: int, width: int) -> np.ndarray:
        at = slice(*np.searchsorted(self.column, [first, first + width]))
        out = np.zeros((len(self.rows), width), np.float32)
        out[self.doc[at], self.column[at] - first] = self.weight[at]
        return out


def _joining_links(left: list, right: list | None, threshold: float) -> list[tuple[int, int]]:
    """Links that join two classes, between two chunks or (``right`` is None) inside one."""
    items, counts = np.unique(np.concatenate([r[2] for r in left + (right or [])]), return_counts=True)
    known = items[counts > 1]
    a = _Chunk(left, known)
    b = a if right is None else _Chunk(right, known)
    in_a, in_b = (np.zeros((len(a.rows), len(b.rows))) for _ in range(2))
    for first in range(0, len(known), _COLUMNS):
        x, y = a.dense(first, _COLUMNS), b.dense(first, _COLUMNS)
        in_a += x @ (y > 0).T.astype(np.float32)
        in_b += (x > 0).astype(np.float32) @ y.T
    # With shares p, q of the weights in common, the index is at most sqrt(p / (2 - p) * q / (2 - q)).
    p, q = in_a / a.total[:, None], in_b / b.total[None, :]
    possible = (p / (2 - p)) * (q / (2 - q)) >= threshold**2 - 1e-6
    if right is None:
        possible = np.triu(possible, 1)
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        while (up := parent.get(node, node)) != node:
            parent[node] = parent.get(up, up)
            node = up
        return node

    links = []
    for i, j in zip(*np.nonzero(possible)):
        (u, class_u, *own), (v, class_v, *other) = a.rows[i], b.rows[j]
        if root(class_u) != root(class_v) and similarity(*own, *other) >= threshold:
            parent[root(class_u)] = root(class_v)
            links.append((u, v))
    return links


def _chunk_links(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        sides: dict[int, list] = {}
        for r in group.select(["uid", "root", "chunk", "items", "weights"]).to_pylist():
            sides.setdefault(r["chunk"], []).append((r["uid"], r["root"], *_unpacked(r["items"], r["weights"])))
        lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
        links = []
        if lo == hi or len(sides) == 2:
            links = _joining_links(sides[lo], None if lo == hi else sides[hi], threshold)
        return pa.table({"a": pa.array([u for u, _ in links], pa.int64()), "b": pa.array([v for _, v in links], pa.int64())})

    return run


def _classes(members: DataFrame, profiles: DataFrame, threshold: float) -> DataFrame:
    """``node``, ``root`` over verified links of members (``key``, ``uid``) of the same bucket."""
    first = checkpointed(members.groupBy("key").agg(F.min("uid").alias("a")))
    pairs = members.join(first, "key").filter("uid <> a").select("a", F.col("uid").alias("b")).distinct()
    links = checkpointed(_verified(pairs, profiles, threshold))
    rooted = stored(_rooted(members, components(links)), "minhash-rooted")
    still = checkpointed(
        rooted.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
        .filter("low < high AND n > 2")
        .select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    )
    chunked = rooted.join(still, "key").withColumn("chunk", F.pmod(F.xxhash64("uid"), F.col("chunks")).cast("int"))
    met = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "key", "uid", "root", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi")
    )
    more = (
        met.join(profiles, "uid")
        .select("key", "lo", "hi", "uid", "root", "chunk", "items", "weights")
        .groupBy("key", "lo", "hi")
        .applyInArrow(_chunk_links(threshold), "a long, b long")
    )
    return components(checkpointed(links.unionByName(more)))


def near_classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    size: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: ``doc_id``, ``th`` (hash of the text), ``class_id``, ``class_size``, ``kept``."""
    texts = packed(docs, key, text).select("doc_id", "text", F.xxhash64("text").alias("th"))
    signed = stored(
        texts.select("doc_id", "th", "text").mapInArrow(
            _signature_rows(bands, rows, size), "doc_id long, th long, profile binary, keys array<long>"
        ),
        "minhash-signatures",
    )
    nodes = stored(
        signed.filter("profile IS NOT NULL")
        .groupBy("profile")
        .agg(F.min(F.struct("doc_id", "th", "keys")).alias("first"))
        .select(F.monotonically_increasing_id().alias("uid"), "profile", "first.*"),
        "minhash-nodes",
    )
    in_bucket = nodes.select("uid", F.explode("keys").alias("key"))
    shared = in_bucket.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members = stored(in_bucket.join(shared, "key"), "minhash-buckets")
    wanted = nodes.select("uid", "doc_id", "th").join(members.select("uid").distinct(), "uid")
    same = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["th"] == wanted["th"])
    profiles = stored(
        texts.join(wanted, same)
        .select("uid", "text")
        .mapInArrow(_shingle_rows(size), "uid long, items binary, weights binary")
        .dropDuplicates(["uid"]),
        "minhash-profiles",
    )
    roots = _classes(members, profiles, threshold)
    rooted = _rooted(nodes.select("uid", "profile"), roots)
    named = signed.select("doc_id", "th", "profile").join(rooted.select("profile", "root"), "profile", "left")
    # A text without words is a class of its own: a number that no node has.
    named = named.select("doc_id", "th", F.coalesce("root", -1 - F.monotonically_increasing_id()).alias("class"))
    named = stored(named, "minhash-classes")
    # Cut off before it is joined back, so that Spark can split a large class in the join.
    sized = checkpointed(
        named.groupBy("class").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("first"),
            F.count("*").alias("class_size"),
        )
    )
    joined = named.join(sized, "class")
    first = joined["doc_id"].eqNullSafe(F.col("first.doc_id")) & (joined["th"] == F.col("first.th"))
    return joined.select(
        "doc_id", "th", F.col("first.doc_id").alias("class_id"), "class_size", first.alias("kept")
    )


def drop_near(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with the columns the rows came with."""
    # Nulls take part in the join as they are fields of a struct. No field itself can be null, whatever the input's schema
    # says: structs that differ in that would be cast for the join, and the window would exchange whole rows once more.
    name = F.struct(
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"),
        F.coalesce("th", F.lit(0)).alias("th"),
    ).alias("name")
    winners = near_classes(docs, key, text, threshold).filter("kept").select(name).distinct()
    rows = packed(docs, key, text).withColumn("th", F.xxhash64("text")).select(name, "row")
    order = Window.partitionBy("name").orderBy("name")
    kept = rows.join(winners, "name", "left_semi").withColumn("place", F.row_number().over(order))
    return kept.filter("place = 1").select("row.*")
