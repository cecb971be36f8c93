"""Nearest neighbours by multi-index hashing: rotated binary codes, indexed by each of their substrings.

A code has ``BITS`` bits, the signs of a vector under rotations that are learned from a sample (iterative
quantisation: turn until the vectors lie near the corners of a cube). It is split into substrings of ``SUB`` bits,
and each block of vectors has one index per substring. A search probes the substrings one after the other, first
at distance 0, then at 1 and so on: after substring ``j`` at distance ``a`` every code within radius
``a * n_substrings + j`` has been met (were one missing, it would differ in too many bits). Codes within the
radius are scored by the cosine of the vectors themselves, in double precision. The radius grows until it covers
what a vector as near as the k-th best so far can have: the angle's share of the bits plus ``slack``, the excess
that the sample's own neighbours have. So the radius has no cap, near copies need a few probes only, and a
search with fewer than k neighbours ends with all of them.

Rows are packed in chunks and dealt to blocks of bounded size regardless of content, so copies do not gather.
Queries are packed likewise and go to every block once; a task holds one block's index, and queries pass through
it in sorted chunks. Only the k best per query and block leave a task. No pairs are joined, nothing but the
rotations is broadcast, and of the vectors only the sample reaches the driver.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components take no part, nor do
null ids; a vector meets those with as many components only; rows with a query's own id are not its candidates
(a repeated id is asked once per row); ties go to the smaller id; an empty table gives an empty table; other
columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .centroid_cluster import usable
from .common import stored

BITS, SUB = 256, 8
#: Vectors per length from which rotations and slack are learned, and how often they are turned.
SAMPLE, TURNS = 4096, 20
#: Share of the sample's neighbours whose bits the radius covers.
COVER = 0.95
#: Vectors in a chunk; bytes and rows of vectors in a block.
CHUNK, BLOCK_BYTES, BLOCK_ROWS = 128, 32 << 20, 16384
_VALUES = np.arange(1 << SUB)
#: Masks by number of set bits: what to flip in a substring to reach all values at that distance.
_FLIPS = [_VALUES[np.bitwise_count(_VALUES) == a] for a in range(SUB + 1)]
PARTS = BITS // SUB

Model = dict[int, tuple[np.ndarray, float]]


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length 1; scaled by a power of two first, so that no square is lost or overflows."""
    exponent = np.frexp(np.abs(vectors).max(1))[1]
    scaled = np.ldexp(vectors, -exponent[:, None])
    return scaled / np.sqrt((scaled * scaled).sum(1))[:, None]


def codes_of(vectors: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Packed codes, a byte per substring."""
    return np.packbits(vectors @ rotation > 0, axis=1)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(1, dtype=np.int64)


def learn_rotation(vectors: np.ndarray, k: int = 5, seed: int = 0) -> tuple[np.ndarray, float]:
    """Rotations side by side (at least ``BITS`` columns, the rest cut off) and the slack of the radius."""
    size, draw, parts = vectors.shape[1], np.random.default_rng(seed), []
    for _ in range(-(-BITS // size)):
        turn = np.linalg.qr(draw.standard_normal((size, size)))[0]
        for _ in range(TURNS):
            left, _, right = np.linalg.svd(np.sign(vectors @ turn).T @ vectors)
            turn = (left @ right).T
        parts.append(turn)
    rotation = np.concatenate(parts, axis=1)[:, :BITS]
    codes, excess = codes_of(vectors, rotation), []
    for i in range(0, len(vectors), max(1, len(vectors) // 512)):
        cosine = vectors @ vectors[i]
        cosine[i] = -2
        near = np.argpartition(cosine, -min(k, len(cosine)))[-k:]
        near = near[cosine[near] > -2]
        excess.append(distances(codes[near], codes[i]) - expected(cosine[near]))
    flat = np.concatenate(excess) if excess else np.zeros(0)
    return rotation, max(0.0, float(np.quantile(flat, COVER))) if len(flat) else 0.0


def expected(cosine):
    """Bits in which two codes differ on average, from the cosine of their vectors."""
    return np.arccos(np.clip(cosine, -1, 1)) * (BITS / np.pi)


class Block:
    """A block's vectors, and for each substring its rows sorted by the substring's value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, slack: float):
        self.ids, self.vectors, self.codes, self.slack = ids, vectors, codes, slack
        self.order = np.argsort(codes, axis=0, kind="stable").T.astype(np.int32).copy()
        self.first = np.stack([np.searchsorted(np.sort(c), np.arange((1 << SUB) + 1)) for c in codes.T])
        self.seen = np.zeros(len(ids), bool)

    def probe(self, part: int, value: int, away: int) -> np.ndarray:
        """Rows whose substring ``part`` differs from ``value`` in exactly ``away`` bits."""
        buckets = _FLIPS[away] ^ value
        start, count = self.first[part, buckets], self.first[part, buckets + 1] - self.first[part, buckets]
        jump = np.repeat(start - np.cumsum(count) + count, count)
        return self.order[part][jump + np.arange(len(jump))]

    def search(self, own: int, vector: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k best within the radius that the k-th best asks for."""
        self.seen[:] = self.ids == own
        waiting = far = np.empty(0, np.int64)
        rows, scores = np.empty(0, np.int64), np.empty(0)
        for step in range(PARTS * (SUB + 1)):
            away, part = divmod(step, PARTS)
            met = self.probe(part, int(code[part]), away)
            met = met[~self.seen[met]]
            self.seen[met] = True
            if len(met):
                waiting, far = np.append(waiting, met), np.append(far, distances(self.codes[met], code))
            if step % 8 != 7:
                continue
            ready = far <= step
            if ready.any():
                new = waiting[ready]
                waiting, far = waiting[~ready], far[~ready]
                rows, scores = np.append(rows, new), np.append(scores, self.vectors[new].astype(np.float64) @ vector)
                keep = np.lexsort((self.ids[rows], -scores))[:k]
                rows, scores = rows[keep], scores[keep]
            if len(rows) == k and step >= expected(scores[-1]) + self.slack:
                break
            if not len(waiting) and self.seen.all():
                break
        return self.ids[rows], scores


def _valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    at = F.col(vector)
    some = usable(at) & F.coalesce(F.exists(at, lambda x: x != 0), F.lit(False)) & F.col(key).isNotNull()
    return vectors.filter(some).select(
        F.col(key).cast("long").alias("vec_id"), at.cast("array<double>").alias("v"), F.size(at).alias("size")
    )


def _sample(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """About ``SAMPLE`` different vectors of each length, those whose contents hash lowest."""
    hashed = rows.withColumn("h", F.xxhash64("vec_id", "v"))
    share = F.create_map(*[F.lit(x) for n in counts for x in (n, min(1.0, SAMPLE / counts[n]))])
    lowest = hashed.filter(F.col("h") / float(1 << 63) <= share[F.col("size")] * 2 - 1)
    return lowest.groupBy("size", "h").agg(F.first("v").alias("v"))


def learn(rows: DataFrame, counts: dict[int, int]) -> Model:
    """The rotations and slack of each length, learned in tasks from the samples."""

    def fit(table: pa.Table) -> pa.Table:
        size = table.column("size")[0].as_py()
        order = np.argsort(table.column("h").to_numpy(), kind="stable")
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        rotation, slack = learn_rotation(unit_rows(flat.reshape(-1, size)[order]))
        return pa.table({"size": pa.array([size], pa.int32()), "rotation": [rotation.tobytes()], "slack": [slack]})

    found = _sample(rows, counts).groupBy("size").applyInArrow(fit, "size int, rotation binary, slack double")
    return {r.size: (np.frombuffer(r.rotation).reshape(r.size, -1), r.slack) for r in found.collect()}


PACKED = "size int, query boolean, n int, ids binary, vectors binary, codes binary"


def _packed(rows: DataFrame, model: Model, every: int) -> DataFrame:
    """Chunks of unit vectors with their codes; the queries among them once more, in chunks of their own."""

    def chunk(size: int, query: bool, ids: np.ndarray, units: np.ndarray) -> dict:
        codes = codes_of(units, model[size][0])
        return {"size": size, "query": query, "n": len(ids), "ids": ids.tobytes(), "vectors": units.tobytes(), "codes": codes.tobytes()}

    schema = pa.schema(
        [("size", pa.int32()), ("query", pa.bool_()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("codes", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}

        def taken(full: bool) -> list[dict]:
            out = []
            for (size, query), parts in held.items():
                n = sum(len(i) for i, _ in parts)
                if n >= CHUNK or (n and not full):
                    ids, units = (np.concatenate(p) for p in zip(*parts))
                    last = n - n % CHUNK if full else n
                    out += [chunk(size, query, ids[i : min(i + CHUNK, last)], units[i : min(i + CHUNK, last)]) for i in range(0, last, CHUNK)]
                    parts[:] = [(ids[last:], units[last:])]
            return out

        for batch in batches:
            sizes = batch.column("size").to_numpy()
            ids, lists = batch.column("vec_id").to_numpy(), batch.column("v")
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                units, own = unit_rows(flat.reshape(-1, size)), ids[at]
                held.setdefault((size, False), []).append((own, units))
                asked = own % every == 0
                if asked.any():
                    held.setdefault((size, True), []).append((own[asked], units[asked]))
            if out := taken(True):
                yield pa.RecordBatch.from_pylist(out, schema)
        if out := taken(False):
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(run, PACKED)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = row["n"]
    parts = (np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"]), np.frombuffer(row["codes"], np.uint8))
    return parts[0], parts[1].reshape(n, -1), parts[2].reshape(n, -1)


def _searched(dealt: DataFrame, slack: dict[int, float], k: int) -> DataFrame:
    """The k best per query and block; a block's chunks come before the queries that pass through it."""
    schema = pa.schema([("query_id", pa.int64()), ("copy", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (row["size"], row["block"]) != now:
                    now, parts, block = (row["size"], row["block"]), [], None
                ids, units, codes = _unpacked(row)
                if not row["query"]:
                    parts.append((ids, units, codes))
                    continue
                if block is None:
                    if not parts:
                        continue
                    block, parts = Block(*(np.concatenate(p) for p in zip(*parts)), slack[now[0]]), []
                out = [[], [], [], []]
                for j in range(len(ids)):
                    near, scores = block.search(int(ids[j]), units[j], codes[j], k)
                    out[0].append(np.full(len(near), ids[j]))
                    out[1].append(np.full(len(near), row["chunk"] * CHUNK + j))
                    out[2].append(near)
                    out[3].append(scores)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x), f.type) for x, f in zip(out, schema)], schema=schema
                )

    return dealt.mapInArrow(run, "query_id long, copy long, vec_id long, score double")


def nearest(
    vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest of every row whose id ``every`` divides."""
    spark = vectors.sparkSession
    rows = _valid(vectors, key, vector)
    counts = {r["size"]: r["count"] for r in rows.groupBy("size").count().collect()}
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model = learn(rows, counts)
    packed = stored(_packed(rows, model, every), "hamming-chunks").withColumn("chunk", F.monotonically_increasing_id())
    blocks = {n: -(-c // max(CHUNK, min(block_rows, BLOCK_BYTES // (8 * n)))) for n, c in counts.items()}
    of_size = F.create_map(*[F.lit(x) for n, b in blocks.items() for x in (n, b)])[F.col("size")]
    index = packed.filter(~F.col("query")).withColumn("block", F.pmod("chunk", of_size.cast("long")))
    asked = packed.filter("query").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), of_size.cast("long") - 1)))
    dealt = index.unionByName(asked).repartition("size", "block").sortWithinPartitions("size", "block", "query", "chunk")
    found = _searched(dealt, {n: s for n, (_, s) in model.items()}, k)
    best = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
