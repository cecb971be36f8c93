"""Name screening: vector similarity and phonetic codes, united with vector hits first."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import top_per
from ..functions.phonetic import phonetic_codes
from ..schemas import PHONETIC_LIMIT, VECTOR_LIMIT, VECTOR_THRESHOLD
from ..session import scratch_path
from .mutations import watchlist_ingest

#: Rows of a block of queries or entries, and never more than a tile: a block is one row of a task's input.
BLOCK_ROWS = 50_000
_TILE = 2048
#: Centres of a list's blocks at most, and entries from which they are found.
CENTRES, CENTRE_SAMPLE = 512, 4096


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _best(row: np.ndarray, entry: np.ndarray, score: np.ndarray, k: int):
    """Best ``k`` per row: by score, then by entry position."""
    order = np.lexsort((entry, -score, row))
    row, entry, score = row[order], entry[order], score[order]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.array([], int)
    place = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
    keep = place < k
    return row[keep], entry[keep], score[keep]


def _similar(queries: np.ndarray, entries: np.ndarray, k: int, threshold: float):
    """Top ``k`` (query, entry, cosine) at or above the threshold, tile by tile in double precision."""
    found = []
    for q in range(0, len(queries), _TILE):
        left = queries[q : q + _TILE].astype("float64")
        parts = []
        for e in range(0, len(entries), _TILE):
            scores = left @ entries[e : e + _TILE].astype("float64").T
            r, c = np.nonzero(scores >= threshold)
            parts.append(_best(r, c + e, scores[r, c], k))
        r, c, s = _best(*[np.concatenate([p[i] for p in parts]) for i in range(3)], k)
        found.append((r + q, c, s))
    return [np.concatenate([f[i] for f in found]) for i in range(3)]


def _sealed(batches: list[pa.RecordBatch]) -> bytes:
    """The rows as one binary value in Arrow's stream format."""
    table = pa.Table.from_batches(batches).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _opened(block: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(block.as_buffer()).read_all()


def _query_blocks(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, rows - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == rows:
                    yield pa.RecordBatch.from_arrays([pa.array([_sealed(held)], pa.binary())], ["queries"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_sealed(held)], pa.binary())], ["queries"])

    return run


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(1))


def _directions(vectors: np.ndarray) -> np.ndarray:
    length = _lengths(vectors)
    return vectors / np.where(length > 0, length, 1.0)[:, None]


def _angles(directions: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(directions @ others.T, -1.0, 1.0))


def _centres(w: DataFrame, n: int, rows: int) -> np.ndarray:
    """As many directions as the list has blocks (``CENTRES`` at most), from a sample of bounded size."""
    share = min(1.0, CENTRE_SAMPLE / max(1, n))
    hashed = F.pmod(F.xxhash64("entry_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    sample = w.filter(hashed).orderBy(F.xxhash64("entry_id")).select("vector").limit(2 * CENTRE_SAMPLE).collect()
    if not sample:
        return np.zeros((0, 0))
    found = _directions(np.array([r.vector for r in sample], np.float64))
    k = min(CENTRES, len(found), -(-n // rows))
    centres = found[:k]
    for _ in range(3):
        own = (found @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, found)
        centres = np.where(_lengths(sums)[:, None] > 0, _directions(sums), centres)
    return centres


def _near_centres(centres: np.ndarray):
    """Each entry with its nearest centre and the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, _TILE):
                part = batch.slice(first, _TILE)
                angle = _angles(_directions(_matrix(part.column("vector")).astype("float64")), centres)
                own = angle.argmin(1)
                more = [pa.array(own, pa.int32()), pa.array(angle[np.arange(len(own)), own])]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "centre", "angle"])

    return run


_ENTRY_BLOCK = "entries binary, centre int, low double, high double, longest double"


def _entry_blocks(rows: int):
    """Sorted entries in blocks of one centre, each with the range of its angles and its longest vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            centre, angle = table["centre"][0].as_py(), table["angle"].to_numpy()
            longest = float(_lengths(_matrix(table["vector"]).astype("float64")).max())
            kept = table.drop_columns(["centre", "angle"]).to_batches()
            values = [[_sealed(kept)], [centre], [angle.min()], [angle.max()], [longest]]
            types = [pa.binary(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(values, types)], ["entries", "centre", "low", "high", "longest"]
            )

        n = 0
        for batch in batches:
            own = batch.column("centre").to_numpy()
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), batch.num_rows]
            for first, past in zip(cuts, cuts[1:]):
                while first < past:
                    if held and (n == rows or held[0].column("centre")[0].as_py() != own[first]):
                        yield block()
                        held, n = [], 0
                    m = min(rows - n, past - first)
                    held.append(batch.slice(first, m))
                    n, first = n + m, first + m
        if held:
            yield block()

    return run


def _screen_blocks(k: int, threshold: float, centres: np.ndarray, counted: bool):
    """Every block of queries meets the blocks of entries one after another and carries its best hits along.

    By the triangle inequality an entry is at least as far from a query as the query's angle to the block's centre
    is outside of the block's range. Queries for which that is further than a hit can be (the threshold, or their
    own k-th best so far) skip the block.
    """
    order = [("at", "ascending"), ("score", "descending"), ("entry_id", "ascending")]

    def merged(best: pa.Table, new: pa.Table) -> pa.Table:
        both = pa.concat_tables([best, new]).sort_by(order).combine_chunks()
        at = both["at"].to_numpy()
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        return both.take(pa.array(np.flatnonzero(place < k)))

    class Held:
        """One block of queries, and what it has found."""

        def __init__(self, block: pa.Table):
            self.block, self.best, self.seen, self.met = block, None, 0, 0
            self.vectors = _matrix(block["vector"])
            double = self.vectors.astype("float64")
            self.lengths, self.directions = _lengths(double), _directions(double)
            self.angles: dict[int, np.ndarray] = {}
            self.least = np.full(len(double), threshold)

        def possible(self, centre: int, low: float, high: float, longest: float) -> np.ndarray:
            if centre not in self.angles:
                self.angles[centre] = _angles(self.directions, centres[centre : centre + 1])[:, 0]
            own = self.angles[centre]
            scale = self.lengths * longest
            # A hit's cosine is at least this; the last term is for rounding.
            cosine = np.where((self.least > 0) & (scale > 0), self.least / np.where(scale > 0, scale, 1.0) - 1e-9, -1.0)
            gap = np.maximum(own - high, low - own)
            return np.flatnonzero(gap <= np.arccos(np.clip(cosine, -1.0, 1.0)) + 1e-7)

        def meet(self, entries: pa.Table, rows: np.ndarray) -> None:
            at, found, scores = _similar(self.vectors[rows], _matrix(entries["vector"]), k, threshold)
            entry = entries.select(["entry_id", "list_source", "name"]).take(pa.array(found, pa.int64()))
            columns = [pa.array(rows[at], pa.int64()), *entry.columns, pa.array(scores, pa.float64())]
            new = pa.Table.from_arrays(columns, ["at", *entry.column_names, "score"])
            self.best = new if self.best is None else merged(self.best, new)
            at, scores = self.best["at"].to_numpy(), self.best["score"].to_numpy()
            full = np.flatnonzero(np.bincount(at, minlength=len(self.least)) >= k)
            self.least[full] = scores[np.searchsorted(at, full, "right") - 1]

        def result(self) -> list[pa.RecordBatch]:
            if counted:
                figures = [pa.array([n], pa.int64()) for n in (self.seen, self.seen - self.met)]
                return [pa.RecordBatch.from_arrays(figures, ["pairs", "skipped"])]
            if self.best is None:
                return []
            ids = self.block["query_id"].take(self.best["at"])
            return self.best.set_column(0, "query_id", ids).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, None
        for batch in batches:
            bounds = zip(*[batch.column(c).to_pylist() for c in ("centre", "low", "high", "longest")])
            for left, right, bound in zip(batch.column("queries"), batch.column("entries"), bounds):
                block = _opened(left)
                if block["row"][0] != number:
                    if held is not None:
                        yield from held.result()
                    number, held = block["row"][0], Held(block)
                rows, entries = held.possible(*bound), _opened(right).sort_by("entry_id")
                held.seen += len(held.least) * entries.num_rows
                held.met += len(rows) * entries.num_rows
                if len(rows):
                    held.meet(entries, rows)
        if held is not None:
            yield from held.result()

    return run


def _met_blocks(queries: DataFrame, watchlist: DataFrame, block_rows: int) -> tuple[DataFrame, np.ndarray, T.StructType]:
    """Pairs of stored blocks, the centres of the list's blocks, and the columns of a hit."""
    spark = queries.sparkSession
    w = watchlist.select("entry_id", "list_source", "name", "vector").filter(F.col("vector").isNotNull())
    # The number of its first row tells a block from others.
    q = queries.filter(F.col("vector").isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), "query_id", "vector"
    )
    rows = min(block_rows, _TILE)
    n = w.count()
    centres = _centres(w, n, rows)
    extra = [T.StructField("centre", T.IntegerType()), T.StructField("angle", T.DoubleType())]
    placed = w.mapInArrow(_near_centres(centres), T.StructType([*w.schema.fields, *extra]))
    # A centre with a large part of the list is dealt over several tasks.
    salt = F.pmod(F.xxhash64("entry_id"), F.lit(1 + n // (64 * rows)))
    ordered = placed.repartition("centre", salt).sortWithinPartitions("centre", "angle", "entry_id")
    left, right = scratch_path(spark, "queries"), scratch_path(spark, "watchlist")
    q.mapInArrow(_query_blocks(rows), "queries binary").write.parquet(left)
    ordered.mapInArrow(_entry_blocks(rows), _ENTRY_BLOCK).write.parquet(right)
    blocks = spark.read.schema(_ENTRY_BLOCK).parquet(right).coalesce(1)
    # The hint asks for the product of partitions; without it a short list would be sent through the driver.
    pairs = spark.read.schema("queries binary").parquet(left).crossJoin(blocks.hint("shuffle_replicate_nl"))
    score = T.StructField("score", T.DoubleType())
    return pairs, centres, T.StructType([q.schema["query_id"], *w.drop("vector").schema.fields, score])


def vector_screen(
    queries: DataFrame,
    watchlist: DataFrame,
    k: int = VECTOR_LIMIT,
    threshold: float = VECTOR_THRESHOLD,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Up to ``k`` entries per query row with cosine at or above ``threshold``; exact.

    Vectors are unit length (the score is their product). Queries and list are packed into blocks of rows, which lie
    in the shared folder. Blocks of the list are formed around centres and know the range of their angles, so that
    queries skip blocks that cannot hold a hit (see ``screened_share``). A task reads some blocks of queries and all
    of the list, one after another, and multiplies what is left as matrices: of the list only a sample for the
    centres passes the driver, queries are never shuffled, and no pair of rows is ever formed.
    """
    pairs, centres, schema = _met_blocks(queries, watchlist, block_rows)
    return pairs.mapInArrow(_screen_blocks(k, threshold, centres, False), schema)


def screened_share(
    queries: DataFrame,
    watchlist: DataFrame,
    k: int = VECTOR_LIMIT,
    threshold: float = VECTOR_THRESHOLD,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """What ``vector_screen`` skips: one row with ``pairs``, ``skipped`` and their ``share``."""
    pairs, centres, _ = _met_blocks(queries, watchlist, block_rows)
    figures = pairs.mapInArrow(_screen_blocks(k, threshold, centres, True), "pairs bigint, skipped bigint")
    total = figures.agg(F.sum("pairs").alias("pairs"), F.sum("skipped").alias("skipped"))
    return total.withColumn("share", F.col("skipped") / F.col("pairs"))


def phonetic_match(a: Column, b: Column) -> Column:
    """Whether two names share a phonetic code."""
    return F.coalesce(F.arrays_overlap(phonetic_codes(a), phonetic_codes(b)), F.lit(False))


def with_codes(df: DataFrame, name: str = "name") -> DataFrame:
    return df.withColumn("phonetic_codes", phonetic_codes(F.col(name)))


def phonetic_screen(queries: DataFrame, watchlist: DataFrame, k: int = PHONETIC_LIMIT) -> DataFrame:
    """Up to ``k`` entries, smallest id first, that share a code with the query.

    Only the ``k`` smallest ids of a code can be among the ``k`` smallest of a query, so each code
    keeps a short list before anything is joined. A query has at most two codes: two look-ups replace
    the join of all rows that share a code, however common the code is.
    """
    entry = F.struct("entry_id", "list_source", "name")
    by_code = watchlist.select(F.explode("phonetic_codes").alias("code"), "entry_id", "list_source", "name")
    short = (
        top_per(by_code, ["code"], [F.col("entry_id")], k)
        .groupBy("code")
        .agg(F.collect_list(entry).alias("entries"))
    )
    # Most names have one code. A missing one gets a value no code can equal, different per query: all
    # of them under one null would meet in one partition of the join.
    nothing = F.concat(F.lit("none-"), F.col("query_id").cast("string"))
    rows = queries.select(
        "query_id",
        *[F.coalesce(F.get("phonetic_codes", F.lit(i)), nothing).alias(f"c{i}") for i in (0, 1)],
    )
    none = F.array().cast("array<struct<entry_id:string,list_source:string,name:string>>")
    for i in (0, 1):
        side = short.select(F.col("code").alias(f"c{i}"), F.col("entries").alias(f"e{i}"))
        rows = rows.join(side, f"c{i}", "left")
    lists = F.concat(F.coalesce("e0", none), F.coalesce("e1", none))
    hits = F.slice(F.array_sort(F.array_distinct(lists)), 1, k)
    return rows.select("query_id", F.explode(hits).alias("h")).select("query_id", "h.*")


def unite_hits(vector: DataFrame, phonetic: DataFrame) -> DataFrame:
    """Both kinds of hits, one row per (query, source, name); a vector hit hides the phonetic one."""
    first = vector.select("query_id", "list_source", "name", "score", F.lit(0).alias("rank"))
    second = phonetic.select("query_id", "list_source", "name", F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    best = F.min(F.struct("rank", (-F.col("score")).alias("minus"))).alias("best")
    return (
        first.unionByName(second)
        .groupBy("query_id", "list_source", "name")
        .agg(best)
        .select(
            "query_id",
            "list_source",
            F.col("name").alias("matched_name"),
            (-F.col("best.minus")).alias("match_score"),
            F.when(F.col("best.rank") == 0, F.lit("vector")).otherwise(F.lit("phonetic")).alias("method"),
        )
    )


def screen_names(
    queries: DataFrame,
    watchlist: DataFrame,
    threshold: float = VECTOR_THRESHOLD,
    vector_limit: int = VECTOR_LIMIT,
    phonetic_limit: int = PHONETIC_LIMIT,
) -> DataFrame:
    """Screen ``queries(query_id, vector, phonetic_codes)``. Both limits apply before the hits are united."""
    return unite_hits(
        vector_screen(queries, watchlist, vector_limit, threshold),
        phonetic_screen(queries, watchlist, phonetic_limit),
    )


def screen_summary(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Hit count and highest score per query; zero and null without hits."""
    figures = hits.groupBy("query_id").agg(
        F.count("*").alias("hit_count"), F.max("match_score").alias("highest_score")
    )
    return queries.select("query_id").join(figures, "query_id", "left").select(
        "query_id", F.coalesce("hit_count", F.lit(0)).cast("bigint").alias("hit_count"), "highest_score"
    )


def ingest_watchlist(
    entries: DataFrame,
    make_client: Callable[[], Callable[[str], list[float]]] | None = None,
    current: DataFrame | None = None,
) -> DataFrame:
    """List entries ``(list_source, name, version)`` with vector and codes, upserted into ``current``.

    Repeated entries are dropped first, so the embedding client sees each entry once.
    """
    enriched = with_codes(embed_names(watchlist_ingest(entries).drop("entry_id"), make_client))
    return watchlist_ingest(enriched, current)


#: Dimension of the default embedder, and the lengths of its character n-grams.
EMBEDDING_SIZE, NGRAMS = 256, (2, 3, 4)


def hashed_ngrams(size: int = EMBEDDING_SIZE, ngrams: tuple[int, ...] = NGRAMS) -> Callable[[], Callable[[str], list[float]]]:
    """The default embedding client: signed feature hashing of character n-grams, at unit length.

    Needs no model and no network. Names that share most of their n-grams are near, whatever the order of their
    parts; names are compared without accents, case and double blanks. A name without letters or digits is zero.
    """

    def make_client() -> Callable[[str], list[float]]:
        def embed(name: str) -> list[float]:
            plain = "".join(c for c in unicodedata.normalize("NFKD", name.casefold()) if not unicodedata.combining(c))
            vector = np.zeros(size)
            for word in re.findall(r"\w+", plain):
                padded = f"<{word}>"
                for n in ngrams:
                    for i in range(len(padded) - n + 1):
                        h = int.from_bytes(hashlib.blake2b(padded[i : i + n].encode(), digest_size=8).digest(), "little")
                        vector[(h >> 1) % size] += 1.0 if h & 1 else -1.0
            length = float(np.sqrt(vector @ vector))
            return (vector / length if length else vector).tolist()

        return embed

    return make_client


def embed_names(names: DataFrame, make_client: Callable[[], Callable[[str], list[float]]] | None = None) -> DataFrame:
    """Add ``vector`` by a user's embedding client, made once per task, called once per distinct name.

    Without a client the names are embedded by ``hashed_ngrams``.
    """
    make_client = make_client or hashed_ngrams()

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make_client()
        for batch in batches:
            yield batch.map(client)

    embed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    distinct = names.select("name").filter(F.col("name").isNotNull()).distinct()
    vectors = distinct.withColumn("vector", F.pandas_udf(embed, T.ArrayType(T.FloatType()))("name"))
    return names.join(vectors, "name", "left").select(*names.columns, "vector")
