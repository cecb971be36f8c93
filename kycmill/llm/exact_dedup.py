"""Exact duplicates: frequent texts settled on the map side, the rest by an ordinary shuffle.

Two texts are equal when their SHA-256 is. A Misra-Gries pass (``freqItems``) names at most ``1 / support``
digests that may be frequent. One aggregate over these alone gives their exact size and winner; this table
has a fixed bound and is broadcast, and copies of a frequent text that are not the winner never reach a
shuffle. All other groups are smaller than ``support`` times the rows and go through one shuffle.

Defined cases: null text counts as empty; the largest ``doc_id`` stays, a null ``doc_id`` is smallest; of
rows that tie in text and ``doc_id`` one stays; an empty table gives an empty table; other columns do not
matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, packed

#: A digest with more than this share of the rows is certain to be found frequent.
SUPPORT = 0.001


def frequent_winners(hashed: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``digest``, ``keep_id``, ``group_size`` of frequent digests, counted exactly; at most 1/support rows."""
    names = hashed.select("digest").freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    return checkpointed(
        hashed.join(F.broadcast(names), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )


def _split(hashed: DataFrame, support: float) -> tuple[DataFrame, DataFrame]:
    """Rows that lose against a frequent winner, and all rows still to be grouped (with the known size)."""
    winners = F.broadcast(frequent_winners(hashed, support))
    marked = hashed.join(winners, "digest", "left")
    loses = F.col("group_size").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return marked.filter(loses), marked.filter(~loses)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per document: ``doc_id``, ``digest``, ``keep_id``, ``group_size``, ``kept``."""
    hashed = packed(docs, key, text).select("doc_id", F.sha2("text", 256).alias("digest"))
    losers, rest = _split(hashed, support)
    group = Window.partitionBy("digest")
    first = F.row_number().over(group.orderBy(F.desc_nulls_last("doc_id"))) == 1
    grouped = rest.select(
        "doc_id",
        "digest",
        F.coalesce("keep_id", F.max("doc_id").over(group)).alias("keep_id"),
        F.coalesce("group_size", F.count("*").over(group)).alias("group_size"),
        first.alias("kept"),
    )
    lost = losers.select("doc_id", "digest", "keep_id", "group_size", F.lit(False).alias("kept"))
    return lost.unionByName(grouped)


def drop_exact(docs: DataFrame, key: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows that stay, with the columns they came with."""
    hashed = packed(docs, key, text).select("doc_id", F.sha2("text", 256).alias("digest"), "row")
    _, rest = _split(hashed, support)
    order = Window.partitionBy("digest").orderBy(F.desc_nulls_last("doc_id"))
    return rest.withColumn("place", F.row_number().over(order)).filter("place = 1").select("row.*")
