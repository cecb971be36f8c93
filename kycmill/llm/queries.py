"""The registered queries of this subpackage, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    centroid_cluster,
    chat_format,
    decontaminate,
    exact_dedup,
    filter_audit,
    hamming_index,
    language_id,
    license_scan,
    line_dedup,
    minhash,
    substring_dedup,
    url_filter,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


TOKENIZER, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"
#: The contract adds this conversation, whose texts hold control strings.
PROBE = (-7, r"\### Assistant: </turn> ok")


@query
def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    encoded = bpe.encode(table(spark, folder, "documents"), path)
    return bpe.digests(bpe.decode(encoded, path))


@query
def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    conv, text = PROBE
    probe = spark.range(2).select(
        F.lit(conv).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(text).alias("text"),
    )
    return chat_format.read_back(chat_format.format_chats(rows.unionByName(probe)))


@query
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, folder, "documents")).drop("findings")


@query
def op4_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_classes(table(spark, folder, "documents")).drop("th")


@query
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs, public_tokenizers.path(PIECES))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select(
        "row.doc_id", language_id.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score"
    )


@query
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


@query
def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, folder, "benchmark"))
    return found.select(
        "row.doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"),
        F.array_min(F.transform("leaks", lambda x: x["n_edits"])).alias("fewest_edits"),
    )


@query
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.drop_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


@query
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query
def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.url_filter(table(spark, folder, "pages"))


@query
def op11_hamming_index(spark: SparkSession, folder: str) -> DataFrame:
    return hamming_index.nearest(table(spark, folder, "embeddings"))


@query
def op12_centroid_cluster(spark: SparkSession, folder: str) -> DataFrame:
    found = centroid_cluster.cluster_vectors(table(spark, folder, "embeddings"))
    return found.withColumn("centroid_sha256", centroid_cluster.centroid_digest(F.col("centroid"))).drop("centroid")


@query
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))
