"""Who made a request: attribution of a request log by hashed credentials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bearer_token(header: Column) -> Column:
    """Token of a ``Bearer`` header, empty when blank, null for any other header."""
    token = F.regexp_replace(F.substring(header, 8, 1 << 30), r"^\s+|\s+$", "")
    return F.when(header.startswith("Bearer "), token)


def token_attribution(requests: DataFrame, reviewers: DataFrame, api_keys: DataFrame) -> DataFrame:
    """Add ``principal``, ``tenant_id`` and ``outcome`` to ``requests(request_id, authorization)``.

    A live reviewer token is preferred to a live API key; revoked and unknown tokens are told apart.
    """
    token = bearer_token(F.col("authorization"))
    # Requests without a token get a value no digest can equal: they would otherwise all meet in one
    # partition of the join under the same null.
    nobody = F.concat(F.lit("none-"), F.col("request_id").cast("string"))
    hashed = F.when(token != "", F.sha2(token, 256)).otherwise(nobody)
    r = reviewers.select(
        F.col("token_hash").alias("hash"),
        F.col("tenant_id").alias("r_tenant"),
        F.col("revoked_at").isNull().alias("r_live"),
    )
    k = api_keys.select(
        F.col("key_hash").alias("hash"),
        F.col("tenant_id").alias("k_tenant"),
        F.col("revoked_at").isNull().alias("k_live"),
    )
    joined = requests.withColumns({"token": token, "hash": hashed}).join(r, "hash", "left").join(k, "hash", "left")
    by_reviewer = F.coalesce("r_live", F.lit(False))
    by_key = ~by_reviewer & F.coalesce("k_live", F.lit(False))
    known = F.col("r_live").isNotNull() | F.col("k_live").isNotNull()
    outcome = (
        F.when(F.col("token").isNull(), F.lit("malformed"))
        .when(F.col("token") == "", F.lit("empty"))
        .when(by_reviewer | by_key, F.lit("ok"))
        .when(known, F.lit("revoked"))
        .otherwise(F.lit("unknown"))
    )
    return joined.select(
        "request_id",
        F.when(by_reviewer, F.lit("reviewer")).when(by_key, F.lit("api_key")).alias("principal"),
        F.when(by_reviewer, F.col("r_tenant")).when(by_key, F.col("k_tenant")).alias("tenant_id"),
        outcome.alias("outcome"),
    )
