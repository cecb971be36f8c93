"""Time the operators a busy key strains: one key holds a third of the rows, inside one quota window.

``ROWS`` (default 3,000,000) and ``CPUS`` may be set in the environment.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from kycmill.operators import audit, quota  # noqa: E402
from kycmill.session import build_session  # noqa: E402


def main() -> None:
    rows, cpus = int(os.environ.get("ROWS", "3000000")), os.environ.get("CPUS", "8")
    spark = build_session(f"local[{cpus}]", **{"spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    spark.sparkContext.setLogLevel("ERROR")
    hot = F.col("id") % 3 == 0
    owner = F.when(hot, F.lit(0)).otherwise(F.col("id") % 5000)
    start = F.lit("2026-01-01").cast("timestamp")
    micros = F.when(hot, F.col("id") % 50_000_000).otherwise(F.col("id") * 997 % 86_400_000_000)
    base = spark.range(rows).select(
        "id", owner.alias("key"), F.timestamp_micros(F.unix_micros(start) + micros).alias("ts")
    )
    requests = base.withColumnRenamed("id", "request_id")
    text = F.lit("x").alias
    events = base.select(
        "id", F.col("key").alias("tenant_id"), F.col("id").cast("string").alias("case_id"),
        text("event_type"), text("actor"), text("model_version"), text("input_hash"), F.lit("{}").alias("payload"),
        F.col("ts").alias("created_at"),
    )
    chain = audit.build_audit_chain(events)
    took = {}
    for name, df in {
        "quota_admission": quota.quota_admission(requests),
        "build_audit_chain": chain,
        "verify_audit_chain": audit.verify_audit_chain(chain),
    }.items():
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 1)
    print(json.dumps({"rows": rows, "seconds": took}))
    spark.stop()


if __name__ == "__main__":
    main()
