"""Stored tables, canonical payloads, the default embedder, and ingest with a horizon."""

import datetime as dt
import decimal
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kycmill.functions.payloads import with_canonical_payload
from kycmill.operators import mutations, screening
from kycmill.sources import stored
from kycmill.streaming import operators
from kycmill.streaming.runs import file_stream, run_to_files


def files_by_folder(path):
    return {d: sorted(f for f in names if f.endswith(".parquet")) for d, _, names in os.walk(path) if any(n.endswith(".parquet") for n in names)}


def test_only_buckets_with_changes_are_rewritten(spark, tmp_path):
    rows = [(i, f"n{i}", i % 3) for i in range(300)]
    base = spark.createDataFrame(rows, "id int, name string, role int")
    path = str(tmp_path / "table")
    table = stored.KeyedTable(base, path, ["id"], buckets=16)
    table.create(base)
    before = files_by_folder(path)
    changes = spark.createDataFrame([(5, "new", 1), (5, "newer", 2), (400, "added", 1)], "id int, name string, at int")
    table.upsert(changes, ["at"])
    after = files_by_folder(path)
    want = {(i, n, r) for i, n, r in rows if i != 5} | {(5, "newer", 2), (400, "added", None)}
    assert {tuple(r) for r in table.read().collect()} == want
    changed = [d for d in after if after[d] != before.get(d)]
    assert 1 <= len(changed) <= 2 and len(after) == 16
    # The same for soft deletes, and for a change set without rows.
    gone = spark.createDataFrame([(7, 9)], "id int, at int")
    table.change(gone, lambda df, c: mutations.soft_delete(df, c, "id", "role"))
    assert {tuple(r) for r in table.read().collect()} == want
    table.upsert(changes.limit(0), ["at"])
    assert sum(files_by_folder(path)[d] != after.get(d) for d in after) == 1


def test_a_tenant_reads_its_folder(spark, tmp_path):
    cases = spark.createDataFrame([(f"t{i % 5}", i) for i in range(50)], "tenant_id string, case_id int")
    path = str(tmp_path / "cases")
    stored.write_by_tenant(cases, path)
    mine = stored.read_by_tenant(cases, path, "t3")
    assert mine.columns == cases.columns and sorted(r.case_id for r in mine.collect()) == list(range(3, 50, 5))
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "= t3" in plan
    assert {f.split("tenant_id=")[1][:2] for f in mine.inputFiles()} >= {"t3"}
    scan = spark.read.parquet(path).filter("tenant_id = 't3'").select(F.input_file_name().alias("f")).distinct().collect()
    assert all("tenant_id=t3" in r.f for r in scan)
    assert stored.read_by_tenant(cases, path, None).count() == 0
    tiers = spark.createDataFrame([("t1", "pro"), ("t4", "pro"), ("t2", "standard")], "tenant_id string, plan_tier string")
    tiers.write.parquet(str(tmp_path / "tenants"))
    listed = spark.read.parquet(str(tmp_path / "tenants")).filter("plan_tier = 'pro'")
    some = stored.read_for_tenants(cases, path, listed)
    assert some.count() == 20
    assert "dynamicpruning" in some._jdf.queryExecution().executedPlan().toString().lower()


def random_value(draw, depth=0):
    kind = draw.randrange(9 if depth < 3 else 7)
    if kind == 7:
        return [random_value(draw, depth + 1) for _ in range(draw.randrange(4))]
    if kind == 8:
        return {draw.choice(["a", "b", "ä", "long key", "A", ""]) + str(draw.randrange(3)): random_value(draw, depth + 1) for _ in range(4)}
    values = [None, True, draw.randrange(-(10**25), 10**25), draw.uniform(-1, 1) * 10 ** draw.randrange(-20, 20), "té\u2028\n\"", "x\U0001f600", 0.1]
    return values[kind]


def test_payloads_of_any_shape(spark):
    draw = random.Random(4)
    values = [random_value(draw) for _ in range(300)]
    rows = [(i, json.dumps(v, ensure_ascii=bool(i % 2), indent=i % 3 or None)) for i, v in enumerate(values)]
    rows += [(1000, None), (1001, "{broken"), (1002, '{"a": 1, "a": 2}')]
    got = {r.id: r.payload for r in with_canonical_payload(spark.createDataFrame(rows, "id int, raw string"), "raw").collect()}
    assert [got[i] for i in range(300)] == [json.dumps(v, sort_keys=True, default=str) for v in values]
    assert (got[1000], got[1001], got[1002]) == ("{}", None, '{"a": 2}')


def test_payloads_of_columns(spark):
    at = dt.datetime(2026, 1, 2, 3, 4, 5)
    value = {"z": 1.5, "list": [{"b": 1, "a": None}], "when": at, "amount": decimal.Decimal("1.50"), "more": {"y": 1e-7, "x": 1e22}}
    schema = "id int, v struct<z double, list array<struct<b int, a string>>, when timestamp_ntz, amount decimal(10,2), more map<string,double>>"
    got = with_canonical_payload(spark.createDataFrame([(1, value)], schema), "v", "text").first().text
    assert got == json.dumps(value, sort_keys=True, default=str)


def test_default_embedder(spark):
    names = ["Mohammed Al-Fayed", "Mohamed Al Fayed", "AL-FAYED  mohammed", "Katarzyna Nowak", "José García", "Jose Garcia", "...", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: np.array(r.vector) if r.vector else None for r in screening.embed_names(df).collect()}
    assert got[None] is None and not got["..."].any()
    near = lambda a, b: float(got[a] @ got[b])
    assert near(names[0], names[1]) > 0.7 and near(names[0], names[2]) > 0.99 and near(names[4], names[5]) > 0.99
    assert abs(near(names[0], names[3])) < 0.4 and abs(near(names[0], names[0]) - 1) < 1e-6


@pytest.mark.parametrize("batches", [1, 4])
def test_ingest_within_a_horizon(spark, tmp_path, batches):
    """Repeats within the horizon are dropped, later ones are new again, rows without a key always pass."""
    start, day = dt.datetime(2026, 1, 1), dt.timedelta(days=1)
    rows = [
        ("t", 1, "k", start), ("t", 2, "k", start + 2 * day), ("u", 3, "k", start + 2 * day), ("t", 4, None, start),
        ("t", 5, "", start + day), ("t", 6, "x", start + 40 * day),
        ("t", 10, "y", start + 40 * day), ("u", 11, "y", start + 40 * day), ("t", 12, None, start + 40 * day),
        ("t", 7, "k", start + 41 * day), ("t", 8, "x", start + 42 * day), ("t", 9, "late", start),
    ]
    schema = "tenant_id string, case_id int, idempotency_key string, created_at timestamp"
    for i in range(batches):
        part = rows[i * len(rows) // batches : (i + 1) * len(rows) // batches]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = file_stream(spark.createDataFrame([], schema), str(tmp_path / "in"), 1)
    got = sorted(r.case_id for r in run_to_files(operators.stream_ingest_within(stream, "7 days"), "within", 2).collect())
    # A watermark holds from the next batch on, for late rows from the one after that. In one batch it has not moved:
    # the key is still known, and the late row is not late.
    assert got == [1, 3, 4, 5, 6, *([9] if batches == 1 else [7]), 10, 11, 12]
