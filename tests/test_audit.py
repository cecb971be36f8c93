"""Hash chain: formula, linking, slices, tampering, neighbours across ranges, event pairs."""

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from kycmill.functions.columns import json_text, row_hash, row_hash_prefix
from kycmill.functions.ordering import neighbour
from kycmill.operators import audit

SCHEMA = (
    "id bigint, tenant_id string, case_id string, event_type string, actor string, model_version string, "
    "input_hash string, payload string, created_at timestamp"
)
UTC = dt.timezone.utc


def expected_hash(row, prev):
    _, tenant, case, event, actor, model, digest, payload, at = row
    fields = [tenant, case, event, actor, model or "", digest or "", payload, at.isoformat(), prev or ""]
    return hashlib.sha256("\x1e".join(fields).encode()).hexdigest()


def make_rows(n, hot=3):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        tenant = "hot" if i % hot == 0 else f"t{rng.randrange(6)}"
        at = dt.datetime(2026, 1, 1, tzinfo=UTC) + dt.timedelta(microseconds=rng.choice([0, 1, 250000]) + i * 10**6)
        model, digest = rng.choice([None, "m1"]), rng.choice([None, "a" * 64])
        rows.append((i + 1, tenant, f"c{i % 9}", "x.completed", "actor", model, digest, json.dumps({"n": i, "é": "ü"}), at))
    return rows


def expected_chain(rows):
    last, out = {}, {}
    for row in sorted(rows):
        prev = last.get(row[1])
        out[row[0]] = (prev, expected_hash(row, prev))
        last[row[1]] = out[row[0]][1]
    return out


def collected(df):
    return {r.id: (r.prev_row_hash, r.row_hash) for r in df.collect()}


def test_any_field_changes_the_hash(spark):
    base = make_rows(1)[0]
    variants = [base]
    for i in range(1, 9):
        changed = list(base)
        changed[i] = base[i] + dt.timedelta(seconds=1) if i == 8 else (base[i] or "") + "x"
        variants.append(tuple(changed))
    df = spark.createDataFrame(variants, SCHEMA)
    names = ["tenant_id", "case_id", "event_type", "actor", "model_version", "input_hash", "payload", "created_at"]
    prefix = row_hash_prefix(*[F.col(n) for n in names])
    got = [r[0] for r in df.select(row_hash(prefix, F.lit(None).cast("string"))).collect()]
    assert got == [expected_hash(v, None) for v in variants]
    assert len(set(got)) == len(got)


def test_chain_and_its_slices(spark):
    rows = make_rows(400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = expected_chain(rows)
    assert collected(audit.build_audit_chain(df)) == want
    sliced = audit.build_audit_chain(df, slice_rows=20, width=16)
    assert collected(sliced) == want


@pytest.mark.parametrize("slice_rows", [1 << 20, 25])
def test_chain_continues_from_heads(spark, slice_rows):
    rows = make_rows(240)
    first = audit.build_audit_chain(spark.createDataFrame(rows[:100], SCHEMA))
    heads = audit.chain_heads(first)
    rest = audit.build_audit_chain(spark.createDataFrame(rows[100:], SCHEMA), heads, slice_rows, 8)
    assert collected(first) | collected(rest) == expected_chain(rows)


@pytest.mark.parametrize("slice_rows", [1 << 20, 25])
def test_rows_without_tenant_or_id_stay(spark, slice_rows):
    rows = make_rows(120)
    odd = [(None if i % 9 == 0 else r[0], None if i % 7 == 0 else r[1], *r[2:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(odd, SCHEMA)
    chain = audit.build_audit_chain(df, slice_rows=slice_rows, width=8)
    assert chain.count() == len(rows)
    free = {r.id: (r.prev_row_hash, r.row_hash) for r in chain.filter("tenant_id IS NULL AND id IS NOT NULL").collect()}
    links = {row_hash for _, row_hash in free.values()}
    assert sum(prev not in links for prev, _ in free.values()) == 1


def test_newest_row_with_erased_hash_is_named(spark):
    rows = make_rows(60)
    chain = audit.build_audit_chain(spark.createDataFrame(rows, SCHEMA))
    last = max(r[0] for r in rows if r[1] == "hot")
    erased = F.when(F.col("id") != last, F.col("row_hash"))
    verified = audit.verify_audit_chain(chain.withColumn("row_hash", erased).withColumn(
        "payload", F.when(F.col("id") == last, F.lit("{}")).otherwise(F.col("payload"))))
    assert {r.id: r.violations for r in verified.collect() if r.violations} == {last: ["row_hash"]}
    report = {r.tenant_id: r.status for r in audit.audit_chain_report(verified).collect()}
    assert report["hot"] == "BROKEN"


@pytest.mark.parametrize("width", [7, 1 << 20])
def test_tampering_is_named(spark, width):
    rows = make_rows(300)
    chain = audit.build_audit_chain(spark.createDataFrame(rows, SCHEMA))
    assert audit.verify_audit_chain(chain, width).filter(F.size("violations") > 0).count() == 0
    hot = [r[0] for r in rows if r[1] == "hot"]
    edited, removed = hot[10], hot[40]
    payload = F.when(F.col("id") == edited, F.lit("{}")).otherwise(F.col("payload"))
    bad = chain.withColumn("payload", payload).filter(F.col("id") != removed)
    verified = audit.verify_audit_chain(bad, width)
    found = {r.id: r.violations for r in verified.collect() if r.violations}
    assert found == {edited: ["row_hash"], hot[41]: ["prev_row_hash"]}
    report = {r.tenant_id: r for r in audit.audit_chain_report(verified).collect()}
    assert (report["hot"].status, report["hot"].n_broken, report["hot"].first_broken_id) == ("BROKEN", 2, edited)
    assert {r.status for t, r in report.items() if t != "hot"} == {"OK"}


@pytest.mark.parametrize("following", [False, True])
def test_neighbour_ranges(spark, following):
    rng = random.Random(3)
    rows = [(None if i % 11 == 0 else i % 3, i, rng.randrange(99)) for i in rng.sample(range(5000), 700)]
    df = spark.createDataFrame(rows, "k int, i bigint, v int")
    groups = {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(k, []).append((i, v))
    want = {}
    for g in groups.values():
        for n, (i, _) in enumerate(g):
            other = n + 1 if following else n - 1
            want[i] = g[other][1] if 0 <= other < len(g) else None
    for width in (10, 300, 1 << 20):
        got = neighbour(df, ["k"], "i", F.col("v"), "near", following=following, width=width)
        assert {r.i: r.near for r in got.collect()} == want


def test_step_pairs(spark):
    at = dt.datetime(2026, 1, 1, tzinfo=UTC)
    kinds = ["started", "failed", "started", "started", "completed", "started"]
    rows = [
        (i, "t", "c", f"face_match.{k}", "a", None, None, "{}", at + dt.timedelta(seconds=i * i))
        for i, k in enumerate(kinds)
    ] + [(9, "t", "c", "case_created", "a", None, None, "{}", at)]
    df = spark.createDataFrame(rows, SCHEMA)
    for width in (2, 100):
        assert sorted(r.id for r in audit.orphan_steps(df, width).collect()) == [2, 5]
        ended = {r.id: (r.outcome, r.seconds) for r in audit.step_durations(df, width).collect()}
        assert ended == {0: ("failed", 1.0), 3: ("completed", 7.0)}


def test_json_text_equals_python(spark):
    texts = ["plain", 'a"b\\c', "tab\tnew\nline\r\b\f", "é ü 漢", "😀", "\x01\x7f", "", None, "$1 \\u0041"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(json_text(F.col("t"))).collect()] == [json.dumps(t) for t in texts]


def test_append(spark, tmp_path):
    chain = audit.build_audit_chain(spark.createDataFrame(make_rows(30), SCHEMA))
    audit.append_audit(chain, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert audit.verify_audit_chain(log).filter(F.size("violations") > 0).count() == 0


def test_writers_at_the_same_time(spark, tmp_path):
    """Two writers append to the same tenants at once: one unbroken chain, every event once."""
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "log")
    schema = SCHEMA.replace("id bigint, ", "") + ", seq int"

    def writer(name):
        for n in range(3):
            rows = [(*r[1:3], f"{name}-{n}-{r[0]}", *r[4:], r[0]) for r in make_rows(10)] + [
                (None, "c", f"{name}-{n}-none", "a", None, None, "{}", dt.datetime(2026, 1, 1), 99)
            ]
            audit.append_log(spark.createDataFrame(rows, schema), path, f"{name}-{n}")
        # A batch that was appended before is not appended again.
        audit.append_log(spark.createDataFrame(rows, schema), path, f"{name}-{n}")

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(writer, ["a", "b"]))
    log = audit.read_log(spark, path)
    ids = sorted(r.id for r in log.select("id").collect())
    assert ids == list(range(1, 67))
    assert log.select("event_type").distinct().count() == 66
    assert audit.verify_audit_chain(log).filter(F.size("violations") > 0).count() == 0


def test_a_folder_is_published_once(spark, tmp_path):
    from kycmill.sources.published import names_in, publish

    assert names_in(spark, str(tmp_path / "none")) == []
    for name in ("x", "y"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "file").write_text(name)
    target = f"file://{tmp_path}/out/v"
    assert publish(spark, str(tmp_path / "x"), target) and not publish(spark, str(tmp_path / "y"), target)
    assert (tmp_path / "out" / "v" / "file").read_text() == "x" and names_in(spark, f"{tmp_path}/out") == ["v"]


def test_a_sliced_log_is_stored_once_without_hashes(spark):
    """Of long tenants only events and last hashes are written; the rows with their hashes go straight on."""
    import os

    from kycmill.session import shared_dir

    folder = shared_dir(spark)
    old = set(os.listdir(folder))
    rows = make_rows(200)
    chain = audit.build_audit_chain(spark.createDataFrame(rows, SCHEMA).repartition(3), slice_rows=20, width=8)
    assert collected(chain) == expected_chain(rows)
    (path,) = [n for n in os.listdir(folder) if n.startswith("audit-chain") and n not in old]
    assert sorted(os.listdir(f"{folder}/{path}")) == ["events", "heads"]
    assert "row_hash" not in spark.read.parquet(f"{folder}/{path}/events").columns


def test_dealt_rows_are_appended_as_they_are(spark, tmp_path):
    rows = make_rows(60)
    chain = audit.build_audit_chain(spark.createDataFrame(rows, SCHEMA))
    audit.append_audit(chain, str(tmp_path / "log"), dealt=True)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert collected(log) == expected_chain(rows)
    # Compressed in a way that packs hexadecimal digits, which other codecs leave as they are.
    names = [str(p) for p in (tmp_path / "log").rglob("*.parquet")]
    assert names and all(".zstd." in n for n in names)


def test_packed_hashes_differ_as_the_texts_do(spark):
    texts = ["a" * 64, "A" * 64, "a" * 63, "a" * 64 + "\n", "", "x" * 64, "0" * 64, "\0" * 32, None]
    df = spark.createDataFrame([(t,) for t in texts], "h string")
    got = [r[0] if r[0] is None else bytes(r[0]) for r in df.select(audit._packed_hash("h")).collect()]
    assert len(set(got)) == len(texts) and got[-1] is None and len(got[0]) == 32


def test_ids_work_out_each_event_once(spark):
    """Ids follow the order of time, tenant, case and ``seq``, whatever repeats or is missing; no column outside the order is read to draw ranges."""
    rng = random.Random(8)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def payload(n):
        seen.add(1)
        return f'{{"n": {n}}}'

    at = [None, dt.datetime(2026, 1, 1), *(dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i) for i in range(40))]
    rows = [
        (rng.choice(["hot", "hot", None, "a"]), f"c{rng.randrange(4)}", rng.choice(["x", "y"]), rng.choice(at), rng.randrange(3), i)
        for i in range(1500)
    ]
    schema = "tenant_id string, case_id string, event_type string, created_at timestamp_ntz, seq int, n int"
    events = spark.createDataFrame(rows, schema).repartition(3).withColumn("payload", payload.asNondeterministic()("n"))
    found = audit.assign_ids(events, 7).collect()
    assert seen.value == len(rows)
    assert sorted(r.id for r in found) == list(range(8, 8 + len(rows))) and {r.n for r in found} == set(range(len(rows)))
    first = lambda v: (v is not None, v)
    key = lambda r: (first(r.created_at), first(r.tenant_id), r.case_id, r.seq, r.event_type)
    keys = [key(r) for r in sorted(found, key=lambda r: r.id)]
    assert keys == sorted(keys)
    assert audit.assign_ids(events.limit(0)).collect() == []


def test_a_tenant_within_its_share_is_linked_once(spark, monkeypatch):
    """Slices end nothing earlier where no tenant holds more than a core's share of all rows."""
    import os

    from kycmill.session import shared_dir

    monkeypatch.setattr(audit, "SLICE_ROWS", 20)
    even = [(i + 1, f"t{i % 12}", *r[2:]) for i, r in enumerate(make_rows(480))]
    for rows, stored in ((even, 0), (make_rows(900, hot=1), 1)):
        old = set(os.listdir(shared_dir(spark)))
        chain = audit.build_audit_chain(spark.createDataFrame(rows, SCHEMA), width=8)
        assert collected(chain) == expected_chain(rows)
        new = [n for n in os.listdir(shared_dir(spark)) if n.startswith("audit-chain") and n not in old]
        assert len(new) == stored


def test_nothing_moves_below_the_links(spark):
    """Rows left out and columns dropped after the chain was built change no hash."""
    rows = make_rows(200)
    want = expected_chain(rows)
    chain = audit.build_audit_chain(spark.createDataFrame(rows, SCHEMA).repartition(3))
    some = chain.filter("id % 3 = 1 and tenant_id = 'hot'").select("id", "prev_row_hash", "row_hash")
    assert collected(some) == {i: h for i, h in want.items() if i % 3 == 1 and rows[i - 1][1] == "hot"}
    last = chain.groupBy("tenant_id").agg(F.max_by("row_hash", "id").alias("h"), F.max("id").alias("id")).collect()
    assert {r.id: r.h for r in last} == {i: want[i][1] for i in (max(r[0] for r in rows if r[1] == t) for t in {r[1] for r in rows})}


def test_times_are_written_as_python_does(spark):
    from kycmill.functions.columns import iso_timestamp

    times = [dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(1969, 12, 31, 23, 59, 59), dt.datetime(2026, 1, 1, 0, 0, 0, 10)]
    df = spark.createDataFrame([(t,) for t in [*times, None]], "t timestamp_ntz")
    got = [r[0] for r in df.select(iso_timestamp(F.col("t"))).collect()]
    assert got == [*(t.isoformat() + "+00:00" for t in times), None]
