"""Phonetic codes, vector and phonetic screening, user-supplied clients."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kycmill.functions.phonetic import double_metaphone
from kycmill.operators import screening


@pytest.mark.parametrize(
    ("name", "codes"),
    [
        ("Mohammed", ("MHMT", "")), ("Muhammad", ("MHMT", "")), ("Smith", ("SM0", "XMT")), ("Schmidt", ("XMT", "SMT")),
        ("aubrey", ("APR", "")), ("richard", ("RXRT", "RKRT")), ("world", ("ARLT", "FRLT")), ("Thumb", ("0M", "TM")),
        ("filipowicz", ("FLPTS", "FLPFX")), ("Wasserman", ("ASRMN", "FSRMN")), ("cabrillo", ("KPRL", "KPR")),
        ("Schneider", ("XNTR", "SNTR")), ("laugh", ("LF", "")), ("knight", ("NT", "")), ("island", ("ALNT", "")), ("", ("", "")),
        ("Jose", ("HS", "")), ("Jose Diaz", ("HSTS", "")), ("Josef", ("JSF", "HSF")),
    ],
)
def test_double_metaphone(name, codes):
    assert double_metaphone(name) == codes


def _names(spark, rows, key):
    df = spark.createDataFrame(rows, f"{key} string, list_source string, name string, vector array<float>")
    return screening.with_codes(df)


def _screen(spark, query, entries):
    watch = _names(spark, [(f"e{i}", *e) for i, e in enumerate(entries)], "entry_id")
    queries = _names(spark, [("q", "", *query)], "query_id")
    hits = screening.screen_names(queries, watch, threshold=0.55)
    return sorted((r.list_source, r.matched_name, round(r.match_score, 4), r.method) for r in hits.collect())


def test_hit_kinds(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    assert _screen(spark, ("Katarzyna", a), [("L", "Someone", a)]) == [("L", "Someone", 1.0, "vector")]
    assert _screen(spark, ("Katarzyna", a), [("L", "Mohammed", b)]) == []
    assert _screen(spark, ("Muhammad", a), [("L", "Mohammed", b)]) == [("L", "Mohammed", 1.0, "phonetic")]
    assert _screen(spark, ("Smith", a), [("L", "Schmidt", a)]) == [("L", "Schmidt", 1.0, "vector")]


def _unit(rng, n, d=8):
    m = rng.normal(size=(n, d))
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype("float32")


def test_vector_screen_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    q, w = _unit(rng, 300), _unit(rng, 120)
    # A third of the queries and of the entries are copies of one vector: all ties.
    q[:100], w[:40] = q[0], q[0]
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, vector array<float>")
    watch = spark.createDataFrame(
        [(f"e{i:04d}", "L", f"n{i}", v.tolist()) for i, v in enumerate(w)],
        "entry_id string, list_source string, name string, vector array<float>",
    )
    scores = q.astype("float64") @ w.astype("float64").T
    want = set()
    for i, row in enumerate(scores):
        best = sorted((-s, j) for j, s in enumerate(row) if s >= 0.5)[:5]
        want |= {(i, f"e{j:04d}") for _, j in best}
    small = screening.vector_screen(queries, watch, 5, 0.5)
    blocks = screening.vector_screen(queries, watch, 5, 0.5, block_rows=17)
    for hits in (small, blocks):
        assert {(r.query_id, r.entry_id) for r in hits.collect()} == want


def _clustered(rng, n, clusters, spread, d=24):
    centres = _unit(rng, clusters, d)
    m = centres[rng.integers(clusters, size=n)] + rng.normal(size=(n, d)) * spread
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype("float32")


@pytest.mark.parametrize("threshold", [0.9, 0.55, -0.2])
def test_skipped_blocks_hold_no_hits(spark, threshold):
    """Equal to all pairs; the share that is skipped grows with the list, as its blocks get narrower."""
    rng = np.random.default_rng(3)
    q, shares = _clustered(rng, 150, 40, 0.08), []
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, vector array<float>")
    for n in (60, 600):
        w = _clustered(np.random.default_rng(3), n, 40, 0.08)
        watch = spark.createDataFrame(
            [(f"e{i:04d}", "L", f"n{i}", v.tolist()) for i, v in enumerate(w)],
            "entry_id string, list_source string, name string, vector array<float>",
        ).repartition(3)
        scores = q.astype("float64") @ w.astype("float64").T
        want = set()
        for i, row in enumerate(scores):
            best = sorted((-s, j) for j, s in enumerate(row) if s >= threshold)[:5]
            want |= {(i, f"e{j:04d}") for _, j in best}
        hits = screening.vector_screen(queries, watch, 5, threshold, block_rows=16)
        assert {(r.query_id, r.entry_id) for r in hits.collect()} == want
        figures = screening.screened_share(queries, watch, 5, threshold, block_rows=16).first()
        assert figures.pairs == 150 * n
        shares.append(figures.share)
    if threshold > 0:
        assert shares[1] > max(0.5, shares[0])


def test_vector_screen_passes_no_list_through_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(f"e{i}", "L", f"n{i}", v.tolist()) for i, v in enumerate(_unit(rng, 30))]
    watch = spark.createDataFrame(rows, "entry_id string, list_source string, name string, vector array<float>")
    queries = watch.select(F.lit(1).alias("query_id"), "vector")

    def refused(*_):
        raise AssertionError("through the driver")

    monkeypatch.setattr(type(watch), "toArrow", refused)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refused)
    hits = screening.vector_screen(queries, watch, 1, 0.9, block_rows=7)
    assert "Broadcast" not in hits._jdf.queryExecution().executedPlan().toString()
    # Rows of one query id keep hits of their own.
    assert sorted(r.entry_id for r in hits.collect()) == sorted(r[0] for r in rows)


def test_tasks_read_a_few_blocks_at_a_time(spark):
    """However long the list, a batch for Python holds pairs of blocks up to a bound in bytes."""
    rows = [(f"e{i:02d}", "L", f"{i:02d}" * (1 << 19), [1.0, 0.0]) for i in range(40)]
    watch = spark.createDataFrame(rows, "entry_id string, list_source string, name string, vector array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, vector array<float>")
    pairs, _, _ = screening._met_blocks(queries, watch.repartition(8), block_rows=1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    found = pairs.mapInArrow(sizes, "n bigint, bytes bigint").collect()
    assert sum(r.n for r in found) == 40
    assert max(r.bytes for r in found) <= 16 << 20


def test_entries_are_placed_in_slices():
    """Angles to all centres are held for a few thousand entries at a time, whatever the batch."""
    rng = np.random.default_rng(5)
    vectors, centres = _unit(rng, 5000), _unit(rng, 30).astype("float64")
    column = pa.array(vectors.tolist(), pa.list_(pa.float32()))
    parts = list(screening._near_centres(centres)(iter([pa.RecordBatch.from_arrays([column], ["vector"])])))
    assert max(p.num_rows for p in parts) <= screening._TILE
    near = np.concatenate([p.column("centre").to_numpy() for p in parts])
    angle = np.concatenate([p.column("angle").to_numpy() for p in parts])
    want = np.arccos(np.clip(vectors.astype("float64") @ centres.T, -1, 1))
    assert len(near) == 5000 and np.allclose(angle, want.min(1), atol=1e-6) and np.allclose(want[np.arange(5000), near], want.min(1), atol=1e-6)


def test_phonetic_screen_equals_brute_force(spark):
    # One code is shared by most queries and entries.
    names = ["Smith", "Schmidt", "Smyth", "Mohammed", "Muhammad", "Katarzyna", "Nowak"]
    entries = [(f"e{i:03d}", f"L{i % 3}", names[i % 4 % 3] if i % 4 else names[3 + i % 4]) for i in range(90)]
    queries = [(i, names[i % 7] if i % 3 else "Smith") for i in range(60)]
    watch = screening.with_codes(spark.createDataFrame(entries, "entry_id string, list_source string, name string"))
    ask = screening.with_codes(spark.createDataFrame(queries, "query_id int, name string"))
    codes = {n: {c for c in double_metaphone(n) if c} for n in names}
    want = set()
    for i, n in queries:
        want |= {(i, e) for e in sorted(e for e, _, m in entries if codes[n] & codes[m])[:10]}
    got = {(r.query_id, r.entry_id) for r in screening.phonetic_screen(ask, watch).collect()}
    assert got == want


def test_summary_without_hits(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    hits = spark.createDataFrame([(1, 0.7), (1, 0.9)], "query_id int, match_score double")
    got = {r.query_id: (r.hit_count, r.highest_score) for r in screening.screen_summary(queries, hits).collect()}
    assert got == {1: (2, 0.9), 2: (0, None)}


def test_embedding_client_is_made_in_the_task(spark):
    def make_client():
        return lambda name: [float(len(name)), 1.0]

    df = spark.createDataFrame([("ab",), ("ab",), (None,)], "name string")
    got = [r.vector for r in screening.embed_names(df, make_client).collect()]
    assert got == [[2.0, 1.0], [2.0, 1.0], None]
