"""Near duplicates against a comparison of all pairs."""

import itertools
import random
import re

import numpy as np
import pytest

from kycmill.llm import minhash
from kycmill.llm.common import checkpointed
from kycmill.llm.graph import components
from kycmill.llm.minhash import U


def slow_similarity(p: dict, q: dict) -> float:
    keys = set(p) | set(q)
    return sum(
        1 / sum(max(p.get(j, 0) / p[i], q.get(j, 0) / q[i]) for j in keys) for i in set(p) & set(q)
    )


def arrays(p: dict):
    keys = sorted(p)
    return np.array(keys, U), np.array([p[k] for k in keys], np.int64)


def test_similarity_is_the_definition():
    draw = random.Random(1)
    for _ in range(200):
        p = {draw.randrange(12): draw.randrange(1, 5) for _ in range(8)}
        q = {draw.randrange(12): draw.randrange(1, 5) for _ in range(8)}
        assert abs(minhash.similarity(*arrays(p), *arrays(q)) - slow_similarity(p, q)) < 1e-12


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(2)
    for shared in (200, 120, 40):
        p = dict.fromkeys(map(int, draw.integers(0, 1 << 63, shared)), 1)
        q = dict(p)
        for side in (p, q):
            side.update(dict.fromkeys(map(int, draw.integers(0, 1 << 63, 60)), 2))
        a, b = (minhash.signature(*arrays(s), 2000) for s in (p, q))
        assert abs((a == b).mean() - slow_similarity(p, q)) < 0.05


def texts(seed=5):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(4000)]
    out = []
    for _ in range(6):
        base = draw.choices(words, k=draw.randrange(40, 120))
        out.append(" ".join(base))
        for _ in range(14):  # on both sides of the threshold
            copy = list(base)
            for _ in range(draw.randrange(0, 4)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            out.append(" ".join(copy))
    repeated = " ".join(draw.choices(words, k=20))
    out += [f"{repeated} {repeated} x y z", f"{repeated} {repeated} {repeated} x y z", f"{repeated} x y z"]
    return out + ["one two", "One, two!", "", "  ", None, "three", words[0] * 3000]


def brute(found):
    profiles = [dict(zip(*(x.tolist() for x in minhash.shingles(t or "")))) for t in found]
    root = list(range(len(found)))
    for i, j in itertools.combinations(range(len(found)), 2):
        if profiles[i] and profiles[j] and slow_similarity(profiles[i], profiles[j]) >= 0.8:
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    return root


def test_classes_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 4)
    found = texts()
    rows = [(i, t, "x") for i, t in enumerate(found)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class string").repartition(3)
    got = minhash.near_classes(docs).collect()
    want = brute(found)
    assert [r.class_id for r in sorted(got)] == want
    assert all(r.class_size == want.count(r.class_id) and r.kept == (r.doc_id == r.class_id) for r in got)
    kept = minhash.drop_near(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_repeated_rows_and_null_ids(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(3, text), (3, text), (None, text), (9, "other words here")], "doc_id long, text string")
    got = minhash.near_classes(docs).collect()
    assert sorted((r.class_id, r.class_size) for r in got) == [(3, 3), (3, 3), (3, 3), (9, 1)]
    assert sorted(r.doc_id for r in minhash.drop_near(docs).collect()) == [3, 9]
    assert minhash.near_classes(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["long", "long not null"])
def test_whole_rows_are_exchanged_once(spark, kind):
    """The winners are joined and repeats of a row dropped after one exchange, whatever the schema says of nulls."""
    text, other = "a b c d e f g h", "other words that are here"
    rows = [(0, text), (3, text), (3, text), (9, other), (9, other)] + ([] if "not" in kind else [(None, text), (None, "alone")])
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = minhash.drop_near(docs)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = [tuple(r) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # One for the rows, one for the names of the winners.
    assert len(re.findall(r"Exchange hashpartitioning\(.*\bname#", plan)) == 2
    want = [(0, text), (9, other)] + ([] if "not" in kind else [(None, "alone")])
    assert sorted(got, key=str) == sorted(want, key=str)


def test_components(spark):
    draw = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 200)]
    pairs += [(draw.randrange(300, 400), draw.randrange(300, 400)) for _ in range(60)] + [(7, 7), (None, 4), (4, None)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    root = {i: i for p in pairs for i in p if i is not None}
    for a, b in pairs:
        if a is not None and b is not None:
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    got = {r.node: r.root for r in components(checkpointed(edges)).collect()}
    assert got == {k: v for k, v in root.items() if k != v}
