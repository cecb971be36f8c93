"""Vector search and clustering against plain forms, with odd rows and groups of copies."""

import hashlib
import math

import numpy as np
import pytest

from kycmill.llm import centroid_cluster, hamming_index

SCHEMA = "vec_id long, embedding array<float>, v string, dots string, block string, score string"


def frame(spark, rows, kind="float"):
    rows = [(i, None if e is None else [None if x is None else float(x) for x in e], "a", "b", "c", "d") for i, e in rows]
    return spark.createDataFrame(rows, SCHEMA.replace("float", kind)).repartition(3)


def odd_rows(size):
    return [
        (1000, None), (1001, []), (1002, [0.0] * size), (1003, [1.0] * (size - 1) + [None]), (1004, [1.0] * (size - 1) + [math.nan]),
        (1050, [math.inf] + [1.0] * (size - 1)), (1100, None), (None, [1.0] * size),
    ]


def plain_nearest(rows, k, every):
    good = [(i, np.asarray(e, float)) for i, e in rows if i is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    out = []
    for place, (i, q) in enumerate(good):
        if i % every:
            continue
        near = []
        for other, (j, c) in enumerate(good):
            if j != i and len(c) == len(q):
                near.append((-round(float(q @ c / math.sqrt(float(q @ q)) / math.sqrt(float(c @ c))), 12), j))
        out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(sorted(near)[:k])]
    return out


@pytest.mark.parametrize("block_rows", [128, 16384])
def test_nearest(spark, block_rows):
    draw = np.random.default_rng(5)
    rows = [(i, draw.standard_normal(16).astype(np.float32)) for i in range(600)]
    hub = draw.standard_normal(16)
    rows += [(700 + i, (hub + draw.standard_normal(16) * 0.01).astype(np.float32)) for i in range(300)]
    rows += [(2000 + i, [0.5, -1.0, 2.0]) for i in range(40)] + [(3000, [1.0, 2.0])]
    rows = [(i, np.asarray(e).tolist()) for i, e in rows] + odd_rows(16)
    docs = frame(spark, rows)
    got = hamming_index.nearest(docs, every=10, block_rows=block_rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = {}
    for i, rank, j, s in plain_nearest(rows, 5, 10):
        want.setdefault(i, []).append((rank, j, s))
    assert found.keys() == want.keys()
    hits = 0
    for i, best in want.items():
        own = sorted(found[i])
        assert [x[0] for x in own] == [x[0] for x in best]
        assert own == sorted(own, key=lambda x: (-round(x[2], 12), x[1]))
        hits += len({x[1] for x in own} & {x[1] for x in best})
    assert hits >= 0.9 * sum(map(len, want.values()))
    # All copies of one vector: exact ties, smallest ids first.
    assert [x[1] for x in sorted(found[2000])] == [2001, 2002, 2003, 2004, 2005]
    assert [x[1] for x in sorted(found[2030])] == [2000, 2001, 2002, 2003, 2004]


def test_search_covers_radius():
    """Every code within the radius is met: probes against all distances."""
    draw = np.random.default_rng(1)
    vectors = hamming_index.unit_rows(draw.standard_normal((500, 8)))
    rotation, slack = hamming_index.learn_rotation(vectors)
    codes = hamming_index.codes_of(vectors, rotation)
    block = hamming_index.Block(np.arange(500), vectors, codes, slack)
    code, met = codes[7], set()
    for step in range(hamming_index.PARTS * 3):
        away, part = divmod(step, hamming_index.PARTS)
        met.update(block.probe(part, int(code[part]), away).tolist())
        assert set(np.flatnonzero(hamming_index.distances(codes, code) <= step).tolist()) <= met


def test_nearest_few_rows(spark):
    docs = frame(spark, [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (50, [3e38, 3e38])])
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in hamming_index.nearest(docs).collect())
    assert got == [(0, 1, 50, 0.707107), (0, 2, 1, -1.0), (50, 1, 0, 0.707107), (50, 2, 1, -0.707107)]
    tiny = frame(spark, [(0, [1e-200, 0.0]), (1, [1e-200, 1e-200]), (2, [1e200, 0.0])], "double")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in hamming_index.nearest(tiny).collect())
    assert got == [(0, 1, 2, 1.0), (0, 2, 1, 0.707107)]
    assert hamming_index.nearest(docs.limit(0)).count() == 0
    assert hamming_index.nearest(frame(spark, odd_rows(4)[:5])).count() == 0


def plain_clusters(rows, k, rounds, size, scale):
    good = [
        (i, [math.floor(float(np.float32(x)) * scale) for x in e])
        for i, e in rows
        if e and len(e) == size and None not in e and np.isfinite(e).all()
    ]
    order = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        out = []
        for i, v in good:
            out.append((i, *min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))))
        return out

    for _ in range(rounds):
        own = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, _, c) in zip(good, own) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign()
    inertia = sum(d for _, d, _ in own)
    each = {n: sum(d for _, d, c in own if c == n) for n in range(len(centroids))}
    return [(i, c, d, each[c], inertia, centroids[c]) for i, d, c in own]


@pytest.mark.parametrize("k,rounds", [(5, 4), (16, 3), (3, 0)])
def test_clusters(spark, k, rounds):
    draw = np.random.default_rng(k)
    rows = [(i, draw.standard_normal(6).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, [0.25, -0.25, 0.0, 1.0, -1.0, 0.015625]) for i in range(60)] + [(7, rows[7][1]), (7, rows[8][1])]
    rows += odd_rows(6) + [(300, [1.0] * 5)]
    docs = frame(spark, rows)
    got = centroid_cluster.cluster_vectors(docs, k, rounds, 6, 64)
    found = [(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid) for r in got.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:5])
    assert sorted(found, key=key) == sorted(plain_clusters(rows, k, rounds, 6, 64), key=key)


def test_clusters_small_and_large(spark):
    docs = frame(spark, [(1, [1.0, 2.0]), (2, [1e30, -1e30])])
    got = {r.vec_id: r for r in centroid_cluster.cluster_vectors(docs, 16, 3, 2).collect()}
    assert len({r.cluster for r in got.values()}) == 2 and {r.inertia for r in got.values()} == {0}
    assert sorted(got[2].centroid) == [-centroid_cluster.LIMIT, centroid_cluster.LIMIT]
    digest = centroid_cluster.centroid_digest
    one = centroid_cluster.cluster_vectors(docs, 16, 3, 2).filter("vec_id = 1").select(digest("centroid").alias("d")).first().d
    assert one == centroid_cluster.plain_digest([64, 128])
    assert centroid_cluster.cluster_vectors(docs.limit(0), 16, 3, 2).count() == 0
