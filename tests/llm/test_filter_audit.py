"""Filter orders against one plain run per order."""

import itertools
import random
import re

from kycmill.llm import filter_audit

DOCS = "doc_id long, text string, source string, mask string, part string, n string, digest string"
LABELS = "doc_id long, quality int, toxic int, part string, n string"


def plain(docs, labels):
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t, _ in docs]
    rows = []
    for (i, t, s), w in zip(docs, words):
        t = t or ""
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (o or "") == t for j, o, _ in docs),
        }
        good = i is not None and any(j == i and q == 1 for j, q, _ in labels)
        toxic = i is not None and any(j == i and x == 1 for j, _, x in labels)
        rows.append((s or "", {f for f in fails if fails[f]}, good, toxic))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            whole = list(left)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                late = sum(f in r[1] and bool(r[1] & set(order[: step - 1])) for r in whole)
                alone = sum(r[1] == {f} for r in whole)
                out[part, "".join(order), step] = [len(left), len(gone), late, alone, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_every_order(spark):
    draw = random.Random(3)
    pool = ["a b c", "A B C", "a # b", "", None, "w " * 250, " ".join(f"w{i}" for i in range(220)), "x" * 300 + " Y", "é b\x1cc"]
    pool += [" ".join(draw.choices(["aa", "bb", "Cc", "d|"] + [f"v{i}" for i in range(300)], k=240)) for _ in range(6)]
    docs = [(i, draw.choice(pool), draw.choice(["s", "t", None, ""])) for i in range(150)]
    docs += [(200 + i, "hot text", "s") for i in range(60)] + [(None, "hot text", "t"), (None, "alone", "t"), (5, docs[5][1], "t"), (5, docs[5][1], "t")]
    labels = [(i, draw.randrange(2), draw.randrange(2)) for i in range(0, 220, 2)] + [(4, 1, None), (6, None, 1), (None, 1, 1), (9999, 1, 1), (200, 1, 1)]
    d = spark.createDataFrame([(*r, "m", "p", "n", "g") for r in docs], DOCS).repartition(3)
    m = spark.createDataFrame([(*r, "p", "n") for r in labels], LABELS).repartition(2)
    got = filter_audit.audit_filters(d, m)
    found = {
        (r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
        for r in got.collect()
    }
    assert found == plain(docs, labels)
    assert filter_audit.audit_filters(d.limit(0), m).count() == 0
    assert filter_audit.audit_filters(d.limit(3), m.limit(0)).filter("good_lost > 0 OR toxic_lost > 0").count() == 0


def test_recursion_is_fixed(spark):
    """325 prefixes with each of 32 masks, whatever the tables hold."""
    assert filter_audit.walk(spark).count() == 325 * 32
