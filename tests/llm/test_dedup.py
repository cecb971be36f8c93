"""Exact, substring and line dedup against plain forms, with hot groups and odd rows."""

import hashlib
import random

import pytest

from kycmill.llm import exact_dedup, line_dedup, substring_dedup

SCHEMA = "doc_id long, text string, digest string, id string, keep_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_exact(spark):
    rows = [(i, "hot") for i in range(40)] + [(100, "a"), (101, "a"), (102, ""), (103, None), (104, "A"), (None, "a")]
    docs = frame(spark, rows)
    for support in (0.5, 0.001):
        got = {(r.doc_id, r.digest): r for r in exact_dedup.exact_groups(docs, support=support).collect()}
        assert len(got) == len(rows)
        for doc_id, text in rows:
            same = [i for i, t in rows if (t or "") == (text or "")]
            r = got[doc_id, sha(text or "")]
            keep = max(i for i in same if i is not None)
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(same), doc_id == keep)
        kept = exact_dedup.drop_exact(docs, support=support)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == [39, 101, 103, 104]


def test_exact_ties(spark):
    docs = frame(spark, [(5, "t"), (5, "t"), (4, "t"), (None, "n"), (None, "n")])
    for support in (0.3, 0.001):
        got = exact_dedup.exact_groups(docs, support=support)
        assert sorted((r.doc_id or 0, r.kept) for r in got.collect()) == [
            (0, False), (0, True), (4, False), (5, False), (5, True),
        ]
        assert exact_dedup.drop_exact(docs, support=support).count() == 2
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0
    assert exact_dedup.drop_exact(docs.limit(0)).columns == docs.columns


def slow_substring(rows, length):
    words = [[w for w in substring_split(t or "")] for _, t in rows]
    where = {}
    for (i, _), found in zip(rows, words):
        for s in range(len(found) - length + 1):
            key = tuple(found[s : s + length])
            where[key] = min(where.get(key, 1 << 63), (1 << 63) - 1 if i is None else i)
    out = []
    for (i, _), found in zip(rows, words):
        own, gone = (1 << 63) - 1 if i is None else i, set()
        for s in range(len(found) - length + 1):
            if where[tuple(found[s : s + length])] < own:
                gone.update(range(s, s + length))
        out.append((i, len(found), len(gone), " ".join(w for k, w in enumerate(found) if k not in gone)))
    return out


def substring_split(text):
    for gap in "\t\n\v\f\r":
        text = text.replace(gap, " ")
    return [w for w in text.split(" ") if w]


def key_of(row):
    return tuple((v is None, v or 0 if not isinstance(v, str) else v) for v in row)


@pytest.mark.parametrize("length,seed", [(6, 2), (10, 10), (50, 8)])
def test_substring(spark, length, seed):
    draw = random.Random(length)
    words = [f"w{i}" for i in range(30)] + ["é", "x\x1cy", "\u00a0"]
    passage = draw.choices(words, k=length + 7)
    rows = []
    for i in range(40):
        text = draw.choices(words, k=draw.randrange(0, 40))
        for _ in range(draw.randrange(3)):
            cut = draw.randrange(0, 6)
            text += passage[cut : len(passage) - draw.randrange(0, 6)] + draw.choices(words, k=draw.randrange(5))
        rows.append((i, draw.choice(" \t\n").join(text)))
    rows += [(50, rows[3][1]), (51, None), (52, ""), (53, "w1 " * 4000), (54, "w1 " * 3000), (None, rows[3][1]), (None, rows[5][1]), (50, rows[3][1])]
    docs = frame(spark, rows)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.drop_repeats(docs, length, seed).collect()]
    assert sorted(got, key=key_of) == sorted(slow_substring(rows, length), key=key_of)


def test_substring_passages(spark):
    base = " ".join(f"a{i}" for i in range(60))
    docs = frame(spark, [(1, base), (2, f"x y {base} z")])
    got = {r.doc_id: r for r in substring_dedup.drop_repeats(docs).collect()}
    assert got[1].passages == [] and [tuple(p) for p in got[2].passages] == [(2, 62)]
    assert got[2].kept_text == "x y z"
    assert substring_dedup.drop_repeats(docs.limit(0)).count() == 0


def slow_lines(rows, chars):
    seen, out = set(), []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, text in order:
        lines = (text or "").split("\n")
        filled = [k for k, line in enumerate(lines) if line.strip(" \t\r\v\f")]
        gone = set()
        for s in range(len(filled)):
            for e in range(s + 1, len(filled) + 1):
                key = tuple(lines[k] for k in filled[s:e])
                if sum(map(len, key)) >= chars:
                    if key in seen:
                        gone.update(filled[s:e])
                    seen.add(key)
        out.append((i, len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def lines_of(docs, chars):
    return [(r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.drop_repeated_lines(docs, chars).collect()]


@pytest.mark.parametrize("chars", [1, 4, 9, 20])
def test_lines(spark, chars):
    draw = random.Random(chars)
    pool = ["a", "b", "ccc", "dd", "", " \t", "line é", "a line of more than twenty"]
    rows = [(i, "\n".join(draw.choices(pool, k=draw.randrange(14)))) for i in range(60)]
    rows += [(100, None), (101, "a\na\na\na\na\na"), (102, "\n\n"), (103, "x\r\ny\r\nz" * 30), (None, "b\nccc\nd\na")]
    docs = frame(spark, rows)
    assert sorted(lines_of(docs, chars), key=key_of) == sorted(slow_lines(rows, chars), key=key_of)
    assert line_dedup.drop_repeated_lines(docs.limit(0), chars).count() == 0


def test_single_lines_and_repeated_rows(spark):
    rows = [(1, "one long line repeated"), (2, "one long line repeated"), (3, "short"), (4, "short")]
    rows += [(5, "first line of this text\n\nsecond")] * 3 + [(None, "x"), (None, "x")]
    assert sorted(lines_of(frame(spark, rows), 20), key=key_of) == sorted(slow_lines(rows, 20), key=key_of)
    assert sorted((r[0], r[2]) for r in lines_of(frame(spark, rows[4:7]), 20)) == [(5, 0), (5, 2), (5, 2)]
