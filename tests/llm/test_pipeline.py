"""The pipeline against plain forms of its stages, and on odd tables."""

import hashlib
import itertools
import os

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from kycmill.llm import bpe, decontaminate, minhash
from kycmill.llm.common import stored, table
from kycmill.llm.queries import TOKENIZER

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


def plain(docs, benchmark):
    kept = {}
    for doc_id in sorted(docs):
        if any(c.isalpha() for c in docs[doc_id]):
            kept[docs[doc_id]] = doc_id
    left = sorted(kept.values())
    profile = {i: minhash.shingles(docs[i]) for i in left}
    root = {i: i for i in left}
    for i, j in itertools.combinations(left, 2):
        if root[i] != root[j] and minhash.similarity(*profile[i], *profile[j]) >= 0.8:
            low, high = sorted((root[i], root[j]))
            root = {k: low if v == high else v for k, v in root.items()}
    items = [decontaminate.normalised(t)[0].tobytes().strip(b"\0") for t in benchmark]
    clean = []
    for i in sorted(set(root.values())):
        code = decontaminate.normalised(docs[i])[0].tobytes()
        if not any(item in code for item in items):
            clean.append(i)
    return clean


def test_run_equals_plain_stages(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, FOLDER, "documents").collect()}
    benchmark = [r.text for r in table(spark, FOLDER, "benchmark").collect()]
    library = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    want = plain(docs, benchmark)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert sorted(got) == want and len(want) < len(docs)
    for i in want:
        ids = library.encode(docs[i], add_special_tokens=False).ids
        assert got[i].ids == ids
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_stages_on_odd_tables(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "minhash", "decontaminate", "bpe"]
    docs = table(spark, FOLDER, "documents")
    rows = docs.limit(5).collect()
    odd = spark.createDataFrame(
        [*rows, rows[0], (None, rows[1].text, None, None, None), (900, None, "en", None, None), (901, "", None, None, 0),
         (902, "12 34", "en", "x", 5), (903, rows[2].text * 40, "en", "x", 5)],
        docs.schema,
    )
    for found in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stored(stage(spark, found, FOLDER), f"test-{name}")
            assert found.columns == COLUMNS
            ids = [r.doc_id for r in found.select("doc_id").collect()]
            assert len(ids) == len(set(ids)) or name == "language_id"
        tokens = corpus_pipeline.STAGES[-1][1](spark, found, FOLDER)
        assert tokens.count() == found.count()


def test_language_learns_from_all_labelled_documents(spark, monkeypatch):
    """Model and usual surprise see every labelled training document, also beyond the sample of op5."""
    from kycmill.llm import language_id

    monkeypatch.setattr(language_id, "SAMPLE", 5)
    texts = [f"the cat number{'x' * (i % 7)} sat on the mat" for i in range(60)]
    rows = [(i, t, "en" if i % 10 else None, "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = docs.filter(~language_id.held_out(docs.doc_id) & docs.lang.isNotNull()).count()
    seen = {}
    learn, usual = language_id.learn_from, language_id.usual_of
    monkeypatch.setattr(language_id, "learn_from", lambda d, *a: (seen.update(learned=d.count()), learn(d, *a))[1])
    monkeypatch.setattr(language_id, "usual_of", lambda d: (seen.update(judged=d.count()), usual(d))[1])
    assert corpus_pipeline.language(spark, docs, FOLDER).count() == len(rows)
    assert seen == {"learned": want, "judged": want}


@pytest.mark.parametrize("n", [1, 2, 7, 8])
def test_usual_surprise_is_the_median(spark, n):
    import random
    import statistics

    from kycmill.llm import language_id

    draw = random.Random(n)
    rows = [("en", draw.choice([10, 20]), draw.uniform(20, 90)) for _ in range(n)] + [("und", 0, 0.0)]
    found = spark.createDataFrame(rows, "lang_pred string, letters bigint, surprise double")
    want = statistics.median(s / x for lang, x, s in rows if lang == "en")
    got = language_id.usual_of(found)
    assert set(got) == {"en"} and abs(got["en"] - want) <= language_id.STEP


def test_tokens_need_one_worker_a_task(spark):
    """Ids are written before they are decoded: two ways in one stage would keep two Python workers a task, and their tables."""
    rows = [(1, "The cat sat on the mat."), (2, None), (3, "naïve café"), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = corpus_pipeline.tokens(spark, docs, FOLDER)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    path = public_tokenizers.path(TOKENIZER)
    want = bpe.digests(bpe.decode(bpe.encode(docs, path), path), "ids")
    assert found.columns == want.columns and sorted(found.collect()) == sorted(want.collect()) and found.count() == 4
