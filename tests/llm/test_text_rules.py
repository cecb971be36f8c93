"""Chat format, licences, URLs, languages and benchmark leaks on small tables."""

import functools
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kycmill.llm import chat_format, decontaminate, language_id, license_scan, url_filter
from kycmill.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def test_chats(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "BLOCK", 3)
    monkeypatch.setattr(chat_format, "STRETCHES", 2)
    draw = random.Random(1)
    bits = ["</turn>", "<turn>", "<+turn>", "<\\/turn>", "\\", "\n", "a", "é👩", "### Assistant:", "<", "turn>", "", "<\\\\turn>"]
    rows = [
        (c, t, draw.choice(["user", "assistant", "system", "odd\\role\n<turn>"]), "".join(draw.choices(bits, k=draw.randrange(9))), "x")
        for c in range(25)
        for t in range(draw.randrange(1, 14))
    ]
    rows += [(90, 0, "user", None, "x"), (90, 1, None, "t", "x"), (None, 0, "assistant", "", "x"), (91, None, "assistant", "b", "x")]
    rows += [(91, 5, "assistant", "a", "x"), (91, 5, "assistant", "a", "x"), (92, 0, "assistant", "long " * 40000, "x")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    formatted = chat_format.format_chats(chats)
    got = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        turns = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns)
        loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = formatted.filter("conv_id = 91").first()
    assert one.formatted == "<turn>assistant\nb<+turn>a<+turn>a</turn>\n"
    assert chat_format.read_back(chat_format.format_chats(chats.limit(0))).count() == 0


def slow_base(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    places = [
        (i, label)
        for label, phrase in license_scan.BASE
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_licenses(spark):
    notice = dict((label, text) for label, text in license_scan.NOTICES)
    texts = [
        "Licensed under CC-BY 4.0. CC by, cc BY", "ALL rights\nreserved all rights reserved", "", None, "cc", "by cc",
        "GNU General Public License general public", notice["bsd"].upper(), "all rights " * 3000 + "reserved",
        "permission is hereby granted free of any charge to any person obtaining a copy of this software",
        "Released under the MIT License.", "Été ÀLL rights reserved K İ cc by", "general general public license license",
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == slow_base(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1
    assert got[7].labels == "bsd" and got[9].labels == "mit" and got[10].labels == "mit" and got[2].score == 0
    twice = docs.unionByName(docs)
    assert license_scan.scan_licenses(twice).count() == 2 * len(texts)
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


def test_licenses_on_driver_tables(spark):
    docs = table(spark, FOLDER, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in license_scan.scan_licenses(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == slow_base(texts[r.doc_id])


def test_licenses_with_one_word_edited(spark):
    rows = []
    for label, notice in license_scan.NOTICES:
        words = notice.split()
        for i in range(len(words)):
            edited = [words[:i] + words[i + 1 :], [*words[:i], "zebra", *words[i + 1 :]]]
            edited += [[*words[:i], *["zebra"] * n, *words[i:]] for n in (1, 3) if i]
            rows += [(label, "so it was said " + " ".join(x) + " and so on") for x in edited]
    texts = [(i, t) for i, (_, t) in enumerate(rows)]
    texts.append((len(rows), "the zebra license of the free world may be used by any person under the sun"))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    for i, (label, text) in enumerate(rows):
        assert label in got[i].labels.split(","), text
        assert any(f.label == label and 4 <= f.first <= 8 for f in got[i].findings), text
    assert got[len(rows)].labels == ""


def fewest_edits(own, words):
    """Edits of the best place anywhere in the words, by plain recursion over both sequences."""
    @functools.cache
    def ends(i, j):
        """Fewest edits with which the first i own words end just before word j."""
        if i == 0:
            return 0
        found = [ends(i - 1, j) + 1]
        if j:
            found.append(ends(i - 1, j - 1) + (own[i - 1] != words[j - 1]))
            # Up to three words put in before the next own word are one edit.
            if i < len(own):
                found += [ends(i, j - back) + 1 for back in (1, 2, 3) if back <= j]
        return min(found)

    return min(ends(len(own), j) for j in range(len(words) + 1))


def test_alignment_equals_plain_recursion():
    draw = random.Random(3)
    for _ in range(300):
        own = draw.choices("abcd", k=draw.randrange(1, 8))
        words = draw.choices("abcdx", k=draw.randrange(0, 14))
        most = draw.randrange(0, 4)
        coded = [np.array([ord(c) for c in x], np.int64) for x in (own, words)]
        places = license_scan.word_places(*coded, most)
        least = fewest_edits(own, words)
        assert min((edits for _, _, edits in places), default=most + 1) == min(least, most + 1)
        for first, past, edits in places:
            assert 0 <= first <= past <= len(words)
            assert fewest_edits(own, words[first:past]) == edits


def test_notices_equal_alignment_of_whole_texts(spark):
    """What voting leaves for the alignment is all there is: the same labels as every template over every whole text."""
    draw = random.Random(5)
    known = license_scan.templates()
    vocabulary = sorted({w for t in known for w in t.words})
    texts = []
    for t in known:
        for share in (0, 0.1, 0.19, 0.3):
            words = [w for w in t.words for w in draw.choice([[], ["zebra"], [w, "of", "the"]] if draw.random() < share else [[w]])]
            texts.append(" ".join(draw.choices(vocabulary, k=40) + words + draw.choices(vocabulary, k=20)))
    texts += [texts[5], texts[5].upper() + " (c)", " ".join(" ".join(t.words) for t in known)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    aligner = license_scan.Aligner(known)
    found = 0
    for i, text in enumerate(texts):
        n = len(license_scan.words_of(text))
        every = aligner.find(text, [{"template": t.number, "low": 0, "high": n} for t in known])
        assert got[i].labels == ",".join(sorted({aligner.known[t].label for t, *_ in every})), text
        found += len(every)
    assert found > len(known) and got[len(texts) - 3].findings == got[5].findings


def test_whole_licences(spark):
    draw = random.Random(7)
    label, text = license_scan.LICENCES[0]
    words = text.split()
    little = [w for w in words if draw.random() > 0.12]
    much = [w if draw.random() > 0.5 else "zebra" for w in words]
    clean = "the software of the author and the rights of the users in the world may be used by any person"
    rows = [" ".join(little), " ".join(much[30:]), clean, "intro " * 500 + text + " outro" * 500]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    whole = [f for f in got[3].findings if f.label == label and f.past - f.first > 100]
    assert [(f.first, f.cover) for f in whole] == [(500, 1.0)]
    assert any(f.label == label and f.past - f.first > 100 for f in got[0].findings)
    assert got[1].labels == "" and got[2].labels == ""


def test_urls(spark):
    def page(url, link=None, refresh=None):
        head = f'<LINK rel="canonical" href="{link}">' if link else ""
        return url, head + (f"<meta http-equiv='refresh' content='0; url={refresh}'>" if refresh else "")

    rows = [
        page("https://A.Example.NET/en/x", None), page("http://b.net/q?x://y"), page("http://c.org", "http://b.net/q?x://y"),
        page("http://d.org/1", None, "//c.org"), page("http://e.org/1", "/2"), page("http://e.org/2", "http://f.org/fr/a"),
        page("http://e.org/3", "http://e.org/2"), page("http://e.org/4", "http://bad.net/"), page("http://e.org/2#top", "http://bad.net/"),
        page("noscheme.net/"), page(None), page("http://net"), page("http://example.com/de/"), page("://x.net/y"),
    ]
    pages = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("b.net", "/q", "net/", "block")
    assert got[2] == ("c.org", "", None, "block") and got[3] == ("d.org", "/1", None, "block")
    # e.org pages reach an allowed and a blocked page: allow comes first.
    assert {got[i][3] for i in (4, 5, 6, 7, 8)} == {"allow"}
    assert got[9] == ("", "", None, "allow") and got[10] == ("", "", None, "allow")
    assert got[11] == ("net", "", None, "allow") and got[12][2:] == ("example.com/de/", "block")
    assert got[13] == ("x.net", "/y", "net/", "block")
    more = spark.createDataFrame([("http://new.org/", "http://b.net/q?x://y"), ("http://c.org", "http://new.org/")], "a string, b string")
    assert {r.page_id: r.verdict for r in url_filter.url_filter(pages, edges=more).collect()}[2] == "block"
    assert url_filter.url_filter(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "target,want",
    [
        ("page2.html", "http://a.org/x/page2.html"), ("../y", "http://a.org/y"), ("../../../y/./z/..", "http://a.org/y/"),
        ("?id=3", "http://a.org/x/p?id=3"), ("?a=2&amp;b=x", "http://a.org/x/p?a=2&b=x"), ("/q?to=http://bad.net/", "http://a.org/q?to=http://bad.net/"),
        ("//c.org/", "http://c.org/"), ("https://c.org/a/../b?x=../y", "https://c.org/b?x=../y"), ("#top", "http://a.org/x/p?q=1"),
        ("mailto:x@b.net", None), ("q&#63;v=1", "http://a.org/x/q?v=1"), ("&amp;#47;z", "http://a.org/x/&"), ("./", "http://a.org/x/"),
    ],
)
def test_targets(target, want):
    assert url_filter.resolved("http://a.org/x/p?q=1", target) == want
    assert url_filter.resolved("http://a.org", "p2") == "http://a.org/p2" and url_filter.resolved(None, "p2") is None


def test_aliases_of_every_form(spark):
    canonical = '<link rel="canonical" href="{}">'.format
    refresh = "<meta http-equiv=refresh content=\"0; url={}\">".format
    rows = [
        ("http://a.example/x/1", canonical("page2.html")), ("http://a.example/x/page2.html", refresh("http://bad.net/")),
        ("http://b.example/x/y/1", refresh("../2")), ("http://b.example/x/2", canonical("http://bad.net/")),
        ("http://c.example/1", canonical("?page=2&amp;ref=x")), ("http://c.example/1?page=2&ref=x", canonical("http://bad.net/")),
        ("http://d.example/1", canonical("/good") + canonical("http://bad.net/")), ("http://e.example/1", refresh("/good") + refresh("http://bad.net/")),
        ("http://f.example/1", canonical("/out?to=http://bad.net/")), ("http://g.example/1", "<link href='http://bad.net/' rel=canonical>"),
        ("http://h.example/1", canonical("mailto:x@bad.net")), ("http://i.example/1", None),
    ]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.url_filter(pages).collect()}
    assert [got[i] for i in range(len(rows))] == ["block"] * 8 + ["allow", "block", "allow", "allow"]


def slow_sum(word, model):
    def total(rest, language):
        if not rest:
            return 1.0
        out = 0.0
        for j in range(1, len(rest) + 1):
            row = model.pieces.get(rest[:j], language_id._UNKNOWN if j == 1 else None)
            if row is not None:
                out += model.p[row, language] * total(rest[j:], language)
        return out

    return [total(language_id.START + word, k) for k in range(len(model.languages))]


@pytest.fixture(scope="module")
def model(spark):
    return language_id.learn(table(spark, FOLDER, "documents"), public_tokenizers.path("piece_bpe_32k.model"), sample=30)


def test_forward_sums_all_segmentations(model):
    import numpy as np

    words = ["the", "elle", "ungßx", "日本", "a"]
    want = [slow_sum(w, model) for w in words]
    assert np.allclose(np.exp(language_id.word_scores(words, model)), want)
    assert np.allclose(model.p.sum(0), 1)


def test_held_out_accuracy(spark, model):
    docs = table(spark, FOLDER, "documents")
    found = language_id.predict(docs, model).filter(language_id.held_out(F.col("row.doc_id")))
    right, n = found.agg(F.sum((F.col("row.lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 40 and right / n > 0.97


def test_undetermined(spark, model):
    rows = [(1, None, "en", "x"), (2, "", "en", "x"), (3, "12 ½ !! _", None, "x"), (4, "the of thing and", None, "x"), (None, "the " * 50000, None, "x"), (4, "the of thing and", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = [(r.row.doc_id, r.lang_pred, round(r.score)) for r in language_id.predict(docs, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "und", 0), (2, "und", 0), (3, "und", 0), (4, "en", 1), (4, "en", 1), (None, "en", 1)], key=str)
    kept = language_id.drop_undetermined(docs, model)
    assert kept.columns == docs.columns and kept.count() == 3
    assert language_id.predict(docs.limit(0), model).count() == 0
    nothing = language_id.learn(docs.limit(0), public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}


def test_junk_and_far_languages_are_dropped(spark, model):
    draw = random.Random(4)
    letters = [" ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randrange(2, 9))) for _ in range(n)) for n in (30, 300)]
    junk = [*letters, "日本語の文章はここにあります" * 5, "мой дядя самых честных правил когда не в шутку занемог", "qzx" * 5000]
    table_docs = table(spark, FOLDER, "documents")
    usual = language_id.usual_surprise(language_id.training_sample(table_docs, 30), model)
    assert sorted(usual) == model.languages and all(1 < x < 4 for x in usual.values())
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(junk)] + [(90, "a", "x"), (91, "zq", "x")], "doc_id long, text string, surprise string")
    assert [r.doc_id for r in language_id.drop_undetermined(docs, model, usual).collect()] == [90, 91]
    clean = table_docs.filter(F.col("text").rlike(r"\p{L}"))
    assert language_id.drop_undetermined(table_docs, model, usual).count() == language_id.drop_undetermined(table_docs, model).count()
    assert language_id.drop_undetermined(table_docs, model, usual).count() >= 0.99 * clean.count()
    assert language_id.drop_undetermined(docs.limit(0), model, usual).count() == 0


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_are_those_of_full_alignment(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 700)
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randrange(2, 9))) for _ in range(500)]
    items = [" ".join(draw.choices(words, k=draw.randrange(6, 45))) for _ in range(12)]
    texts = []
    for _ in range(60):
        piece = list(draw.choice(items))
        for _ in range(draw.randrange(0, 9)):
            at = draw.randrange(len(piece))
            piece[at : at + draw.randrange(2)] = draw.choice(["", "q", "Zz"])
        around = [" ".join(draw.choices(words, k=draw.randrange(0, 150))) for _ in range(2)]
        texts.append(around[0] + " " + "".join(piece).upper().replace(" ", " -- ") + ". " + around[1])
    texts += [None, "", "short", items[0][:60], items[0] * 30]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(99, None), (98, "tiny"), (0, items[0])], "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, leaks string")
    for index_chars in (10**6, 300):
        found = decontaminate.find_leaks(docs, bench, index_chars=index_chars).collect()
        got = {r.row.doc_id: {x.item_id for x in r.leaks} for r in found}
        for i, text in enumerate(texts):
            code = decontaminate.normalised(text or "")[0].tolist()
            want = {
                item
                for item, t in enumerate(items)
                if any(edits(s.code.tolist(), code) <= s.n_edits for s in decontaminate.segments(item, t))
            }
            assert got[i] == want, i
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not x for x in got.values())
    assert decontaminate.drop_leaks(docs, bench.limit(0)).count() == len(texts)
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_every_stretch_of_an_item_is_found():
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randrange(2, 9))) for _ in range(500)]
    items = [" ".join(draw.choices(words, k=k)) for k in (40, 65, 22)]
    index = decontaminate.Index(enumerate(items))
    size = decontaminate.SEGMENT
    for number, item in enumerate(items):
        code = decontaminate.normalised(item)[0]
        for start in range(len(code) - size + 1):
            around = [" ".join(draw.choices(words, k=30)) for _ in range(2)]
            part = list(item[start : start + size])
            for spot in draw.sample(range(0, size, 4), start % 6):
                part[spot] = "z"
            found = decontaminate.leaks(around[0] + " " + "".join(part) + " " + around[1], index)
            assert number in {x["item_id"] for x in found}, (number, start)
            short = item[start : start + size - 10]
            assert not decontaminate.leaks(around[0] + "zzzzz" + short + "zzzzz" + around[1], index)


@pytest.mark.parametrize("pairs", [2000, 40_000, 1 << 20])
def test_leaks_in_repetitive_texts(monkeypatch, pairs):
    """Runs of one letter share q-grams at every place; results do not depend on how many are held at once."""
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    monkeypatch.setattr(decontaminate, "PART", 160)
    items = [(0, "a" * 150), (1, "0 0 0 " * 20), (2, "a" * 60 + "b" * 90), (3, "a" * 50 + " plain words here " * 5), (4, "c" * 400)]
    index = decontaminate.Index(items)
    texts = ["a" * 600, "0 " * 200, "x" + "a" * 90 + "b" * 40 + "y", "a b " * 60, "a" * 99 + "zz", "c" * 130 + "a" * 57 + "b" * 60]
    got = [[x["item_id"] for x in decontaminate.leaks(t, index)] for t in texts]
    for text, found in zip(texts, got):
        code = decontaminate.normalised(text)[0].tolist()
        want = [i for i, t in items if any(edits(s.code.tolist(), code) <= s.n_edits for s in decontaminate.segments(i, t))]
        assert found == want, text[:20]


def test_leaks_bounded_memory():
    """A megabyte of one letter against an item of it."""
    import tracemalloc

    index = decontaminate.Index([(0, "a" * 300), (1, "b" * 150 + "a" * 150)])
    decontaminate.normalised("x")
    tracemalloc.start()
    found = decontaminate.leaks("a" * (1 << 20), index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x["item_id"] for x in found] == [0, 1] and peak < 400e6, peak


def test_leaks_between_other_symbols():
    """Symbols of any script are blanks; letters of any script count as they are."""
    item = "the quick brown fox jumps over the lazy dog and runs far away from it all day long until night falls"
    index = decontaminate.Index([(0, item), (1, "漢字かな" * 30)])
    assert [x["item_id"] for x in decontaminate.leaks(item.replace(" ", "，"), index)] == [0]
    assert [x["item_id"] for x in decontaminate.leaks(item.replace(" ", " 😀×"), index)] == [0]
    assert [x["item_id"] for x in decontaminate.leaks("漢字かな" * 30, index)] == [1]
    assert decontaminate.leaks("漢字かば" * 30, index) == []
