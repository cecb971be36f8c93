"""Byte-pair encoding against the tokenizers library, and its parts against plain forms."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from kycmill.llm import bpe

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
TEXTS = [
    "", " ", "\n\t ", "The of thandre, ERTH!!! don't WE'LL 12345", "Éaux oiènt çà ÉCOLE école",
    "ΑΣ ΟΔΟΣ Σ", "İstanbul", "<|endoftext|>a<|startoftext|> <|endoftext", "a\x85b c​d", "日本語のテキスト 你好吗",
    "👩‍👩‍👧 emoji", "�\x00\x1c", "x" * 3000, "thethere" * 700, "!?" * 900, "ab cd " * 5000,
    "ꟋᲉ \U00010d50\U00016ea0 ՘x", "ñ" * 500 + "1" * 500,
]


def loaded(name):
    path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as file:
        return bpe.Tokenizer(file.read()), Library.from_file(path)


@pytest.mark.parametrize("name", FILES)
def test_ids_and_text_as_the_library(name):
    own, library = loaded(name)
    decoder = bpe.Decoder(own)
    draw = random.Random(3)
    letters = "abcdeinorst ETS,.'1é\n"
    texts = TEXTS + ["".join(draw.choices(letters, k=draw.randrange(1, 400))) for _ in range(300)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        ids = own.encode(text)
        assert ids.tolist() == want, text[:50]
        assert decoder.decode(ids) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("name", FILES)
def test_long_texts_are_cut_at_white_space_only(name):
    own, library = loaded(name)
    before = ("ab cd " * bpe.PIECE)[: bpe.PIECE - 1]
    for odd in "\x1c\x1d\x1e\x1f\x85\u00a0\u2028\u3000":
        text = f"{before}!{odd}! ab ! ab"
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(odd)


def test_every_character_as_the_library():
    own, library = loaded(FILES[0])
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b {chr(c)} " for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text).tolist() == want.ids


@pytest.mark.parametrize("name", FILES)
def test_streamed_words_equal_whole_words(name):
    own, _ = loaded(name)
    draw = random.Random(4)
    for _ in range(40):
        word = "".join(draw.choices("thereandonis", k=draw.randrange(65, 4000)))
        stream = bpe.Transducer(own)
        tokens, i, held = [], 0, 0
        while i < len(word):
            n = draw.randrange(1, 300)
            tokens += stream.feed(word[i : i + n].encode())
            held = max(held, len(stream.waiting))
            i += n
        tokens += stream.finish()
        whole = [own.inside[b] for b in word[:-1].encode()] + [own.at_end[ord(word[-1])]]
        assert tokens == own.merged(whole)
        assert held <= own.lookahead + stream.step


def test_every_new_word_goes_through_the_transducer():
    own, _ = loaded(FILES[0])
    fed, feed = [], own.stream.feed
    own.stream.feed = lambda piece: fed.append(bytes(piece)) or feed(piece)
    text = "the cat and " + "x" * 200 + " the cat " + "x" * 200
    own.encode(text)
    assert fed == [b"the", b"cat", b"and", b"x" * 200, b"x" * 200]


def test_remembered_words_are_bounded(monkeypatch):
    own, library = loaded(FILES[0])
    monkeypatch.setattr(bpe, "MEMORY_BYTES", 20_000)
    words = [f"w{i % 97}{'abc' * (i % 5)}" for i in range(3000)]
    assert own.encode(" ".join(words)).tolist() == library.encode(" ".join(words), add_special_tokens=False).ids
    assert own.memory.size <= 20_000 and len(own.memory) + len(own.memory.old) < 200


def test_lookahead_of_a_chain():
    # ab is undone by bc, bc by cd: three symbols decide.
    assert bpe.sufficient_lookahead([("c", "d"), ("b", "c"), ("a", "b")], "") == 3
    assert bpe.sufficient_lookahead([], "") == 0


def test_decoder_keeps_unfinished_characters():
    own, _ = loaded(FILES[1])
    decoder = bpe.Decoder(own, as_text=True)
    ids = own.encode("añ👩 ok").tolist()
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == "añ👩 ok"
    assert decoder.feed([own.vocab["ð"]]) == "" and decoder.finish() == "�"


def test_rows(spark):
    rows = [(1, "Hello there", "x"), (2, None, None), (None, "Hello there", "x"), (1, "Hello there", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = public_tokenizers.path(FILES[0])
    got = bpe.digests(bpe.decode(bpe.encode(docs, path), path)).collect()
    ids = loaded(FILES[0])[1].encode("Hello there", add_special_tokens=False).ids
    digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256 == digest) for r in got) == [
        (0, 2, True), (1, 2, True), (1, 2, True), (2, 0, False),
    ]
    assert bpe.encode(docs.limit(0), path).count() == 0
