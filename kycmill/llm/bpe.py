"""Byte-pair encoding as a streaming transducer with bounded lookahead, and incremental decoding.

Encoding. A text is cut where white space stands and into words by the tokenizer's pattern. Merges never
cross words. Every word that is not remembered streams through ``Transducer``: from the merge list alone a
number of symbols is computed that is enough to look ahead, and a token is put out as soon as so many symbols
after it have been read (a short word ends before any is due). Memory is the lookahead plus one piece, whatever
the word's length, plus the remembered words, which are bounded in bytes.

Why the lookahead suffices. Take merges in the order of the list. Whether a token u ends at a place after
merge r depends on the text up to ``reach[u]`` symbols further: to be sure that merge (u, v) does not take
u away, v must be known to stand behind it, so the reach of u grows to len(v) + reach[v]; a new token uv
ends where v does and has at least the reach of v. What stands before a token's start cannot depend on what
comes after it, as long as the boundary lasts. The largest reach after the whole list is sufficient.

Decoding. ``Decoder`` takes ids piece by piece and keeps only the bytes of an unfinished character. A file
that names no decoder is decoded as the tokenizers library does, to its tokens with a blank between;
``as_text`` gives the text itself.

Defined cases: null text counts as empty and has no ids; special tokens in a text are their ids; repeated
rows are encoded alike; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, small

#: Characters cut from a text at a time, and ids decoded at a time.
PIECE = 1 << 16
#: Longer words are not remembered; bytes of words remembered per generation (there are two), a word's share of
#: tables and headers; lists of symbols up to a length are merged by scanning, longer ones by a heap.
REMEMBERED, MEMORY_BYTES, WORD_BYTES, SCANNED = 64, 64 << 20, 200, 64
#: Fixed values of the public file formats: the pattern that byte-level files leave unnamed.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points assigned after Unicode 16, which the tokenizers library does not count as letters
#: or numbers and the pattern library may.
NEWER = """
    558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
    10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8
    16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128
    1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED
    1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
_NEWER = "".join("-".join(rf"\U{int(x, 16):08x}" for x in part.split("-")) for part in NEWER.split())
#: Capitals (first, last) of Unicode 16 and 17, and the small letter of the first.
NEWER_CAPITALS = """
    1C89 1C89 1C8A, A7CB A7CB 264, A7CC A7CC A7CD, A7CE A7CE A7CF, A7D2 A7D2 A7D3, A7D4 A7D4 A7D5, A7DA A7DA A7DB,
    A7DC A7DC 19B, 10D50 10D65 10D70, 16EA0 16EB8 16EBB
"""
_SMALL = {
    capital: small + capital - first
    for first, last, small in ([int(x, 16) for x in part.split()] for part in NEWER_CAPITALS.split(","))
    for capital in range(first, last + 1)
}
_HAS_NEWER_CAPITALS = re.compile("[" + "".join(map(chr, _SMALL)) + "]").search
_HAS_NEWER = re.compile(f"[{_NEWER}]").search
#: One range that holds all of the above: most texts are settled by it, or by their encoding.
_HAS_HIGH = re.compile("[\u0558-\U0010ffff]").search


def _may_be_newer(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _HAS_HIGH(text) is not None
    return False


#: White space as the tokenizers' patterns have it; ``str.isspace`` also holds for 1C to 1F, which are symbols.
_BLANK = regex.compile(r"\s")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


def sufficient_lookahead(merges: Iterable[tuple[str, str]], suffix: str) -> int:
    """Symbols after a token that decide whether it stays."""

    def length(token: str) -> int:
        return len(token) - (len(suffix) if suffix and token.endswith(suffix) else 0)

    reach: defaultdict[str, int] = defaultdict(int)
    for left, right in merges:
        behind = reach[right]
        reach[left] = max(reach[left], length(right) + behind)
        reach[left + right] = max(reach[left + right], behind)
    return max(reach.values(), default=0)


class Tokenizer:
    """What a public tokenizer file says, from its JSON text."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.lookahead = sufficient_lookahead(merges, self.suffix)
        # A pair of ids is one number; its rank is its place in the merge list, and each rank has a result.
        self.base = max(self.vocab.values(), default=0) + 1
        self.rank = {self.vocab[a] * self.base + self.vocab[b]: i for i, (a, b) in enumerate(merges)}
        self.result = [self.vocab[a + b] for a, b in merges]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.alphabet = byte_alphabet()
        #: Ids of the symbols of a byte: inside a word, and at its end.
        self.inside = [self.vocab.get(c, -1) for c in self.alphabet]
        self.at_end = [self.vocab.get(c + self.suffix, -1) for c in self.alphabet]
        #: How many symbols a token stands for.
        self.length = [0] * self.base
        for token, i in self.vocab.items():
            self.length[i] = len(token) - (len(self.suffix) if self.suffix and token.endswith(self.suffix) else 0)
        steps = self._parts(spec.get("normalizer"), "normalizers")
        self.nfc = any(s["type"] == "NFC" for s in steps)
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        split = [s["pattern"]["Regex"] for s in self._parts(spec.get("pre_tokenizer"), "pretokenizers") if s["type"] == "Split"]
        pattern = split[0] if split else BYTE_LEVEL_PATTERN
        self.words = regex.compile(pattern)
        inside = pattern.replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}")
        # The same pattern for texts with newer characters: they are symbols.
        careful = inside.replace(r"[^\s\p{L}\p{N}]", "\0").replace("\\p{L}", rf"[\p{{L}}--[{_NEWER}]]")
        careful = careful.replace("\\p{N}", rf"[\p{{N}}--[{_NEWER}]]").replace("\0", rf"[[^\s\p{{L}}\p{{N}}]||[{_NEWER}]]")
        self.careful_words = regex.compile(careful, regex.V1)
        #: Blanks belong to words in byte-level files, so their texts are not cut at white space.
        self.drops_blanks = bool(split)
        self.byte_decoder = bool(spec.get("decoder"))
        known = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, known))) if known else None
        self.stream = Transducer(self)
        self.memory = Memory(self.word_ids)

    @staticmethod
    def _parts(step: dict | None, name: str) -> list[dict]:
        return [] if step is None else step.get(name, [step])

    def normalised(self, text: str, newer: bool = True) -> str:
        """As the file's normaliser; ``newer`` is false where no character can be one of the newer ones."""
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if not self.lower:
            return text
        if newer and _HAS_NEWER_CAPITALS(text):
            text = text.translate(_SMALL)
        # Characters are lowered one by one: a sigma is not treated differently at a word's end.
        return text.replace("Σ", "σ").lower()

    def merged(self, ids: list[int]) -> list[int]:
        """All merges of a list of symbols: always the earliest of the merge list, leftmost first."""
        base, rank, result, none = self.base, self.rank.get, self.result, len(self.result)
        if len(ids) <= SCANNED:
            ranks = [rank(a * base + b, none) for a, b in zip(ids, ids[1:])]
            while ranks and (best := min(ranks)) < none:
                i = ranks.index(best)
                ids[i : i + 2] = [result[best]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank(ids[i - 1] * base + ids[i], none)
                if i < len(ranks):
                    ranks[i] = rank(ids[i] * base + ids[i + 1], none)
            return ids
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank(a * base + b, none)) < none]
        heapq.heapify(heap)
        found: list[int | None] = list(ids)
        while heap:
            best, i, left, right = heapq.heappop(heap)
            j = after[i]
            if found[i] != left or j >= len(found) or found[j] != right:
                continue
            found[i], found[j] = result[best], None
            after[i] = after[j]
            if after[j] < len(found):
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(found) and (r := rank(found[a] * base + found[b], none)) < none:
                    heapq.heappush(heap, (r, a, found[a], found[b]))
        return [t for t in found if t is not None]

    def word_ids(self, word: str) -> bytes:
        """The ids of a word as 32-bit numbers."""
        data = word.encode("utf-8", "surrogatepass")
        if len(data) <= PIECE:
            found = self.stream.feed(data)
        else:
            found = [t for i in range(0, len(data), PIECE) for t in self.stream.feed(data[i : i + PIECE])]
        found += self.stream.finish()
        return array("i", found).tobytes()

    def plain_ids(self, text: str) -> Iterator[bytes]:
        """The ids of a text without special tokens, word by word."""
        start = 0
        while start < len(text):
            blank = _BLANK.search(text, start + PIECE) if self.drops_blanks else None
            past = blank.start() if blank else len(text)
            piece = text[start:past]
            # Composing never leads up to the newer characters, lowering only from others of them.
            newer = _may_be_newer(piece)
            piece = self.normalised(piece, newer)
            newer = newer and _HAS_NEWER(piece)
            yield from map(self.memory.__getitem__, (self.careful_words if newer else self.words).findall(piece))
            start = past

    def encode(self, text: str) -> np.ndarray:
        found: list[bytes] = []
        start = 0
        for mark in self.specials.finditer(text) if self.specials else ():
            found += self.plain_ids(text[start : mark.start()])
            found.append(np.int32(self.special[mark[0]]).tobytes())
            start = mark.end()
        found += self.plain_ids(text[start:] if start else text)
        return np.frombuffer(b"".join(found), np.int32)


class Memory(dict):
    """Words with what ``make`` makes of them; the newest are kept, in two generations of bounded size."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.old, self.size = make, {}, 0

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= REMEMBERED:
            self.size += WORD_BYTES + 4 * len(word) + len(found)
            if self.size > MEMORY_BYTES:
                self.old, self.size = dict(self), 0
                self.clear()
            self[word] = found
        return found


class Transducer:
    """One word after another, fed in pieces of bytes; ids come out once nothing that follows can change them."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.waiting: list[int] = []
        #: The byte read last: the last symbol of a word differs, so one is always held back.
        self.last: int | None = None
        self.step = max(256, tokenizer.lookahead, *tokenizer.length)

    def feed(self, piece: bytes) -> list[int]:
        t, out = self.tokenizer, []
        read = list(map(t.inside.__getitem__, piece))
        if self.last is not None:
            self.waiting.append(t.inside[self.last])
        if read:
            self.last = piece[-1]
            read.pop()
        most = t.lookahead + self.step
        for start in range(0, len(read), most):
            self.waiting += read[start : start + most]
            while len(self.waiting) > most:
                place = 0
                for token in t.merged(self.waiting[:most]):
                    if place + t.length[token] > most - t.lookahead:
                        break
                    place += t.length[token]
                    out.append(token)
                del self.waiting[:place]
        return out

    def finish(self) -> list[int]:
        found = [] if self.last is None else self.tokenizer.merged([*self.waiting, self.tokenizer.at_end[self.last]])
        self.waiting, self.last = [], None
        return found


class Decoder:
    """Ids to text, piece by piece; between pieces it keeps an unfinished character and nothing else."""

    def __init__(self, tokenizer: Tokenizer, as_text: bool = False):
        tokens = {i: t for t, i in tokenizer.vocab.items()} | {i: t for t, i in tokenizer.special.items()}
        byte_of = {c: bytes([b]) for b, c in enumerate(tokenizer.alphabet)}
        special, suffix = set(tokenizer.special), tokenizer.suffix

        def surface(token: str) -> bytes:
            if token in special:
                return token.encode()
            ends = bool(suffix) and token.endswith(suffix)
            plain = token[: -len(suffix)] if ends else token
            return b"".join(byte_of[c] for c in plain) + b" " * ends

        self.joined = not (as_text or tokenizer.byte_decoder)
        self.table = [b""] * (max(tokens, default=-1) + 1)
        for i, t in tokens.items():
            self.table[i] = t.encode() if self.joined else surface(t)
        self.restart()

    def restart(self) -> None:
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: Iterable[int]) -> str:
        parts = map(self.table.__getitem__, ids)
        if not self.joined:
            return self.state.decode(b"".join(parts))
        found = (b" " if self.begun else b"") + b" ".join(parts)
        self.begun = True
        return self.state.decode(found)

    def finish(self) -> str:
        rest = self.state.decode(b"", final=True)
        self.restart()
        return rest

    def decode(self, ids: np.ndarray) -> str:
        parts = [self.feed(ids[i : i + PIECE].tolist()) for i in range(0, len(ids), PIECE)]
        return "".join([*parts, self.finish()])


_OPEN: dict[str, tuple[tuple, object]] = {}


def _opened(shared, use: str, make: Callable[[str], object], *how):
    """What a task makes of the broadcast file, kept for the next task of the same worker; one for each use."""
    key = (shared.value["key"], *how)
    if use not in _OPEN or _OPEN[use][0] != key:
        _OPEN[use] = key, make(shared.value["source"])
    return _OPEN[use][1]


def _encode_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _opened(shared, "encode", Tokenizer)
        for batch in small(batches):
            found = [tokenizer.encode(t.as_py()) for t in batch.column("text")]
            bounds = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return run


def _decode_rows(shared, as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _opened(shared, "decode", lambda source: Decoder(Tokenizer(source), as_text), as_text)
        for batch in small(batches):
            texts = [opened.decode(np.asarray(ids.values)) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def shared_tokenizer(docs: DataFrame, path: str):
    """The tokenizer file, read once on the driver and sent to the tasks; a few MB whatever the data."""
    with open(path, encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast({"key": path, "source": file.read()})


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``ids``."""
    texts = packed(docs, key, text).select("doc_id", "text")
    return texts.mapInArrow(_encode_rows(shared_tokenizer(docs, path)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, as_text: bool = False) -> DataFrame:
    """The rows of ``encode`` with ``decoded``."""
    shared = shared_tokenizer(encoded, path)
    return encoded.select("doc_id", "ids").mapInArrow(
        _decode_rows(shared, as_text), "doc_id long, ids array<int>, decoded string"
    )


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """Lengths and SHA-256 of the ids and of the decoded text; ``more`` columns follow."""
    numbers = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(numbers.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *more,
    )
