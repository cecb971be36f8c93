"""Language identification by unigram models of word pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. Each language has a probability per piece; a word's
probability is the sum over all ways to write it as pieces, found by a forward pass, and a text's is the
product over its words. The probabilities are learned by expectation-maximisation from word counts of a
bounded sample: the ``SAMPLE`` labelled training documents per language whose id hashes lowest. Counting,
expectation and the sums over words are Spark jobs; the model has pieces x languages numbers, whatever the
data.

A document is held out if crc32 of its id as text leaves 1 modulo 3; these are never learned from. A
prediction sees the text alone.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is everything if nothing can
be learned; otherwise the score is the share of the best language in the sum over all languages; ties go to
the language that sorts first; words longer than ``LONGEST`` letters are scored in parts; a null id is not
held out; other columns do not matter.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, short_batches, small

#: Training documents per language.
SAMPLE = 500
ROUNDS = 3
LONGEST = 40
#: Added to the expected count of every piece; probability of a letter that is not in the vocabulary.
PRIOR, UNKNOWN = 0.01, 1e-7
UNDETERMINED = "und"
START = "▁"
#: How many times as surprising per letter as the median text of its language a text may be, and what is allowed
#: beyond that (in nats over the whole text), since a few letters prove little.
SURPRISE, SLACK = 3.0, 20.0
#: Nats per letter in which surprise is counted.
STEP = 1e-3
#: Words kept with their scores in a task.
REMEMBERED = 1 << 18
#: Characters of texts scored together.
GROUP_CHARS = 1 << 19
_WORDS = re.compile(r"[^\W\d_]+")
_BEGINS, _UNKNOWN = 0, 1


class Model(NamedTuple):
    languages: list[str]
    #: Piece to row number; row 0 is for beginnings of pieces and has no probability, row 1 for unknown letters.
    pieces: dict[str, int]
    #: Probability by row and language.
    p: np.ndarray


def vocabulary(path: str) -> dict[str, int]:
    """Pieces of lower-case letters in a public sentencepiece file, numbered from 2.

    Beginnings of pieces that are none themselves have row 0, so that a search stops where no piece can follow.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if model.is_byte(i) is False)
    kept = sorted({p for p in found if p == START or (p.lstrip(START).isalpha() and p == p.lower())})
    begins = {p[:n]: _BEGINS for p in kept for n in range(1, len(p))}
    return begins | {p: i for i, p in enumerate(kept, 2)}


def n_rows(pieces: dict[str, int]) -> int:
    return max(pieces.values(), default=_UNKNOWN) + 1


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def has_letter(words: Iterable[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


def _parts(word: str) -> list[str]:
    return [START + word[i : i + LONGEST] for i in range(0, len(word), LONGEST)]


class Spans(NamedTuple):
    """All pieces in some words of one length: by first and past-last letter, the words and the pieces' rows."""

    n: int
    n_words: int
    at: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]


def spans(words: list[str], pieces: dict[str, int]) -> Spans:
    n = len(words[0])
    at: defaultdict[tuple[int, int], tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    for k, word in enumerate(words):
        for i in range(n):
            if not pieces.get(word[i]):
                at[i, i + 1][0].append(k)
                at[i, i + 1][1].append(_UNKNOWN)
            for j in range(i + 1, n + 1):
                row = pieces.get(word[i:j])
                if row is None:
                    break
                if row:
                    which, rows = at[i, j]
                    which.append(k)
                    rows.append(row)
    return Spans(n, len(words), {place: (np.array(w), np.array(r)) for place, (w, r) in sorted(at.items())})


def forward(found: Spans, p: np.ndarray, language: np.ndarray | None = None) -> list[np.ndarray]:
    """Probability of every beginning of the words: in all languages, or each word in its own."""
    shape = (found.n_words, p.shape[1]) if language is None else (found.n_words,)
    ahead = [np.zeros(shape) for _ in range(found.n + 1)]
    ahead[0] += 1
    for (i, j), (which, row) in found.at.items():
        ahead[j][which] += ahead[i][which] * (p[row] if language is None else p[row, language[which]])
    return ahead


def backward(found: Spans, p: np.ndarray, language: np.ndarray) -> list[np.ndarray]:
    """Probability of every end of the words."""
    behind = [np.zeros(found.n_words) for _ in range(found.n + 1)]
    behind[-1] += 1
    for (i, j), (which, row) in reversed(found.at.items()):
        behind[i][which] += behind[j][which] * p[row, language[which]]
    return behind


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.zeros((len(words), len(model.languages)))
    by_length: dict[int, list[tuple[int, str]]] = {}
    for k, word in enumerate(words):
        for part in _parts(word):
            by_length.setdefault(len(part), []).append((k, part))
    for group in by_length.values():
        ends = forward(spans([part for _, part in group], model.pieces), model.p)[-1]
        np.add.at(out, [k for k, _ in group], np.log(ends))
    return out


class Scorer:
    """Texts to language scores; remembers the words it has scored, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))

    def score(self, texts: list[list[str]]) -> np.ndarray:
        new = list({w for words in texts for w in words} - self.number.keys())
        if len(self.number) + len(new) > REMEMBERED:
            self.forget()
            new = list({w for words in texts for w in words})
        if new:
            self.number.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
            self.scores = np.concatenate([self.scores, word_scores(new, self.model)])
        sums = [self.scores[[*map(self.number.__getitem__, words)]].sum(0) for words in texts]
        return np.array(sums).reshape(len(texts), len(self.model.languages))


def _shared_rows(shared, make_rows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make_rows(shared.value, batches)

    return run


def _expected_rows(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Expected uses of each piece, by language, over counted words."""
    total = np.zeros(model.p.shape)
    for batch in batches:
        groups: dict[int, list[tuple[str, int, int]]] = {}
        for word, language, n in zip(*(batch.column(c).to_pylist() for c in ("word", "language", "n"))):
            for part in _parts(word):
                groups.setdefault(len(part), []).append((part, language, n))
        for group in groups.values():
            found = spans([part for part, _, _ in group], model.pieces)
            language = np.array([x for _, x, _ in group])
            ahead, behind = forward(found, model.p, language), backward(found, model.p, language)
            weight = np.array([n for _, _, n in group]) / ahead[-1]
            for (i, j), (which, row) in found.at.items():
                own = language[which]
                uses = ahead[i][which] * model.p[row, own] * behind[j][which] * weight[which]
                np.add.at(total, (row, own), uses)
    total[:2] = 0
    row, language = np.nonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(row), pa.array(language), pa.array(total[row, language])], ["row", "language", "uses"]
    )


def _normalised(uses: np.ndarray) -> np.ndarray:
    p = uses + PRIOR
    p[:2] = 0
    p = p / p.sum(0) * (1 - UNKNOWN)
    p[_UNKNOWN] = UNKNOWN
    return p


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """All documents that may be learned from."""
    return docs.filter(~held_out(F.col(key)) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def training_sample(docs: DataFrame, sample: int = SAMPLE, key: str = "doc_id") -> DataFrame:
    """``lang``, ``text`` of the documents to learn from: per language those whose ids hash lowest.

    A language's documents are counted first, and only the share of hashes that is expected to hold twice the sample
    is ranked, so a language with most of the rows sends no more than that to the task that finds its cut. Where one
    id has very many rows there may be fewer than ``sample``. Nothing is joined.
    """
    place = F.xxhash64(F.col(key).cast("string"))
    known = training_rows(docs, key)
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}

    def below(bounds: dict[str, int]) -> Column:
        chosen = F.lit(False)
        for lang, bound in bounds.items():
            chosen = chosen | ((F.col("lang") == lang) & (place <= bound))
        return chosen

    shares = {lang: (1 << 64) * min(n, 2 * sample) // n - (1 << 63) - 1 for lang, n in counts.items()}
    order = Window.partitionBy("lang").orderBy("place")
    low = known.filter(below(shares)).select("lang", place.alias("place")).withColumn("n", F.row_number().over(order))
    cuts = low.filter(F.col("n") <= sample).groupBy("lang").agg(F.max("place").alias("cut")).collect()
    return known.filter(below({r["lang"]: r["cut"] for r in cuts})).select("lang", "text")


def learn(docs: DataFrame, vocabulary_path: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    return learn_from(training_sample(docs, sample), vocabulary_path, rounds)


def learn_from(sample: DataFrame, vocabulary_path: str, rounds: int = ROUNDS) -> Model:
    """The model of a table of ``lang``, ``text``: a sample, or all there is. Only counts of its words are kept."""
    spark = sample.sparkSession
    pieces = vocabulary(vocabulary_path)
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0))
    counted = sample.select("lang", word.alias("word")).groupBy("lang", "word")
    counted = checkpointed(counted.agg(F.count("*").alias("n")))
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    number = F.create_map(*(F.lit(x) for i, name in enumerate(languages) for x in (name, i))) if languages else None
    uses = np.ones((n_rows(pieces), len(languages)))
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast(Model(languages, pieces, _normalised(uses)))
        expected = (
            counted.select("word", number[F.col("lang")].alias("language"), "n")
            .mapInArrow(_shared_rows(shared, _expected_rows), "row long, language long, uses double")
            .groupBy("row", "language")
            .agg(F.sum("uses").alias("uses"))
            .toArrow()
        )
        uses = np.zeros_like(uses)
        uses[expected["row"].to_numpy(), expected["language"].to_numpy()] = expected["uses"].to_numpy()
    return Model(languages, pieces, _normalised(uses))


def _groups(texts: Iterable[str]) -> Iterator[list[list[str]]]:
    """The words of the texts, in groups of so many characters that scoring new words together pays."""
    group: list[list[str]] = []
    chars = 0
    for text in texts:
        group.append(words_of(text))
        chars += len(text)
        if chars >= GROUP_CHARS:
            yield group
            group, chars = [], 0
    yield group


def _prediction_rows(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for batch in small(batches, 512):
        row = batch.column("row")
        texts = row.field(row.type.get_field_index("text"))
        named: list[str] = []
        scores: list[float] = []
        letters: list[int] = []
        surprise: list[float] = []
        for words in _groups(t.as_py() or "" for t in texts):
            for found, sums in zip(words, scorer.score(words)):
                letters.append(sum(map(len, found)))
                if not model.languages or not has_letter(found):
                    named.append(UNDETERMINED)
                    scores.append(0.0)
                    surprise.append(0.0)
                    continue
                best = int(sums.argmax())
                named.append(model.languages[best])
                scores.append(float(1 / np.exp(sums - sums[best]).sum()))
                surprise.append(float(-sums[best]))
        yield pa.RecordBatch.from_arrays(
            [row, pa.array(named, pa.string()), *(pa.array(x) for x in (scores, letters, surprise))],
            ["row", "lang_pred", "score", "letters", "surprise"],
        )


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All rows: ``row`` (the columns they came with), ``lang_pred``, ``score``, ``letters``, ``surprise``.

    ``surprise`` is minus the log probability of the whole text in the predicted language; 0 for ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = short_batches(docs).select(F.struct("*").alias("row"))
    added = [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("letters", T.LongType()), T.StructField("surprise", T.DoubleType()),
    ]
    schema = T.StructType([*rows.schema.fields, *added])
    return rows.mapInArrow(_shared_rows(shared, _prediction_rows), schema)


def usual_surprise(docs: DataFrame, model: Model) -> dict[str, float]:
    """The median surprise per letter of some texts, by predicted language."""
    return usual_of(predict(docs, model))


def usual_of(found: DataFrame) -> dict[str, float]:
    """The median surprise per letter, by predicted language, of all rows of ``predict``, in steps of ``STEP``.

    Rows are counted by step, and the middle is found in the counts, so no task holds the values of a language.
    """
    step = F.round(F.col("surprise") / F.col("letters") / STEP).cast("long").alias("step")
    counted = found.filter(F.col("lang_pred") != UNDETERMINED).groupBy("lang_pred", step).agg(F.count("*").alias("n"))
    of, before = Window.partitionBy("lang_pred"), Window.partitionBy("lang_pred").orderBy("step")
    placed = counted.withColumns({"upto": F.sum("n").over(before), "all": F.sum("n").over(of)})
    # The step or the two steps that hold the middle rows.
    middle = placed.filter((2 * F.col("upto") >= F.col("all")) & (2 * (F.col("upto") - F.col("n")) <= F.col("all")))
    found_steps = middle.groupBy("lang_pred").agg(F.avg("step").alias("step")).collect()
    return {r["lang_pred"]: r["step"] * STEP for r in found_steps}


def drop_strangers(
    found: DataFrame, usual: dict[str, float] | None = None, least: float = 0.5, most: float = SURPRISE
) -> DataFrame:
    """The rows of ``predict`` whose text is one of the learned languages; see ``drop_undetermined``."""
    kept = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)
    for language, per_letter in (usual or {}).items():
        too_much = F.col("surprise") > F.col("letters") * (most * per_letter) + SLACK
        kept = kept & ~((F.col("lang_pred") == language) & too_much)
    return found.filter(kept).select("row.*")


def drop_undetermined(
    docs: DataFrame, model: Model, usual: dict[str, float] | None = None, least: float = 0.5, most: float = SURPRISE
) -> DataFrame:
    """The rows whose text is one of the learned languages.

    One language has at least ``least`` of the sum over all of them; and where its ``usual`` surprise is given, the
    text has at most ``most`` times that per letter, and ``SLACK`` more over all. So texts without letters go, letter
    junk, and scripts and languages far from the learned ones; a language close to a learned one stays.
    """
    return drop_strangers(predict(docs, model), usual, least, most)
