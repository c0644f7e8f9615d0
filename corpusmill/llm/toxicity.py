"""Toxicity scores of texts, after a noisy-channel decoder has undone their disguises."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import joined_few, scoped, stored
from .utf8 import rows

#: Labelled documents of one class that training reads, about: the bound of the sample.
TRAIN_DOCS = 8_000
#: Telling terms that a model keeps at most.
TERMS = 4_096
#: Toxic sample documents that a telling term occurs in at least, and their share.
SUPPORT, SUPPORT_SHARE = 4, 0.01
#: Natural log of the rates' ratio from which a term is telling.
TELLING = 3.0
#: A document is predicted toxic from this score on.
TOXIC = 0.5
#: A term is a word, or one of its beginnings of so many letters.
PREFIXES = (4, 5, 6, 7)

#: Characters that stand for letters (fixed values).
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e",
}
#: What may stand between the letters of a spaced-out word (fixed values).
GAPS = " .-_*·~/\\,"
#: Characters that show nothing, which are deleted (fixed values).
UNSEEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])

_LEET = re.escape("".join(LEET))
_LETTER = r"[^\W\d_]"
_PART = rf"[\w{_LEET}]"
#: A word with a stand-in beside a letter, or a letter three times in a row. Anchored at its start: linear.
SUSPECT = re.compile(rf"(?<!{_PART}){_PART}*?(?:{_LETTER}[{_LEET}]|[{_LEET}]{_LETTER}|({_LETTER})\1\1){_PART}*")
#: Three single characters or more with one gap between each.
SPACED = re.compile(rf"(?<!{_PART})(?:(?:{_LETTER}|[{_LEET}])[{re.escape(GAPS)}]){{2,}}(?:{_LETTER}|[{_LEET}])(?!{_PART})")
WORD = re.compile(rf"{_LETTER}+")

# The classes of the language model: a boundary, 26 letters, other letters, digits and signs.
EDGE, OTHER, SIGN, CLASSES = 0, 27, 28, 29


def _class_of(char: str) -> int:
    base = unicodedata.normalize("NFD", char)[:1].lower()
    if "a" <= base <= "z":
        return ord(base) - 96
    return OTHER if char.isalpha() else SIGN if char.isdigit() else EDGE


def _traits(char: str) -> int:
    """The class; whether a letter, a stand-in, part of a word."""
    leet = char in LEET
    return _class_of(char) | char.isalpha() << 5 | leet << 6 | (leet or char.isalnum()) << 7


_TRAITS = np.fromiter((_traits(chr(i)) for i in range(0x110000)), dtype=np.uint8, count=0x110000)


def _marks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(traits of each character, where there is something that ``SUSPECT`` looks for)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    traits = _TRAITS[points]
    letter, leet = (traits & 32).astype(bool), (traits & 64).astype(bool)
    odd = np.zeros(len(points), dtype=bool)
    odd[1:] = (letter[:-1] & leet[1:]) | (leet[:-1] & letter[1:])
    same = points[1:] == points[:-1]
    odd[2:] |= letter[2:] & same[1:] & same[:-1]
    return traits, odd


def _alone(traits: np.ndarray) -> bool:
    """Whether three single characters follow each other at one place's distance: without, ``SPACED`` finds nothing."""
    part = np.concatenate([[False], traits >= 128, [False]])
    single = part[1:-1] & ~part[:-2] & ~part[2:]
    return bool((single[:-4] & single[2:-2] & single[4:]).any())


def trigrams(text: str) -> np.ndarray:
    """Counts of the class trigrams of a text but its suspicious words, boundaries in a row being one."""
    traits, odd = _marks(f" {text.lower()} ")
    seen = traits & 31
    if odd.any():
        run = np.cumsum(traits < 128)  # of characters that are parts of words
        bad = np.zeros(run[-1] + 1, dtype=bool)
        bad[run[odd]] = True
        seen = np.where(bad[run], EDGE, seen)
    keep = np.ones(len(seen), dtype=bool)
    keep[1:] = (seen[1:] != EDGE) | (seen[:-1] != EDGE)
    a = seen[keep].astype(np.int32)
    if len(a) < 3:
        return np.zeros(CLASSES**3, dtype=np.int64)
    return np.bincount((a[:-2] * CLASSES + a[1:-1]) * CLASSES + a[2:], minlength=CLASSES**3)


#: Chance of a digit after a letter, at the start of a word, after a digit.
_SIGN, _FIRST_SIGN, _NEXT_SIGN = 0.01, 0.05, 0.5


def log_chances(counts: np.ndarray) -> np.ndarray:
    """Log chance of each class after two others: trigram counts, smoothed by bigrams, by single classes.

    Words with digits are not counted, since a disguise cannot be told from
    them; digits have fixed chances.
    """
    three = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
    two = three.sum(axis=0)
    one = two.sum(axis=0)
    single = (one + 1) / (one.sum() + CLASSES)
    pair = (two + 5 * single) / (two.sum(axis=1, keepdims=True) + 5)
    chances = (three + 5 * pair) / (three.sum(axis=2, keepdims=True) + 5)
    chances[:, :, SIGN] = _SIGN
    chances[:, EDGE, SIGN], chances[:, SIGN, SIGN] = _FIRST_SIGN, _NEXT_SIGN
    return np.log(chances).reshape(-1)


# The channel: chances of what a writer does to a letter or sign, as logs.
_SWAPPED, _SAME, _SAME_INSIDE = np.log(0.2), np.log(0.5), np.log(0.02)
_CLOSED, _OPEN = np.log(0.9), np.log(0.1)
#: (said once, said twice) of a letter seen twice, and of one seen more often.
_PAIR, _MORE = (np.log(0.1), np.log(0.9)), (np.log(0.5), np.log(0.5))


def _options(char: str, run: int, inside: bool) -> list[tuple[str, tuple[int, ...], float]]:
    """What ``run`` equal characters may stand for: (text, classes, log chance).

    ``inside``: within a word, where a sign that is no letter is rare.
    """
    if char in GAPS:
        return [("", (), _CLOSED), (" ", (EDGE,), _OPEN)]
    out = []
    for letter in LEET.get(char, char):
        c, cost = _class_of(letter), _SWAPPED if char in LEET else 0.0
        if run == 1:
            out.append((letter, (c,), cost))
        else:
            once, twice = _PAIR if run == 2 else _MORE
            out += [(letter, (c,), cost + once), (letter * 2, (c, c), cost + twice)]
    if char in LEET:
        out.append((char * run, (_class_of(char),), _SAME_INSIDE if inside and not char.isdigit() else _SAME))
    return out


def decode(seen: str, chances: list[float]) -> str:
    """The likeliest text behind a disguised one (Viterbi).

    The lattice has a column for each run of equal characters. A stand-in may
    be itself or one of its letters, a letter said several times may be one or
    two, a gap may be none or a boundary; the model of class trigrams weighs
    the ways through. A state is the last two classes, so that the time is
    linear in the length.
    """
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
    for m in re.finditer(r"(.)\1*", seen, re.S):
        inside = 0 < m.start() and m.end() < len(seen) and seen[m.start() - 1] not in GAPS and seen[m.end()] not in GAPS
        options = _options(m[1], len(m[0]), inside)
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, way) in best.items():
            for text, classes, cost in options:
                x, y, now = a, b, score + cost
                for c in classes:
                    if c != EDGE or y != EDGE:
                        now += chances[(x * CLASSES + y) * CLASSES + c]
                        x, y = y, c
                known = after.get((x, y))
                if known is None or now > known[0]:
                    after[x, y] = now, (way, text)
        best = after
    ends = {s: v[0] + (chances[(s[0] * CLASSES + s[1]) * CLASSES] if s[1] != EDGE else 0.0) for s, v in best.items()}
    way = best[max(ends, key=lambda s: (ends[s], s))][1]
    parts = []
    while way is not None:
        way, text = way
        parts.append(text)
    return "".join(reversed(parts))


@dataclass
class Channel:
    """Restores texts. Short pieces that it has decoded it keeps for the next time, ``room`` of them at most."""

    chances: list[float]
    room: int = 100_000
    known: dict[str, str] = field(default_factory=dict)

    def _decoded(self, seen: str) -> str:
        found = self.known.get(seen)
        if found is None:
            found = decode(seen, self.chances)
            if len(seen) < 64:
                if len(self.known) >= self.room:
                    self.known.clear()
                self.known[seen] = found
        return found

    def _word(self, m: re.Match) -> str:
        whole = m[0]
        body = whole.rstrip("!|+")  # punctuation
        bare = body.rstrip("@$€")
        body = body if len(body) - len(bare) <= 2 else bare
        return self._decoded(body) + whole[len(body) :] if SUSPECT.fullmatch(body) else whole

    def _spaced(self, m: re.Match) -> str:
        return self._decoded(m[0]) if sum(c.isalpha() for c in m[0]) > 1 else m[0]

    def restore(self, text: str) -> str:
        """The text in lower case, without unseen characters, its disguised words restored."""
        text = text.lower()
        if not text.isascii() and any(map(text.__contains__, map(chr, UNSEEN))):
            text = text.translate(UNSEEN)
        traits, odd = _marks(text)
        if _alone(traits):
            text = SPACED.sub(self._spaced, text)
            odd = _marks(text)[1]
        return SUSPECT.sub(self._word, text) if odd.any() else text

    def words(self, text: str) -> Counter[str]:
        """How often each word of the restored text occurs."""
        return Counter(WORD.findall(self.restore(text)))


def terms_of(word: str) -> list[str]:
    """The word, marked as whole, and its beginnings."""
    return [f"{word}$", *(word[:n] for n in PREFIXES if len(word) >= n)]


_WEIGHTS = [0.0, *(1 + math.log(n) for n in range(1, 1_000))]


def weight(n: int) -> float:
    """Of a word that occurs n times: 1 + ln n, so that repetition tells little."""
    return _WEIGHTS[n] if n < 1_000 else 1 + math.log(n)


@dataclass(frozen=True)
class Model:
    """The language model, the telling terms and the score's three coefficients."""

    chances: np.ndarray
    terms: dict[str, float]
    coefficients: np.ndarray

    @cached_property
    def heads(self) -> frozenset[str]:
        """How words with a telling term begin."""
        return frozenset(t.removesuffix("$")[: min(PREFIXES)] for t in self.terms)

    def measures(self, words: dict[str, int]) -> tuple[float, float]:
        """Strength of a text's telling words: per hundred words, and in all. A word counts by its most telling term."""
        total, strength, n, heads = sum(map(weight, words.values())), 0.0, min(PREFIXES), self.heads
        for word in words:
            if word[:n] in heads:
                strength += weight(words[word]) * max(map(self.terms.get, terms_of(word), [0.0] * 9))
        return math.log1p(100 * strength / total) if total else 0.0, math.log1p(strength)

    def chance(self, measured: np.ndarray) -> np.ndarray:
        """Chance of label 1 of rows of measures."""
        margin = np.column_stack([np.ones(len(measured)), measured]) @ self.coefficients
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _texts(column: pa.Array) -> Iterator[str]:
    for raw in rows(column):
        yield raw.tobytes().decode("utf-8", "replace")


def _trigrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES**3, dtype=np.int64)
    for batch in batches:
        for text in _texts(batch.column(0)):
            total += trigrams(text)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Log chances of class trigrams over all texts, null ones left out.

    Each task counts its own texts; the driver gets one count a trigram,
    ``CLASSES`` cubed at most, whatever the input.
    """
    found = docs.where(F.col("text").isNotNull()).select("text").mapInArrow(_trigrams, "at long, n long")
    held = found.groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CLASSES**3, dtype=np.int64)
    counts[held["at"].to_numpy(dtype=np.int64)] = held["n"].to_numpy(dtype=np.int64)
    return log_chances(counts)


#: Terms that a task counts before it passes them on.
_HELD = 400_000


def _rates(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def passed(held: dict[str, list]) -> pa.RecordBatch:
        columns = list(zip(*held.values(), strict=True)) if held else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array(c, pa.float64()) for c in columns)], ["term", "clean", "toxic", "support"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(shared.value.tolist())
        held: dict[str, list] = {}
        for batch in batches:
            for text, toxic in zip(_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = {word: weight(n) for word, n in channel.words(text).items()}
                mine = Counter({"": sum(words.values())})  # the empty term counts all
                for word, n in words.items():
                    for term in terms_of(word):
                        mine[term] += n
                for term, n in mine.items():
                    row = held.setdefault(term, [0.0, 0.0, 0.0])
                    row[toxic] += n
                    row[2] += toxic
                if len(held) > _HELD:
                    yield passed(held)
                    held = {}
        yield passed(held)

    return count


def _measured(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        channel = Channel(model.chances.tolist())
        for batch in batches:
            found = np.array([model.measures(channel.words(text)) for text in _texts(batch.column(1))]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (found[:, 0], found[:, 1], model.chance(found)))], ["key", "rate", "strength", "score"])

    return measure


def measured(docs: DataFrame, key: str, model: Model) -> DataFrame:
    """key, rate, strength, score of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CLASSES cubed numbers and TERMS terms at most
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(_measured(shared), f"key {kind}, rate double, strength double, score double")


def _fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method, on standardised measures; coefficients for plain ones."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    b = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(b)), a.T @ (y - p) - ridge * b)
        b += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return np.concatenate([[b[0] - (b[1:] * mean / spread).sum()], b[1:] / spread])


@scoped
def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS) -> DataFrame:
    """text and toxic (0 or 1) of about ``per_class`` labelled documents of each class.

    They are chosen by a hash of doc_id. Labels that are null do not count; of
    several the largest holds; of rows that share a doc_id the least text
    stands for all, so that the bound holds however often one is repeated.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1))
    n = F.broadcast(known.groupBy("toxic").agg(F.count("*").alias("n")))  # two rows
    chance = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = stored(known.join(n, "toxic").where(chance < F.lit(float(per_class)) / F.col("n")).select("doc_id", "toxic"), "chosen")
    texts = joined_few(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), chosen.select("doc_id"), "doc_id")
    return stored(texts.groupBy("doc_id").agg(F.min("text").alias("text")).join(chosen, "doc_id").select("text", "toxic"), "sample", keep=True)


@scoped
def train(docs: DataFrame, labels: DataFrame, learn: DataFrame | None = None, per_class: int = TRAIN_DOCS) -> Model:
    """Fit the language model on all ``docs``, the rest on the labelled ones of ``learn`` (by default ``docs``).

    Characters are counted over all texts, labelled or not. On a sample of
    about ``per_class`` documents of each class, texts are restored and Spark
    counts words and their beginnings by class; those that are far more
    frequent in toxic texts and occur in several of them are the telling
    terms, ``TERMS`` at most. The score is a logistic regression on two
    measures of them; the driver gets two numbers a sample document. Without
    toxic or without clean labels every score is the share of toxic ones, a
    half if there are no labels.
    """
    spark = docs.sparkSession
    chances = character_model(docs)
    sample = labelled_sample(docs if learn is None else learn, labels, per_class)
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(n) < 2:
        margin = {(): 0.0, (0,): -500.0, (1,): 500.0}[tuple(n)]
        return Model(chances, {}, np.array([margin, 0.0, 0.0]))
    shared = spark.sparkContext.broadcast(chances)
    counted = sample.select("text", "toxic").mapInArrow(_rates(shared), "term string, clean double, toxic double, support double")
    counted = stored(counted.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("clean", "toxic", "support"))), "terms")
    total = counted.where(F.col("term") == "").first()
    odds = F.log(((F.col("toxic") + 0.5) / F.lit(total["toxic"] + 0.5)) / ((F.col("clean") + 2) / F.lit(total["clean"] + 2)))
    telling = counted.where(F.col("term") != "").withColumn("odds", odds)
    telling = telling.where((F.col("support") >= max(SUPPORT, SUPPORT_SHARE * n[1])) & (F.col("odds") >= TELLING))
    best = telling.orderBy(F.desc(F.col("odds") * F.col("support")), "term").limit(TERMS).select("term", "odds").toPandas()
    plain = Model(chances, dict(zip(best["term"], best["odds"].astype(float), strict=True)), np.zeros(3))
    held = measured(sample.select("toxic", "text"), "toxic", plain).toPandas()  # the sample: two numbers a row
    return Model(chances, plain.terms, _fitted(held[["rate", "strength"]].to_numpy(dtype=float), held["key"].to_numpy(dtype=float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted (1 from ``TOXIC`` on) of every row.

    Takes ``doc_id`` and ``text``; other columns are ignored. The whole text
    is restored and scored; null is an empty text, and a text without words
    has the score that no telling word gives. Repeated rows are rows, with
    equal scores. An empty table gives an empty result.
    """
    found = measured(docs, "doc_id", model)
    return found.select(F.col("key").alias("doc_id"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def restored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the restored text, in lower case (null: empty)."""
    shared = docs.sparkSession.sparkContext.broadcast(model.chances)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(shared.value.tolist())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([channel.restore(t) for t in _texts(batch.column(1))], pa.string())], ["doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(restore, f"doc_id {kind}, text string")


def held_out(name: str = "doc_id"):
    """Whether crc32 of the id as text, mod 5, is 0; a null id is not."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS) -> DataFrame:
    """Learn labels from the rows that are not held out, score all; adds ``held_out``.

    A null doc_id has no label: it is scored, not learned from.
    """
    model = train(docs, labels, docs.where(~held_out()), per_class)
    return score(docs, model).withColumn("held_out", held_out())
