"""Language identification by error-correcting output codes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keyed, scoped, without_few
from .utf8 import rows

#: Documents of one language that training reads, about: the bound of the sample.
TRAIN_DOCS = 5_000
#: Hashed n-gram features.
FEATURES = 1 << 15
#: A prediction below this score is flagged as ambiguous.
CLEAR = 0.5
UNDETERMINED = "und"

#: Which code points are letters, of all there are.
_LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def letters(text: str) -> np.ndarray:
    """Lower-case letters as code points, each run of anything else as one space."""
    points = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.where(_LETTER[points], points, 32).astype(np.uint32)
    same = np.empty(len(points), dtype=bool)
    same[0] = False
    same[1:] = (points[1:] == 32) & (points[:-1] == 32)
    return points[~same]


def features(text: str) -> np.ndarray:
    """Hashes of all character 1-, 2- and 3-grams; empty if there is no letter."""
    a = letters(text)
    if len(a) < 3:
        return np.zeros(0, dtype=np.int64)
    one = a * np.uint32(0x9E3779B1)
    two = one[:-1] + a[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] + a[2:] * np.uint32(0xC2B2AE3D)
    grams = np.concatenate([one[a != 32], two, three])
    grams ^= grams >> np.uint32(15)
    grams *= np.uint32(0x2C1B3C6D)
    grams ^= grams >> np.uint32(13)
    return (grams & np.uint32(FEATURES - 1)).astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1; any two differ in about half of the bits.

    Up to seven classes get the exhaustive code, more a fixed random one of
    the largest least distance among several.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        bits = 2 ** (n - 1) - 1
        return np.array([[1 if i == 0 else -1 if (j >> (i - 1)) & 1 else 1 for j in range(1, bits + 1)] for i in range(n)])
    rng, bits = np.random.default_rng(n), 16 * int(np.ceil(np.log2(n)))
    tried = [np.where(rng.random((n, bits)) < 0.5, -1, 1) for _ in range(20)]
    tried = [m[:, np.abs(m.sum(axis=0)) < n] for m in tried]
    return max(tried, key=lambda m: -np.max(m @ m.T - 10**6 * np.eye(n)))


@dataclass(frozen=True)
class Model:
    """Languages, their codewords, one linear n-gram classifier a bit."""

    languages: tuple[str, ...]
    codes: np.ndarray  # language x bit
    weights: np.ndarray  # feature x bit: log odds of an n-gram
    bit_weights: np.ndarray  # how well a bit's classes separate

    def decode(self, text: str | None) -> tuple[str, float, str | None]:
        """(language of the nearest codeword, score, runner-up)."""
        grams = features(text) if text else ()
        if not len(grams) or not self.languages:
            return UNDETERMINED, 0.0, None
        margin = self.weights[grams].mean(axis=0, dtype=np.float64)
        # loss of each codeword: bits that disagree cost more, good bits weigh more
        loss = np.exp(-2.0 * self.codes * margin) @ self.bit_weights
        chance = np.exp(-4.0 * (loss - loss.min()))
        chance /= chance.sum()
        by = np.lexsort((np.arange(len(chance)), -chance))
        return self.languages[by[0]], float(chance[by[0]]), self.languages[by[1]] if len(by) > 1 else None


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, raw in zip(batch.column(0).to_pylist(), rows(batch.column(1)), strict=True):
            total = held.setdefault(lang, np.zeros(FEATURES, dtype=np.int64))
            total += np.bincount(features(raw.tobytes().decode("utf-8", "replace")), minlength=FEATURES)
    for lang, total in held.items():
        f = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), pa.array(f), pa.array(total[f])], ["lang", "f", "n"])


def train(labelled: DataFrame, per_language: int = TRAIN_DOCS) -> Model:
    """Fit the bit classifiers on documents with a non-null ``lang``.

    At most about ``per_language`` documents of a language are read, chosen by
    a hash of doc_id; n-grams are counted by Spark, and the driver gets one
    count for each language and feature, at most ``FEATURES`` a language. A
    bit's classifier is the log odds of each n-gram between the two sides of
    the bit, languages counting alike.
    """
    known = labelled.where(F.col("lang").isNotNull())
    n = known.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.broadcast(n.select("lang", (F.lit(float(per_language)) / F.col("n")).alias("share")))  # one row a language
    chance = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = known.join(share, "lang").where(chance < F.col("share")).select("lang", "text")
    counted = sample.mapInArrow(_counts, "lang string, f long, n long").groupBy("lang", "f").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(counted["lang"].unique()))
    rate = np.empty((len(languages), FEATURES))
    for i, lang in enumerate(languages):
        own = counted[counted["lang"] == lang]
        total = np.full(FEATURES, 0.5)
        total[own["f"].to_numpy()] += own["n"].to_numpy()
        rate[i] = total / total.sum()
    codes = codewords(len(languages))
    weights = np.zeros((FEATURES, codes.shape[1]))
    scale = np.ones(codes.shape[1])
    for b in range(codes.shape[1]):
        one, two = rate[codes[:, b] > 0], rate[codes[:, b] < 0]
        if len(one) and len(two):
            odds = np.log(one.mean(axis=0)) - np.log(two.mean(axis=0))
            means = rate @ odds  # expected margin of each language
            middle = (means[codes[:, b] > 0].min() + means[codes[:, b] < 0].max()) / 2
            scale[b] = max(1e-9, (means[codes[:, b] > 0].min() - means[codes[:, b] < 0].max()) / 2)
            weights[:, b] = (odds - middle) / scale[b]
    return Model(languages, codes, weights.astype(np.float32), scale / scale.sum())


def _predict(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = [model.decode(raw.tobytes().decode("utf-8", "replace")) for raw in rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.float64(), pa.string())))],
                ["doc_id", "lang_pred", "score", "runner_up"],
            )

    return predict


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, runner_up, ambiguous of every whole text.

    Takes ``doc_id`` and ``text``; other columns are ignored. Each bit's
    classifier gives a margin; the codeword with the least loss, bits weighted
    by how well they separate, names the language. Null texts, empty ones and
    those without a letter get ``und`` and score 0. A score below ``CLEAR``
    flags the row as ambiguous. Repeated rows are rows. An empty table gives
    an empty result; a model without languages gives ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x bits numbers
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(_predict(shared), f"doc_id {kind}, lang_pred string, score double, runner_up string")
    return found.withColumn("ambiguous", (F.col("lang_pred") != UNDETERMINED) & (F.col("score") < CLEAR))


def fold(name: str = "doc_id"):
    """crc32 of the id as text, mod 4; fold 2 is held out."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % 4


def identify_documents(docs: DataFrame, per_language: int = TRAIN_DOCS) -> DataFrame:
    """Train on all folds but 2, predict for all; adds ``held_out``.

    A null doc_id is in no fold: it is predicted, not learned from.
    """
    model = train(docs.where(fold() != 2).select("doc_id", "lang", "text"), per_language)
    return identify(docs, model).withColumn("held_out", F.coalesce(fold() == 2, F.lit(False)))


@scoped
def keep_identified(docs: DataFrame, per_language: int = TRAIN_DOCS) -> DataFrame:
    """The documents whose language was determined, with all their columns.

    Rejected are those without a letter, null texts among them, and those
    flagged as ambiguous. The verdict is a row's own: a row stays, whatever
    becomes of others of its doc_id, and rows without a doc_id are judged like
    all. Repeated rows stay or go together. An empty table stays one.
    """
    named, key = keyed(docs)
    model = train(named.where(fold() != 2).select("doc_id", "lang", "text"), per_language)
    found = identify(named.select(F.col(key).alias("doc_id"), "text"), model)
    out = found.where((F.col("lang_pred") == UNDETERMINED) | F.col("ambiguous")).select(F.col("doc_id").alias(key))
    return without_few(named, out, key).select(*docs.columns)
