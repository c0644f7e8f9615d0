"""Hard negatives by distributed radix selection over score windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import finite_vector, floored, scoped, scratch_dir, stored, written

#: A component x becomes floor(SCALE * x).
SCALE = 256
#: Rows of one block, at most.
PER_BLOCK = 8_192
#: Anchors that are broadcast at a time, about: what the driver ever holds of them.
PER_TURN = 4_096
#: Buckets of a histogram: a digit.
DIGITS = 64
#: Sums up to this are exact in doubles.
EXACT = 2.0**52

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Block:
    """Rows of one length: ids, labels, integer vectors."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """Inner products, a row a given vector. Doubles hold them exactly while no sum can pass 2^52."""
        norms = [np.sqrt((m.astype(np.float64) ** 2).sum(axis=1).max()) for m in (self.vectors, vectors)]
        if norms[0] * norms[1] < EXACT:
            return (vectors.astype(np.float64) @ self.vectors.astype(np.float64).T).astype(np.int64)
        return vectors.astype(np.int64) @ self.vectors.astype(np.int64).T


def _small(values: np.ndarray) -> np.ndarray:
    kind = np.result_type(np.min_scalar_type(values.min()), np.min_scalar_type(values.max()), np.int8)
    return values.astype(kind if kind.kind == "i" else np.int64)


BLOCKS = "dims int, ids binary, labels binary, body binary, norm double"


def _packed(per_block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def packed(dims: int, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        norm = float(np.sqrt((v.astype(np.float64) ** 2).sum(axis=1).max()))
        row = {"dims": dims, "ids": ids.tobytes(), "labels": labels.tobytes(), "body": _small(v).tobytes(), "norm": norm}
        return pa.RecordBatch.from_pylist([row], pa.schema([("dims", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("body", pa.binary()), ("norm", pa.float64())]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch]).combine_chunks()
            ids, labels = (table.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
            lists = table.column("v").chunk(0) if table.num_rows else None
            if lists is None:
                continue
            lengths = lists.value_lengths().to_numpy()
            for dims in np.unique(lengths):
                at = np.flatnonzero(lengths == dims)
                v = lists.take(pa.array(at)).flatten().to_numpy().reshape(len(at), dims)
                new = [ids[at], labels[at], v]
                old = held.get(int(dims))
                now = [np.concatenate(pair) for pair in zip(old, new, strict=True)] if old else new
                while len(now[0]) >= per_block:
                    yield packed(int(dims), *(x[:per_block] for x in now))
                    now = [x[per_block:] for x in now]
                held[int(dims)] = now
        for dims, now in held.items():
            if len(now[0]):
                yield packed(dims, *now)

    return pack


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.frombuffer(r["ids"], dtype=np.int64)
            kind = np.dtype(f"i{len(r['body']) // (len(ids) * r['dims'])}")
            yield Block(ids, np.frombuffer(r["labels"], dtype=np.int64), np.frombuffer(r["body"], dtype=kind).reshape(len(ids), r["dims"]))


@dataclass
class Windows:
    """Ranges of scores, each of an anchor, out of which the first rows are wanted.

    The order is by falling score, then by rising id. Window w is of anchor
    ``of[w]`` and holds its rows of the same label, or of other ones, with
    ``low[w] <= score < top[w]``. The selection narrows it digit by digit:
    ``floor[w] <= score < ceiling[w]`` holds the row that is sought, better
    scores are ``above[w]`` rows. Where one score has too many rows, the
    digits of the ids follow: ``first[w] <= id < last[w]``.
    """

    ids: np.ndarray  # of anchors
    labels: np.ndarray
    vectors: np.ndarray
    same: bool
    of: np.ndarray
    low: np.ndarray
    top: np.ndarray
    floor: np.ndarray
    ceiling: np.ndarray
    above: np.ndarray
    first: np.ndarray
    last: np.ndarray
    by_id: np.ndarray  # whether the digits of ids are being read
    open: np.ndarray

    @classmethod
    def over(cls, anchors: tuple[np.ndarray, np.ndarray, np.ndarray], same: bool, of: np.ndarray, low: np.ndarray, top: np.ndarray, ids: tuple[int, int]) -> Windows:
        n = len(of)
        whole = np.full(n, ids[0], dtype=np.int64), np.full(n, ids[1], dtype=np.int64)
        return cls(*anchors, same, of, low, top, low.copy(), top.copy(), np.zeros(n, dtype=np.int64), *whole, np.zeros(n, dtype=bool), top > low)

    def candidates(self, block: Block, only: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(its windows among ``only``, scores, ids of the rows it may take) of each anchor that has any."""
        if block.vectors.shape[1] != self.vectors.shape[1]:
            return
        by_anchor = only[np.argsort(self.of[only], kind="stable")]
        starts = np.searchsorted(self.of[by_anchor], np.arange(len(self.ids) + 1))
        for first in range(0, len(self.ids), 256):
            scores = block.scores(self.vectors[first : first + 256])
            for i in range(first, min(first + 256, len(self.ids))):
                mine = by_anchor[starts[i] : starts[i + 1]]
                if len(mine):
                    fit = ((block.labels == self.labels[i]) == self.same) & (block.ids != self.ids[i])
                    yield mine, scores[i - first][fit], block.ids[fit]

    def widths(self) -> np.ndarray:
        """Scores, or ids, of a bucket of each window."""
        span = np.where(self.by_id, self.last - self.first, self.ceiling - self.floor)
        return np.maximum(1, -(-span // DIGITS))

    def count(self, blocks: Iterable[Block]) -> np.ndarray:
        """Rows in each bucket of each open window. Buckets are by falling score, or by rising id."""
        found = np.zeros((len(self.of), DIGITS), dtype=np.int64)
        widths = self.widths()
        for block in blocks:
            for mine, scores, ids in self.candidates(block, np.flatnonzero(self.open)):
                for w in mine:
                    if self.by_id[w]:
                        held = ids[scores == self.floor[w]]
                        at = (held[(held >= self.first[w]) & (held < self.last[w])] - self.first[w]) // widths[w]
                    else:
                        held = scores[(scores >= self.floor[w]) & (scores < self.ceiling[w])]
                        at = (self.ceiling[w] - 1 - held) // widths[w]
                    found[w] += np.bincount(at, minlength=DIGITS)
        return found

    def narrow(self, found: np.ndarray, k: int, enough: int) -> None:
        """Go on in the bucket that holds the kth row; close windows of few rows."""
        upto = self.above[:, None] + np.cumsum(found, axis=1)
        bucket = np.argmax(upto >= k, axis=1)
        rest = upto[:, -1] < k  # all rows of the window are wanted
        at = np.arange(len(bucket))
        reached, before = upto[at, bucket], upto[at, bucket] - found[at, bucket]
        widths = self.widths()
        for w in np.flatnonzero(self.open):
            if rest[w]:
                self.open[w] = False
                continue
            self.above[w] = before[w]
            if self.by_id[w]:
                self.first[w] += bucket[w] * widths[w]
                self.last[w] = min(self.last[w], self.first[w] + widths[w])
                self.open[w] = reached[w] > enough and self.last[w] - self.first[w] > 1
            else:
                self.ceiling[w] -= bucket[w] * widths[w]
                self.floor[w] = max(self.floor[w], self.ceiling[w] - widths[w])
                self.open[w] = reached[w] > enough
                self.by_id[w] = self.open[w] and self.ceiling[w] - self.floor[w] == 1

    def gather(self, blocks: Iterable[Block]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window, scores, ids) of the rows that qualify, block by block."""
        for block in blocks:
            for mine, scores, ids in self.candidates(block, np.arange(len(self.of))):
                for w in mine:
                    fit = (scores >= self.floor[w]) & (scores < self.top[w])
                    if self.by_id[w]:
                        fit &= (scores > self.floor[w]) | (ids < self.last[w])
                    if fit.any():
                        yield int(w), scores[fit], ids[fit]


def _counted(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(w.of), DIGITS), dtype=np.int64) for w in shared.value]
        for block in _blocks(batches):
            for windows, total in zip(shared.value, totals, strict=True):
                total += windows.count([block])
        for part, total in enumerate(totals):
            some = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), part)), pa.array(some), *(pa.array(total[some, d]) for d in range(DIGITS))],
                ["part", "w", *(f"d{d}" for d in range(DIGITS))],
            )

    return count


def _gathered(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            for part, windows in enumerate(shared.value):
                found = [(np.full(len(ids), w), scores, ids) for w, scores, ids in windows.gather([block])]
                if found:
                    both = pd.DataFrame({k: np.concatenate([f[i] for f in found]) for i, k in enumerate(("w", "score", "id"))})
                    both = both.groupby(["w", "score", "id"], as_index=False).size()  # rows that repeat an id
                    columns = [both[c].to_numpy(dtype=np.int64) for c in ("w", "score", "id", "size")]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both), part)), *map(pa.array, columns)], ["part", "w", "score", "id", "n"])

    return gather


def _first(index: DataFrame, windows: list[Windows], k: int) -> DataFrame:
    """part, w, score, id, n, rank: the first ``k`` rows of each window, rows that repeat an id counted in ``n``.

    Rounds of histograms find the bucket that holds the kth row, the driver
    getting one row of ``DIGITS`` sums a window; then only rows that
    qualify are gathered, ``4 * k`` of a window or so.
    """
    spark = index.sparkSession
    schema = "part long, w long, " + ", ".join(f"d{d} long" for d in range(DIGITS))
    while any(w.open.any() for w in windows):
        shared = spark.sparkContext.broadcast(windows)
        sums = index.mapInArrow(_counted(shared), schema).groupBy("part", "w").agg(*(F.sum(f"d{d}").alias(f"d{d}") for d in range(DIGITS))).toPandas()
        for part, held in enumerate(windows):
            own = sums[sums["part"] == part]
            found = np.zeros((len(held.of), DIGITS), dtype=np.int64)
            found[own["w"].to_numpy(dtype=np.int64)] = own.iloc[:, 2:].to_numpy(dtype=np.int64)
            held.narrow(found, k, 4 * k)
        shared.unpersist()
    shared = spark.sparkContext.broadcast(windows)
    met = index.mapInArrow(_gathered(shared), "part long, w long, score long, id long, n long").groupBy("part", "w", "score", "id").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("part", "w").orderBy(F.desc("score"), "id")  # about 4k rows
    before = F.coalesce(F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return met.withColumn("before", before).where(F.col("before") < k).withColumn("n", F.least("n", F.lit(k) - F.col("before")))


def _each(found: DataFrame) -> DataFrame:
    """A row for each of the ``n`` rows that share an id, ranked from 1."""
    last = F.col("before") + F.col("n")
    return found.withColumn("rank", F.explode(F.sequence((F.col("before") + 1).cast("int"), last.cast("int"))))


@scoped
def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, per_block: int = PER_BLOCK, per_turn: int = PER_TURN) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has ``vec_id``, an integer ``label`` and ``embedding``; other
    columns are ignored. ``anchors`` says which rows are anchors. Components
    become floor(256 x), a score is the integer inner product with the anchor,
    higher ones come first, ties by smaller id. An anchor's positives are its
    first ``positives`` other rows of the same label. For each positive the
    first ``negatives`` rows of other labels with ``low * positive_score <=
    100 * score <= high * positive_score`` are found; a positive with none has
    no row.

    Rows without id or label, and vectors that are null, empty or hold a null
    or non-finite component, take no part; vectors of different lengths are
    never compared. Rows that repeat an id are candidates each, but never of
    their own anchor; an anchor id that repeats asks once, with its least
    label and vector. Empty tables give an empty result. Scores must fit 62
    bits.

    Tasks pack the rows that they read into blocks, which are written once and
    not shuffled. Anchors come in turns of about ``per_turn``. A turn takes a
    few passes over the blocks: in each, tasks add up histograms of all
    windows, one digit finer where the kth row lies, and only the sums move.
    """
    spark = vectors.sparkSession
    ready = vectors.where(finite_vector("embedding") & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    asked = ready.withColumn("_anchor", F.coalesce(anchors, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), floored("embedding", SCALE).alias("v"), "_anchor")
    index = stored(asked.select("vec_id", "label", "v").mapInArrow(_packed(per_block), BLOCKS), "blocks")
    once = asked.where("_anchor").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("least")).select("vec_id", "least.*")
    ids = asked.agg(F.min("vec_id"), F.max("vec_id"), F.count_if("_anchor")).first()
    turns = max(1, -(-ids[2] // per_turn))
    path = scratch_dir(spark) + f"/anchors-{uuid.uuid4().hex}"
    written(path)
    once.withColumn("turn", F.pmod(F.xxhash64("vec_id"), F.lit(turns))).repartition("turn").write.partitionBy("turn").parquet(path)
    bounds = stored(index.groupBy("dims").agg(F.max("norm").alias("norm")), "norms")  # a row a length
    found = scratch_dir(spark) + f"/mined-{uuid.uuid4().hex}"
    written(found, keep=True)
    spark.createDataFrame([], RESULT).write.parquet(f"{found}/turn=none")
    for turn in range(turns if ids[0] is not None else 0):
        now = spark.read.schema("vec_id long, label long, v array<long>, turn int").parquet(path).where(F.col("turn") == turn).toPandas()
        if len(now):
            _turn(index, now, bounds, (ids[0], ids[1] + 1), positives, negatives, low, high).write.parquet(f"{found}/turn={turn}")
    return spark.read.schema(RESULT).parquet(f"{found}/turn=*")


def _turn(index: DataFrame, now: pd.DataFrame, bounds: DataFrame, ids: tuple[int, int], positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result for a turn's anchors; the driver holds them and their windows."""
    spark = index.sparkSession
    lengths = now["v"].map(len).to_numpy()
    norms = {r["dims"]: r["norm"] for r in bounds.where(F.col("dims").isin([int(x) for x in np.unique(lengths)])).collect()}
    first: list[Windows] = []
    for dims in np.unique(lengths):
        own = now[lengths == dims]
        anchors = own["vec_id"].to_numpy(dtype=np.int64), own["label"].to_numpy(dtype=np.int64), np.stack(own["v"].to_numpy()).astype(np.int64)
        norm = np.sqrt((anchors[2].astype(np.float64) ** 2).sum(axis=1))
        most = np.minimum(np.ceil(norm * norms[int(dims)] * (1 + 1e-9)) + 1, 2.0**61).astype(np.int64)  # no score is larger
        first.append(Windows.over(anchors, True, np.arange(len(own)), -most, most + 1, ids))
    near = _each(_first(index, first, positives)).toPandas().sort_values(["part", "w", "rank"])  # a turn's positives
    second, said = [], []
    for part, of in enumerate(first):
        own = near[near["part"] == part]
        score = own["score"].to_numpy(dtype=np.int64)
        least, most = -((-low * score) // 100), (high * score) // 100 + 1
        second.append(Windows.over((of.ids, of.labels, of.vectors), False, own["w"].to_numpy(dtype=np.int64), least, np.maximum(most, least), ids))
        said.append(pd.DataFrame({"part": part, "w": np.arange(len(own)), "anchor_id": of.ids[own["w"].to_numpy(dtype=np.int64)], "positive_id": own["id"].to_numpy(dtype=np.int64), "positive_score": score}))
    pairs = spark.createDataFrame(pd.concat(said).astype("int64"), "part long, w long, anchor_id long, positive_id long, positive_score long")
    taken = _each(_first(index, second, negatives)).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    return taken.join(F.broadcast(pairs), ["part", "w"]).select(*(c.split()[0] for c in RESULT.split(", ")))
