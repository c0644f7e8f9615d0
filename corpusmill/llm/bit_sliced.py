"""Exact top-k inner products over a bit-sliced index."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cells_for, scoped, scratch_dir, stored, written

#: Rows of one index block, about.
PER_BLOCK = 8_192
#: Queries of one batch, about.
PER_BATCH = 512
#: Bytes of queries that are broadcast at a time, about.
TURN_BYTES = 8 << 20
#: A component x becomes floor(SCALE * x).
SCALE = 64


def _attributes(name: str) -> Column:
    return F.transform(name, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def _valid(name: str) -> Column:
    bad = F.exists(name, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(name).isNotNull() & (F.size(name) > 0) & ~bad


class Slices:
    """A block's rows as bitmaps: ``slices[a, b]`` has bit b of attribute a of every row.

    Attributes are stored less their least value, as ``bits`` bits; rows are
    by ascending id, row r being bit r.
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, values = ids[by], values[by]
        self.low = int(values.min())
        self.bits = max(1, int(values.max() - self.low).bit_length())
        self.words = -(-len(ids) // 64)
        above = (values - self.low).astype(np.uint64).T  # attribute x row
        self.slices = np.empty((values.shape[1], self.bits, self.words), dtype=np.uint64)
        for b in range(self.bits):
            bit = np.zeros((values.shape[1], self.words * 64), dtype=np.uint8)
            bit[:, : len(ids)] = (above >> np.uint64(b)) & np.uint64(1)
            self.slices[:, b] = np.packbits(bit, axis=1, bitorder="little").view(np.uint64)
        self.values = values
        full = np.zeros(self.words * 64, dtype=np.uint8)
        full[: len(ids)] = 1
        self.rows = np.packbits(full, bitorder="little").view(np.uint64)

    def scores(self, query: np.ndarray) -> list[np.ndarray]:
        """The sum slices, least significant first, of score plus a constant.

        A weight's set bits say which slices to add at which significance;
        negative weights add complemented slices. Slices of equal significance
        are added three at a time by full adders on whole bitmaps.
        """
        levels: dict[int, list[np.ndarray]] = {}
        size = np.abs(query)
        for c in range(int(size.max()).bit_length() if len(size) else 0):
            plus = np.flatnonzero((size >> c & 1).astype(bool) & (query > 0))
            minus = np.flatnonzero((size >> c & 1).astype(bool) & (query < 0))
            for b in range(self.bits):
                part = [self.slices[plus, b], ~self.slices[minus, b]]
                levels.setdefault(b + c, []).append(np.concatenate(part))
        out, level = [], 0
        while levels:
            held = levels.pop(level, None)
            if held is None:
                out.append(np.zeros(self.words, dtype=np.uint64))
                level += 1
                continue
            now = np.concatenate(held)
            carries = []
            while len(now) > 1:
                third = len(now) // 3
                if third:
                    a, b, c = now[:third], now[third : 2 * third], now[2 * third : 3 * third]
                    half = a ^ b
                    carries.append((a & b) | (half & c))
                    now = np.concatenate([half ^ c, now[3 * third :]])
                else:
                    carries.append(now[:1] & now[1:])
                    now = now[:1] ^ now[1:]
            out.append(now[0] if len(now) else np.zeros(self.words, dtype=np.uint64))
            if carries:
                levels.setdefault(level + 1, []).append(np.concatenate(carries))
            level += 1
        return out

    def top(self, query: np.ndarray, k: int, own: int | None = None) -> np.ndarray:
        """Row numbers of the k best scores; ties go to the smaller id.

        From the most significant slice down, rows with the bit set are
        certain while they fit; what is left at the end ties at the boundary.
        """
        tied = self.rows.copy()
        if own is not None:
            at = np.searchsorted(self.ids, own)
            while at < len(self.ids) and self.ids[at] == own:
                tied[at >> 6] &= ~(np.uint64(1) << np.uint64(at & 63))
                at += 1
        sure = np.zeros_like(tied)
        count = 0
        for s in reversed(self.scores(query)):
            both = tied & s
            more = int(np.bitwise_count(both).sum())
            if count + more > k:
                tied = both
            else:
                sure |= both
                count += more
                tied &= ~s
                if count == k:
                    break
        chosen = _bits(sure)
        return np.concatenate([chosen, _bits(tied)[: k - len(chosen)]]) if len(chosen) < k else chosen


def _bits(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _pack_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    values = np.stack(pdf["v"].to_numpy())
    ids = pdf["vec_id"].to_numpy(dtype=np.int64)
    by = np.argsort(ids, kind="stable")
    small = np.result_type(np.min_scalar_type(values.min()), np.min_scalar_type(values.max()), np.int8)
    body = values[by].astype(small if small.kind == "i" else np.int64).tobytes()
    return pd.DataFrame({"dims": [values.shape[1]], "part": pdf["part"].iloc[:1].tolist(), "ids": [ids[by].tobytes()], "body": [body]})


def _matrix(ids: np.ndarray, body: bytes, dims: int) -> np.ndarray:
    kind = np.dtype(f"i{len(body) // (len(ids) * dims)}")
    return np.frombuffer(body, dtype=kind).reshape(len(ids), dims).astype(np.int64)


def _search(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[bytes, Slices] | None = None
        for batch in batches:
            for r in batch.to_pylist():
                if known is None or known[0] != r["ids"]:
                    ids = np.frombuffer(r["ids"], dtype=np.int64)
                    known = r["ids"], Slices(ids, _matrix(ids, r["body"], r["dims"]))
                index = known[1]
                queries = np.frombuffer(r["q_ids"], dtype=np.int64)
                weights = _matrix(queries, r["q_body"], r["dims"])
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for q, w in zip(queries, weights, strict=True):
                    found = index.top(w, k, q)
                    out.append((np.full(len(found), q), index.ids[found], index.values[found] @ w))
                cols = [np.concatenate([x[i] for x in out]) for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["query_id", "vec_id", "score"])

    return search


@scoped
def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, per_block: int = PER_BLOCK, per_batch: int = PER_BATCH, per_turn: int = TURN_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows but itself.

    Both tables have ``vec_id`` and ``embedding``; other columns are ignored.
    Components become floor(64 x); the score is the integer inner product,
    ties go to the smaller vec_id. Vectors that are null or empty or hold a
    null or non-finite component take no part; vectors of different lengths
    are never compared. Rows are dealt to blocks by hash, each block becomes a
    bit-sliced index and is written once; it is never shuffled again. Queries
    come in turns of at most ``per_turn`` bytes, which are broadcast: every
    task reads its blocks from the files and gives a query k rows a block at
    most, exact ones. Rows that repeat a vec_id are candidates each; a vec_id
    that queries repeat asks once, with the least of its vectors. Fewer rows
    than k: all of them. Empty tables give an empty result. Scores must fit 62
    bits.
    """

    def blocks(df: DataFrame, per: int, label: str) -> DataFrame:
        ready = df.where(_valid("embedding") & F.col("vec_id").isNotNull())
        ready = ready.select(F.col("vec_id").cast("long").alias("vec_id"), _attributes("embedding").alias("v"))
        parts = cells_for(df.count(), per)
        dealt = ready.withColumn("dims", F.size("v")).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
        packed = dealt.repartition(parts, "dims", "part").groupBy("dims", "part").applyInPandas(_pack_rows, "dims int, part long, ids binary, body binary")
        return stored(packed, label)

    once = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    index, asked = blocks(vectors, per_block, "index"), blocks(once, per_batch, "asked")
    size, last = asked.agg(F.max(F.length("ids") + F.length("body")), F.max("part")).first()
    schema = "query_id long, vec_id long, score long"
    if size is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = scratch_dir(vectors.sparkSession) + f"/found-{uuid.uuid4().hex}"
    written(found, keep=True)
    step = max(1, per_turn // size)  # batches of a turn; vectors of several lengths are as many batches of each
    for turn in range(last // step + 1):
        now = asked.where(F.col("part").between(turn * step, turn * step + step - 1))
        now = F.broadcast(now.select("dims", F.col("ids").alias("q_ids"), F.col("body").alias("q_body")))  # per_turn bytes of each length
        index.select("dims", "ids", "body").join(now, "dims").mapInArrow(_search(k), schema).write.parquet(f"{found}/turn={turn}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    met = vectors.sparkSession.read.schema(schema).parquet(f"{found}/turn=*")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
