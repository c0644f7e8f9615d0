"""Exact similarity search that ships short codes instead of vectors.

Unit vectors are turned into codes of small integers whose error is known, so
that a code tells bounds of any cosine. Codes are packed into blocks; only
pairs of blocks that can hold a match meet, of them only codes move, and only
pairs of vectors that the bounds leave open are computed from the vectors.
Where many pairs are similar, the vectors of those would be more than all
blocks: there the code is the vector itself, and pairs are told where blocks meet.

Which blocks can match is told by balls: a block's vectors have one nearest
pivot, and its summary has the least and the greatest angle to each pivot. By
the triangle inequality two vectors are at least as far apart as their angles
to any pivot differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.columns import dot, norm, rounded
from corpusmill.functions.lineage import saved

#: Vectors of one block of codes: the larger, the less often a block is copied for another one.
BLOCK = 65_536
#: Smaller tables are cut into a few blocks as well, of so many vectors at least, for tasks to share.
SPREAD, LEAST = 4, 500
#: Vectors of one block where the code is the vector itself.
WHOLE = 16_384
#: Vectors of one block of a search: smaller ones leave more rows to rank, as each block gives every query its k best.
NEAR = 16_384
#: Share of similar pairs from which on that is less to ship: a pair left open takes about 600 bytes, a vector eight a dimension.
DENSE = 2.5e-5
#: Cosines that a task holds at a time: as many vectors of a block as that allows are compared with another block.
CELLS = 1_000_000
#: Pivots: sampled vectors that lie far apart, at most.
PIVOTS = 64


@dataclass(frozen=True)
class Code:
    """How unit vectors are coded: turned by ``axes``, the first coordinates as integers, the length of the rest."""

    axes: np.ndarray  # dimension x coordinate, orthonormal
    kept: int
    kind: str  # of integer, or float64

    @property
    def whole(self) -> bool:
        return self.kind == "float64"

    @property
    def scale(self) -> int:
        return 1 if self.whole else np.iinfo(self.kind).max

    @property
    def wide(self) -> type:
        """What products are computed in."""
        return np.float32 if self.kind == "int8" else np.float64

    @property
    def error(self) -> float:
        """How far the product of two codes is from that of the coordinates at most."""
        off = 0.0 if self.whole else 0.5 * np.sqrt(self.kept) / self.scale
        return off * (2 + off) + 1e-9

    def of(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.whole:
            return unit, np.zeros(len(unit))
        turned = unit @ self.axes
        rest = np.sqrt(np.maximum(0.0, (turned[:, self.kept :] ** 2).sum(axis=1)))
        return np.rint(turned[:, : self.kept] * self.scale).astype(self.kind), rest

    def bounds(self, one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(middle, half width) of the interval that holds each cosine; a row a vector of the first table."""
        middle = (one[0].astype(self.wide, copy=False) @ two[0].astype(self.wide, copy=False).T).astype(np.float64, copy=False)
        if not self.whole:
            middle /= self.scale**2
        if self.kept == len(self.axes):  # no rests
            return middle, np.full((1, 1), self.error)
        return middle, one[1][:, None] * two[1][None, :] + self.error


#: Vectors, chosen by hash, on which codes are tried: that choice alters the time, not the rows.
SAMPLE = 1_000


def code_for(x: np.ndarray, least: float) -> Code:
    """The shortest code that leaves few pairs open at this similarity.

    Tried on pairs of a sample ``x`` of unit vectors are a byte each for the
    half of its principal coordinates that vary most, a byte for all, two
    bytes for all: 40, 72 and 136 bytes at 64 dimensions, where the vector has
    512. A code leaves few open if that is at most four times the pairs that
    are similar, or one in 2,000. Bounds hold on any axes, so that the sample
    decides about the time only.
    """
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1]
    dims = len(axes)
    cosines = x @ x.T
    most = max(4 * (cosines >= least).mean(), 1 / len(x) + 1 / 2_000)
    codes = [Code(axes, -(-dims // 2), "int8"), Code(axes, dims, "int8"), Code(axes, dims, "int16")]
    for code in codes[:-1]:
        own = code.of(x)
        if (np.add(*code.bounds(own, own)) >= least - 1e-6).mean() <= most:
            return code
    return codes[-1]


def full_code(dims: int) -> Code:
    """Two bytes for each coordinate: a quarter of the vector's bytes, cosines to about 1 / 4,000 at a hundred dimensions."""
    return Code(np.eye(dims), dims, "int16")


def whole_code(dims: int) -> Code:
    """The vector itself."""
    return Code(np.eye(dims), dims, "float64")


def dense(x: np.ndarray, least: float) -> bool:
    """Whether so many pairs of a sample of unit vectors are similar that vectors are shipped by blocks, not by pairs."""
    return (x @ x.T >= least).sum() - len(x) > DENSE * len(x) * (len(x) - 1)


def sampled(rows: DataFrame, key: str, vector: str, most: int) -> np.ndarray:
    """``most`` unit vectors at most, by hash of the key; zero vectors left out."""
    held = rows.where(F.col(vector).isNotNull()).select(F.xxhash64(F.lit(3), key).alias("h"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    found = [r["v"] for r in held.orderBy("h", "v").limit(most).collect()]
    if not found:
        return np.zeros((0, 0))
    x = np.array(found)
    size = np.linalg.norm(x, axis=1)
    return x[size > 0] / size[size > 0, None]


def spread_out(x: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Of unit vectors, each time the one farthest from those chosen, so that every cluster gets one."""
    chosen, near = [], np.full(len(x), -2.0)
    while len(chosen) < min(most, len(x)):
        chosen.append(int(near.argmin()) if chosen else 0)
        near = np.maximum(near, x @ x[chosen[-1]])
        if near.min() > 1 - 1e-9:
            break
    return x[chosen]


def _unit(lists: pa.Array) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1.0, size)


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


BLOCKS = "block int, cell int, low array<double>, high array<double>, ids binary, extra binary, body binary, rest binary"


def _packed(code: Code, pivots: np.ndarray, block: str, extra: bool) -> Callable:
    def pack(table: pa.Table) -> pa.Table:
        unit = _unit(table.column("v").combine_chunks())
        angles = _angles(unit, pivots) if len(pivots) else np.zeros((len(unit), 0))
        body, rest = code.of(unit)
        row = {
            "block": table.column(block)[0].as_py(), "cell": table.column("cell")[0].as_py(),
            "low": angles.min(axis=0).tolist(), "high": angles.max(axis=0).tolist(),
            "ids": table.column("id").to_numpy().astype(np.int64).tobytes(),
            "extra": table.column("extra").to_numpy().astype(np.int64).tobytes() if extra else b"",
            "body": body.tobytes(), "rest": rest.tobytes(),
        }
        return pa.Table.from_pylist([row], pa.schema([("block", pa.int32()), ("cell", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), *((c, pa.binary()) for c in ("ids", "extra", "body", "rest"))]))

    return pack


def blocks(rows: DataFrame, key: str, vector: str, code: Code, pivots: np.ndarray, extra: str | None = None, size: int = BLOCK) -> tuple[DataFrame, int]:
    """Codes of the vectors by block, and how many blocks there are at most: a cell is the vectors of one nearest pivot, a large one is several blocks by hash of the key."""
    ready = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), (F.col(extra).cast("long") if extra else F.lit(None).cast("long")).alias("extra"))

    @F.pandas_udf("int")
    def closest(v: pd.Series) -> pd.Series:
        unit = np.stack(v.to_numpy())
        unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
        return pd.Series(_angles(unit, pivots).argmin(axis=1).astype("int32"))

    total = ready.count()
    if total <= size or not len(pivots):
        n = max(-(-total // size), min(SPREAD, total // LEAST), 1)
        placed = ready.withColumn("cell", F.lit(0)).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    else:
        placed = saved(ready.withColumn("cell", closest("v")))
        held = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a pivot
        ways = [max(1, -(-held.get(c, 0) // size)) for c in range(len(pivots))]
        first = [sum(ways[:c]) for c in range(len(pivots))]
        n = sum(ways)
        of = lambda values: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("cell") + 1)
        placed = placed.withColumn("block", (of(first) + F.pmod(F.xxhash64("id"), of(ways))).cast("int"))
    packed = placed.groupBy("block").applyInArrow(_packed(code, pivots, "block", bool(extra)), BLOCKS)
    return (saved(packed) if total > size else packed), n  # a table of one block is packed as fast as it is read


def meeting(left: DataFrame, right: DataFrame, n: int, angle: float | None, ordered: bool = False) -> DataFrame:
    """(a, b): the pairs of blocks that may hold vectors within this angle of each other, from the summaries alone; the right table has ``n``."""
    one = left.select(F.col("block").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"))
    two = right.select(F.col("block").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    both = one.withColumn("b", F.explode(F.sequence(F.col("a") if ordered else F.lit(0), F.lit(n - 1)))).join(two, "b")  # summaries only
    if angle is not None:
        apart = F.zip_with(F.arrays_zip("la", "ha"), F.arrays_zip("lb", "hb"), lambda x, y: F.greatest(x["la"] - y["hb"], y["lb"] - x["ha"]))
        both = both.where(~F.exists(apart, lambda x: x > angle + 1e-7))
    return both.select("a", "b")


#: Columns that a task needs of a block.
HELD = ("block", "ids", "extra", "body", "rest")


@dataclass
class Held:
    """A block in a task."""

    block: int
    ids: np.ndarray
    extra: np.ndarray
    codes: tuple[np.ndarray, np.ndarray]

    @classmethod
    def of(cls, row: pa.StructScalar, code: Code) -> Held:
        held = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)
        ids = held("ids", np.int64)
        body = held("body", code.kind).reshape(len(ids), -1).astype(code.wide, copy=False)  # once a block, not once a slice
        return cls(row["block"].as_py(), ids, held("extra", np.int64), (body, held("rest", np.float64)))

    def cut(self, at: int, size: int) -> Held:
        to = slice(at, at + size)
        return Held(self.block, self.ids[to], self.extra[to], (self.codes[0][to], self.codes[1][to]))


def candidates(left: DataFrame, right: DataFrame, met: DataFrame, code: Code, take: Callable[[Held, Held, np.ndarray, np.ndarray], pa.Table | None], schema: str) -> DataFrame:
    """take(some of a block, another block, middles, half widths) for all pairs of blocks that meet."""
    one = left.select(F.col("block").alias("a"), F.struct(*HELD).alias("one"))
    two = right.select(F.col("block").alias("b"), F.struct(*HELD).alias("two"))
    return compared(met.join(one, "a").join(two, "b"), code, take, schema)


def every_pair(left: DataFrame, m: int, right: DataFrame, n: int) -> DataFrame:
    """(one, two): each of the ``m`` left blocks with each of the ``n`` right ones, dealt to tasks by pair.

    Joined by the one block and then by the other, pairs would be in as many
    tasks as there are blocks, or in one where a table is small enough to be broadcast.
    """
    one = left.select(F.col("block").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"), F.struct(*HELD).alias("one"))
    two = right.select(F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("a"), F.col("block").alias("b"), F.struct(*HELD).alias("two"))
    return one.hint("merge").join(two, ["a", "b"])


def compared(pairs: DataFrame, code: Code, take: Callable[[Held, Held, np.ndarray, np.ndarray], pa.Table | None], schema: str) -> DataFrame:
    """take(some of a block, another block, middles, half widths) for all pairs (one, two) of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(*batch.columns, strict=True):
                x, y = Held.of(one, code), Held.of(two, code)
                step = max(1, CELLS // len(y.ids))
                for at in range(0, len(x.ids), step):
                    part = x.cut(at, step)
                    found = take(part, y, *code.bounds(part.codes, y.codes))
                    if found is not None and found.num_rows:
                        yield from found.to_batches()

    return pairs.select("one", "two").mapInArrow(run, schema)


def _vectors(rows: DataFrame, key: str, vector: str, id_name: str, name: str) -> DataFrame:
    v = F.transform(vector, lambda x: x.cast("double"))
    return rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(id_name), v.alias(name), norm(v).alias(f"n_{name}"))


def _cosine(found: DataFrame, one: DataFrame, two: DataFrame, a: str, b: str) -> DataFrame:
    """The candidates with their cosine, rounded; a zero vector has cosine 0 with all."""
    size = F.col("n_x") * F.col("n_y")
    cosine = F.when(size == 0, 0.0).otherwise(dot("x", "y") / size)
    return found.join(one, a).join(two, b).withColumn("similarity", rounded(cosine, 6)).drop("x", "y", "n_x", "n_y")


def pairs_above(rows: DataFrame, key: str, vector: str, least: float, differ: str | None = None, size: int = BLOCK) -> DataFrame:
    """(a, b, similarity) of all pairs a < b with at least this cosine; only across the integer ``differ`` if given.

    Keys are unique integers. The bound of a pair is the product of their
    codes, plus what the rests can add at most, plus the codes' error; what it
    leaves open is computed from the vectors. Where a sample has many similar
    pairs, blocks hold the vectors and nothing is left open.
    """
    some = rows.where(F.col(vector).isNotNull())
    sample = sampled(some, key, vector, SAMPLE)
    if not len(sample):  # zero vectors are similar to nothing
        return rows.sparkSession.createDataFrame([], "a long, b long, similarity double")
    many = dense(sample, least)
    code, pivots = whole_code(sample.shape[1]) if many else code_for(sample, least), spread_out(sample)
    size = min(size, WHOLE) if many else size
    reach = np.ceil(least * 1e6 - 1e-6) / 1e6 - 5e-7 if many else least - 1e-6  # rounded to six places, this is the least
    own, n = blocks(some, key, vector, code, pivots, differ, size)

    def take(x: Held, y: Held, middle: np.ndarray, half: np.ndarray) -> pa.Table:
        i, j = np.nonzero(middle >= reach) if many else np.nonzero(middle + half >= reach)
        ok = x.ids[i] < y.ids[j] if x.block == y.block else np.ones(len(i), dtype=bool)
        if differ:
            ok &= x.extra[i] != y.extra[j]
        i, j = i[ok], j[ok]
        p, q = x.ids[i], y.ids[j]
        pair = {"a": np.minimum(p, q), "b": np.maximum(p, q)}
        return pa.table(pair | {"cosine": middle[i, j]} if many else pair)

    angle = float(np.arccos(np.clip(least - 1e-6, -1.0, 1.0)))
    found = candidates(own, own, meeting(own, own, n, angle, ordered=True), code, take, "a long, b long, cosine double" if many else "a long, b long")
    if many:
        return found.select("a", "b", rounded("cosine", 6).alias("similarity"))
    met = _cosine(found, _vectors(some, key, vector, "a", "x"), _vectors(some, key, vector, "b", "y"), "a", "b")
    return met.where(F.col("similarity") >= least).select("a", "b", "similarity")


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, own: bool = False, size: int = NEAR) -> DataFrame:
    """Each query's k most similar rows: (query, rank, id, similarity), ties by smaller id; a row of the query's id only with ``own``.

    Codes tell each cosine but for a small error; a block gives a query the
    rows that may be among its k best, k and a few, of which the best are
    computed from the vectors.
    """
    first = rows.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
    if first is None:
        return rows.sparkSession.createDataFrame([], "query long, rank int, id long, similarity double")
    code, none = full_code(first["n"]), np.zeros((0, 0))
    (asked, m), (held, n) = (blocks(t, key, vector, code, none, size=size) for t in (queries, rows))

    def take(x: Held, y: Held, middle: np.ndarray, half: np.ndarray) -> pa.Table:
        if not own:
            middle[x.ids[:, None] == y.ids[None, :]] = -3.0
        n, half = min(k, middle.shape[1]), half[0, 0]  # the code has no rests
        kth = middle.max(axis=1) if n == 1 else np.partition(middle, middle.shape[1] - n, axis=1)[:, middle.shape[1] - n]
        i, j = np.nonzero((middle >= kth[:, None] - 2 * half - 2e-6) & (middle > -2))
        found = middle[i, j]
        return pa.table({"query": x.ids[i], "id": y.ids[j], "low": found - half, "high": found + half})

    met = compared(every_pair(asked, m, held, n), code, take, "query long, id long, low double, high double")
    own_rows = Window.partitionBy("query")  # k and a few of each block
    ranked = met.withColumn("nth", F.row_number().over(own_rows.orderBy(F.desc("low"))))
    kth = F.max(F.when(F.col("nth") == k, F.col("low"))).over(own_rows)
    open_ = ranked.withColumn("kth", kth).where(F.col("kth").isNull() | (F.col("high") >= F.col("kth") - 2e-6)).select("query", "id")
    exact = _cosine(open_, _vectors(queries, key, vector, "query", "x"), _vectors(rows, key, vector, "id", "y"), "query", "id")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "similarity")
