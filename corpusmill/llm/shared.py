"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whitespace that separates words, as a Java character class body (fixed values).
SPACE = r"\x20\x09-\x0D"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Where a session on one machine names none, as in tests, a folder in the
    warehouse is set and used. On a cluster that is an error: its executors
    might not see what others write there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/corpusmill-scratch"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Paths written in each open scope, the innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete at its end what ``stored`` wrote in it.

    Tables that the result is still computed from are stored with ``keep``:
    they belong to the scope around this one, or to the session's owner.
    """
    written: list[str] = []
    token = _scopes.set((*_scopes.get(), written))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in written:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(path: str, keep: bool = False) -> None:
    """Have the innermost open scope, or the one around it, delete this path at its end."""
    scopes = _scopes.get()[:-1] if keep else _scopes.get()
    if scopes:
        scopes[-1].append(path)


def scoped(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator on a table, run in a scope of its own."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        with scope(docs.sparkSession):
            return operator(docs, *args, **kwargs)

    return run


def stored(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table cuts the lineage: what follows can be recomputed from
    files that every executor sees, however many executors are lost. It goes
    at the end of the innermost open ``scope``, with ``keep`` of the one
    around that; outside of scopes it stays.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    written(path, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents, and a column that tells each row from all others.

    That is ``doc_id`` where no row lacks it and no two rows share it. Else
    the rows are written once with a number each, and what is decided about a
    row never falls on another one of the same doc_id.
    """
    if docs.where(F.col("doc_id").isNull()).isEmpty() and docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs, "doc_id"
    name = "row"
    while name in docs.columns:
        name = f"_{name}"
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered", keep=True), name


def whole_text(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def finite_vector(name: str) -> Column:
    """Whether an array is there, not empty, and all its entries are finite numbers."""
    bad = F.exists(name, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(name).isNotNull() & (F.size(name) > 0) & ~bad


def floored(name: str, scale: int) -> Column:
    """floor(scale * x) of each entry x, as double, of an array."""
    return F.transform(name, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def cells_for(rows: int, per_cell: int, least: int = 1) -> int:
    """How many cells hold ``rows`` rows at about ``per_cell`` each."""
    return max(least, -(-rows // per_cell))


#: Most bits of a membership filter: what is ever broadcast of one, 8 MB.
FILTER_BITS = 1 << 26


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = hashes.view(np.uint64)
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _bitmap(bits: int):
    def collect(batches):
        held = np.zeros(bits, dtype=bool)
        for pdf in batches:
            for slot in _slots(pdf["h"].to_numpy(), bits):
                held[slot] = True
        words = np.packbits(held, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pd.DataFrame({"at": at, "word": words[at]})

    return collect


def _maybe_in(ids: DataFrame, key: str) -> Column:
    """Whether a row's key may be among the ids: a Bloom filter of a fixed most size.

    With more ids than it can tell apart it holds for more rows, and only that.
    """
    n = ids.count()
    bits = min(FILTER_BITS, 1 << max(10, (16 * n).bit_length()))
    found = ids.select(F.xxhash64(key).alias("h")).mapInPandas(_bitmap(bits), "at long, word long")
    words = found.groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()  # FILTER_BITS / 64 rows at most
    held = np.zeros(bits // 64, dtype=np.int64)
    held[words["at"].to_numpy()] = words["word"].to_numpy()
    shared = ids.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf(T.BooleanType())
    def maybe(h: pd.Series) -> pd.Series:
        mask = shared.value.view(np.uint64)
        out = np.ones(len(h), dtype=bool)
        for slot in _slots(h.to_numpy(), bits):
            out &= (mask[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return pd.Series(out)

    return maybe(F.xxhash64(key))


def joined_few(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``df`` left semi join ``ids`` on ``key``, for wide rows of which few are wanted.

    Only rows that a filter of the ids lets through are shuffled; the join that
    follows is exact.
    """
    ids = stored(ids, "ids", keep=True)
    return df.where(_maybe_in(ids, key)).join(ids, key, "left_semi")


def without_few(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``df`` left anti join ``ids`` on ``key``, for wide rows of which few go.

    Rows that a filter of the ids rules out stay where they are; the others
    are joined.
    """
    ids = stored(ids, "ids", keep=True)
    maybe = _maybe_in(ids, key)
    return df.where(~maybe).unionByName(df.where(maybe).join(ids, key, "left_anti").select(*df.columns))


#: A key is hot from this share of all rows on, so that there are at most as many hot keys.
MOST_HOT = 1_024
#: Rows of one key that are never too many.
FEW = 256


def joined_hot(many: DataFrame, one: DataFrame, key: str, wide: bool = False, how: str = "inner") -> DataFrame:
    """``many`` join ``one`` on ``key``, which a large share of ``many`` may have in common (``how``: inner or left).

    ``one`` has a key once at most. Keys of over 1 / MOST_HOT of the rows of
    ``many``, and so under MOST_HOT of them, are counted out (the counts are
    pre-aggregated): their rows of ``one`` are broadcast if they are narrow,
    else (inner joins only) dealt to as many copies as the key has such
    shares, and the rows of ``many`` over the copies by a hash of their other
    columns. All other keys are joined as usual. ``many`` is read several
    times and should be a stored table.
    """
    total = many.count()
    if total <= FEW:  # no key has more
        return many.join(one, key, how)
    least = max(FEW, total / MOST_HOT)
    found = many.groupBy(key).count().where(F.col("count") > least).select(key, F.ceil(F.col("count") / least).alias("_shares"))
    held = found.collect()  # MOST_HOT keys at most
    if not held:
        return many.join(one, key, how)
    hot = F.broadcast(many.sparkSession.createDataFrame(held, found.schema))
    cold = many.join(hot.drop("_shares"), key, "left_anti").join(one, key, how)
    if not wide:
        return cold.unionByName(many.join(F.broadcast(hot.drop("_shares").join(one, key, how)), key))
    others = [c for c in many.columns if c != key]
    dealt = many.join(hot, key).withColumn("_share", F.pmod(F.xxhash64(*others), F.col("_shares"))).drop("_shares")
    copies = one.join(hot, key).withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1))).drop("_shares")
    return cold.unionByName(dealt.join(copies, [key, "_share"]).select(*cold.columns))
