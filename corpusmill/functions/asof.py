"""Joins by the nearest value instead of an equal one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.lineage import ranged


def _laid_out(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str, columns: list[str]) -> tuple[DataFrame, Column]:
    """Both tables' rows in ranges of time; right rows carry themselves as ``_match``."""
    own = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    match = F.struct(F.col(right_at).alias("_at"), *[F.col(c) for c in columns])
    keys = lambda: [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    one = left.select(own.alias("_row"), F.col(at).alias("_at"), *keys())
    two = right.where(F.col(right_at).isNotNull()).select(F.lit(None).cast(one.schema["_row"].dataType).alias("_row"), F.col(right_at).cast(one.schema["_at"].dataType).alias("_at"), *keys(), match.alias("_match"))
    one = one.withColumn("_match", F.lit(None).cast(two.schema["_match"].dataType))
    return ranged(one.unionByName(two), "_at"), F.col("_row").isNotNull()


def _last_before(rows: DataFrame, keys: list[str], forward: bool, equal_too: bool) -> DataFrame:
    """``rows`` with ``_found``: the last right row up to each row, or, forward, the next one from it on."""
    time = F.desc("_at") if forward else F.col("_at").asc()
    is_left = F.col("_row").isNotNull().cast("int")
    first_right = is_left.asc() if equal_too else is_left.desc()  # of equal times, which rows come before a left one
    inside = Window.partitionBy(*keys, "cell").orderBy(time, first_right).rowsBetween(Window.unboundedPreceding, 0)
    cell = F.desc("cell") if forward else F.col("cell").asc()
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    pick = F.min_by if forward else F.max_by
    ends = rows.where("_match is not null").groupBy(*keys, "cell").agg(pick("_match", "_at").alias("_end"))
    every = rows.select(*keys, "cell").distinct()
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in [*keys, "cell"]]
    ends = every.alias("e").join(ends.alias("f"), same("e", "f"), "left").select(*[f"e.{k}" for k in [*keys, "cell"]], "_end")
    carried = ends.select(*keys, "cell", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    found = rows.withColumn("_here", F.last("_match", ignorenulls=True).over(inside))
    joined = found.alias("x").join(carried.alias("c"), same("x", "c")).select("x.*", "_carried")
    return joined.withColumn("_found", F.coalesce("_here", "_carried")).drop("_here", "_carried")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str, columns: list[str], how: str = "backward", equal_too: bool = True) -> DataFrame:
    """Each left row with ``columns`` of the right row of the same key that is nearest in time; nulls where there is none.

    how: ``backward`` takes the last right row up to the left one's time,
    ``forward`` the first from it on, ``nearest`` the closer of both, the
    earlier of equally near ones. ``equal_too`` says whether a right row of
    the same time counts. Null keys are a key; a left row without a time
    matches nothing; of right rows of one key and time any one is taken, so
    they should be one. A left row stays one row.

    Both tables are laid out together in equally full ranges of time, and each
    range of a key is read once in order, so that a key that holds most rows
    is many tasks; of the ranges before, one row a key is needed. No pairs are
    made.
    """
    rows, is_left = _laid_out(left, right, by, at, right_at, columns)
    keys = [f"_by{i}" for i in range(len(by))]
    keys = keys or ["_one"]
    if not by:
        rows = rows.withColumn("_one", F.lit(0))
    timed = F.col("_at").isNotNull()
    if how in ("backward", "nearest"):
        rows = _last_before(rows, keys, False, equal_too).withColumnRenamed("_found", "_b")
    if how in ("forward", "nearest"):
        rows = _last_before(rows, keys, True, equal_too).withColumnRenamed("_found", "_f")
    if how == "nearest":
        far = lambda m: F.abs(F.col("_at").cast("double") - F.col(f"{m}._at").cast("double"))
        best = F.when(F.col("_f").isNull() | (far("_b") <= far("_f")), F.col("_b")).otherwise(F.col("_f"))
    else:
        best = F.col("_b" if how == "backward" else "_f")
    found = rows.where(is_left).withColumn("_best", F.when(timed, best))
    return found.select("_row.*", *[F.col(f"_best.{c}").alias(c) for c in columns])
