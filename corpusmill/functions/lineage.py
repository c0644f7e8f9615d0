"""Cutting lineage with files that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; on one machine else one in the warehouse, on a cluster else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints").rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def saved(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read back: computed once, and recomputed from files only."""
    spark = rows.sparkSession
    path = scratch(spark, "saved")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


#: Rows of one range, about.
PER_RANGE = 1_000_000


def few(rows: DataFrame) -> bool:
    """Whether the rows are one range."""
    return rows.count() <= PER_RANGE


def ranged(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``cell``: about equally full ranges of ``value`` in its order, of ``PER_RANGE`` rows, but no more than the session has shuffle partitions.

    What is numbered or summed in order is then so within a cell, behind the
    sums of the cells before; no single task orders all values. Equal values
    share a cell, nulls are in the first one. The rows are computed once; what
    the ranges are is told from the written table.
    """
    kept = saved(rows)
    parts = min(-(-kept.count() // PER_RANGE), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if parts <= 1:
        return kept.withColumn("cell", F.lit(0))
    return saved(kept.repartitionByRange(parts, value).withColumn("cell", F.spark_partition_id()))


def behind(sums: DataFrame, *columns: str) -> DataFrame:
    """For each cell, the sums of all cells before it: one row a cell."""
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    so_far: list[Column] = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in columns]
    return sums.select("cell", *so_far)


#: Parts that a group is dealt to before its first rows are told.
PARTS = 64


def first_of(rows: DataFrame, by: str, order: list[Column | str], k: int, key: str) -> DataFrame:
    """The first k rows of each group with ``nth``, from 1 on: first those of parts of it, by hash of the key, then those of the whole."""
    part = F.pmod(F.xxhash64(key), F.lit(PARTS))
    some = rows.withColumn("_part", part).withColumn("nth", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order))).where(F.col("nth") <= k)
    return some.drop("_part").withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("nth") <= k)


def with_runs(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """``rows`` with ``run``: the number, in its group, of the run of equal values in a row that it is in; null equals null.

    Ranges of the order go each by itself; of the ranges before, only the last
    value and the number of changes are needed.
    """
    if few(rows):  # one range: nothing is before it
        w = Window.partitionBy(by).orderBy(order)
        same = (F.row_number().over(w) > 1) & F.col(value).eqNullSafe(F.lag(value).over(w))
        return rows.withColumn("_change", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("_change").over(w)).drop("_change")
    cells, inside = ranged(rows, order), Window.partitionBy(by, "cell").orderBy(order)
    along = Window.partitionBy(by).orderBy("cell")  # a row a range
    last = cells.groupBy(by, "cell").agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("end"))
    last = last.select(by, "cell", F.lag("end").over(along).alias("before"))
    was = F.coalesce(F.lag(F.struct(F.col(value).alias("v"))).over(inside), F.col("before"))
    changed = cells.join(last, [by, "cell"]).withColumn("_change", F.when(was.isNotNull() & was["v"].eqNullSafe(F.col(value)), 0).otherwise(1))
    sums = changed.groupBy(by, "cell").agg(F.sum("_change").alias("c"))
    sums = sums.select(by, "cell", F.coalesce(F.sum("c").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_runs"))
    run = F.col("_runs") + F.sum("_change").over(inside)
    return changed.join(sums, [by, "cell"]).withColumn("run", run).drop("_change", "_runs", "before", "cell")
