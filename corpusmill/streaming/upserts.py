"""Streams into tables of one row a key, safe to replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VERSION = T.StructField("batch", T.LongType())


def upsert_stream(stream: DataFrame, path: str, keys: list[str], order: str, fail_at: int | None = None):
    """Start a query that keeps, below ``path``, the rows of each batch as a partition of its own.

    A batch is written under its number and replaces what was there, so that
    one that is replayed after a failure, in part or whole, changes nothing.
    Of a batch, each key's row of the greatest ``order`` is kept. Files of a
    batch appear together, when its partition is renamed into place; readers
    never see half of one. ``fail_at``: for tests, the batch behind whose
    write the query dies before it can commit.
    """

    def keep(batch: DataFrame, n: int) -> None:
        others = [c for c in batch.columns if c not in keys]
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_row")).select(*keys, "_row.*")
        newest.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
        if fail_at == n:
            raise RuntimeError(f"stopped behind batch {n}")

    return stream.writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(keep).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: str) -> DataFrame:
    """The table: each key's row of the greatest ``order``, of equal ones the latest batch's."""
    rows = spark.read.schema(T.StructType([*schema.fields, _VERSION])).parquet(f"{path}/rows")
    others = [f.name for f in schema.fields if f.name not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(order, "batch")).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}") for c in others])


def compacted(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: str, upto: int) -> None:
    """Put the rows of batches up to ``upto`` into one, each key once; later batches stay as they are.

    The merged rows are written as batch ``upto`` only when they are complete
    elsewhere, and only then the older ones go: a failure in between leaves
    rows twice, which ``latest`` does not see.
    """
    rows = spark.read.schema(T.StructType([*schema.fields, _VERSION])).parquet(f"{path}/rows").where(F.col("batch") <= upto)
    others = [f.name for f in schema.fields if f.name not in keys]
    merged = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(order, "batch")).alias("_row")).select(*keys, *[F.col(f"_row.{c}") for c in others])
    merged.write.mode("overwrite").parquet(f"{path}/merged")
    spark.read.schema(schema).parquet(f"{path}/merged").write.mode("overwrite").parquet(f"{path}/rows/batch={upto}")
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in system.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith("batch=") and int(name.removeprefix("batch=")) < upto:
            system.delete(entry.getPath(), True)


def with_passed_kept(new: DataFrame, known: DataFrame, keys: list[str], passed: str) -> DataFrame:
    """What a rerun has to do: the new rows whose key has not passed yet (incremental evaluation)."""
    done = known.where(F.col(passed)).select(*keys).distinct()
    return new.join(done, keys, "left_anti")
