"""Event logs as streams: windowed rates, sessions and a stop rule with state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, path: str) -> DataFrame:
    """A log of Parquet files as a stream, with timestamps that watermarks accept."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    source = spark.readStream.schema(schema)
    is_folder = spark.read.format("binaryFile").load(path).select("path").limit(1).first()["path"].rstrip("/").endswith(name) is False
    events = source.parquet(path) if is_folder else source.option("pathGlobFilter", name).parquet(folder)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def rates(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by type and window; rows later than the watermark are dropped."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return by.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return by.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def early_stop(scores: DataFrame, key: str, value: str, order: str, patience: int = 3) -> DataFrame:
    """Best value and steps since for each key, over all batches so far."""

    def update(k: tuple, batches, state: GroupState):
        best, since = state.get if state.exists else (float("-inf"), 0)
        rows = pd.concat(list(batches)).sort_values(order)
        for v in rows[value].dropna():
            best, since = (v, 0) if v > best else (best, since + 1)
        state.update((float(best), int(since)))
        yield pd.DataFrame({key: [k[0]], "best": [best], "since_best": [since], "stop": [since >= patience]})

    return scores.groupBy(key).applyInPandasWithState(
        update, f"{key} string, best double, since_best long, stop boolean", "best double, since long", "update", GroupStateTimeout.NoTimeout
    )


def drained(stream: DataFrame, path: str, mode: str = "complete", keys: list[str] = ()) -> DataFrame:
    """Run a stream over what there is; its results are files below ``path``, by batch, and no task or driver holds them all.

    complete: what the last batch wrote. update: what all batches wrote, or
    with ``keys`` the last row of each.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    if mode == "complete":
        last = rows.select(F.max("batch")).first()[0]
        return rows.where(F.col("batch") == last).drop("batch")
    if keys:
        others = [c for c in stream.columns if c not in keys]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("row"))
        return newest.select(*[F.col(c) if c in keys else F.col(f"row.{c}") for c in stream.columns])
    return rows.drop("batch")
