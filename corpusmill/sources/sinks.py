"""Writers: splits, upserts, logs, checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A CSV of the given columns; others are left out, missing ones are empty."""
    have = df.columns
    out = df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns]) if columns else df
    flat(out).write.mode("overwrite").option("header", True).csv(path)


def splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder for each split; what was there before is replaced."""
    (flat(df) if fmt == "csv" else df).write.mode("overwrite").partitionBy("split").format(fmt).save(path)


def upsert(new: DataFrame, path: str, key: str, partition: str) -> None:
    """Append rows of unknown keys, in the partitions they belong to."""
    spark = new.sparkSession
    fresh = new.where(F.nullif(key, F.lit("")).isNotNull()).dropDuplicates([partition, key])
    try:
        known = spark.read.parquet(path).select(partition, key)
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    if known is not None:
        fresh = fresh.join(known, [partition, key], "left_anti")
    fresh.write.mode("append").partitionBy(partition).parquet(path)


def checksums(files: DataFrame, path: str) -> None:
    """Lines of 'hash  path'."""
    files.select(F.concat_ws("  ", "sha256", "path").alias("value")).write.mode("overwrite").text(path)


#: A template of three labelled tracks (fixed values).
LABEL_COLUMNS = ("source_id", "genre", "mood", "instruments", "energy", "section")
LABEL_EXAMPLES = (
    ("track_001", "melodic trap", "dark|emotional", "piano|808 bass", "0.7", "verse"),
    ("track_002", "drill", "aggressive", "808 bass|trap hi-hats", "0.9", "chorus"),
    ("track_003", "ambient", "calm|dreamy", "pads", "0.2", "intro"),
)


def label_template(spark: SparkSession, path: str) -> None:
    """A label CSV with example rows; an existing one is an error and stays as it is."""
    spark.createDataFrame(LABEL_EXAMPLES, list(LABEL_COLUMNS)).coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def record(spark: SparkSession, values: dict, path: str, append: bool = False) -> None:
    """One record (a sweep, a version list, a configuration) as a line of JSON."""
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, (list, tuple)) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()])
    json_lines(row, path, append)
