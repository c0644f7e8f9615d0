"""Frequent keys by Misra-Gries summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters of a summary, and so the most rows that are ever broadcast.
COUNTERS = 1024


def _summaries(key: str, counters: int):
    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.Series(dtype="int64")
        rows = 0
        for batch in batches:
            rows += len(batch)
            held = held.add(batch[key].value_counts(), fill_value=0)
            if len(held) > counters:
                held = held.sort_values(ascending=False)
                held = held - held.iloc[counters]
                held = held[held > 0]
        yield pd.DataFrame({key: held.index.to_list(), "seen": held.astype("int64").to_list()})

    return summarise


def frequent(rows: DataFrame, key: str, total: int, counters: int = COUNTERS) -> DataFrame:
    """Every key that more than ``2 * total / (counters + 1)`` rows hold.

    Each partition keeps a Misra-Gries summary, which undercounts a key by at
    most ``n / (counters + 1)`` of its ``n`` rows. Estimates are added over the
    partitions, so the sum undercounts by at most ``total / (counters + 1)``,
    and keys with more than that are returned: by counting, ``counters`` keys
    at most, whatever the input. That is the proven bound that allows a
    broadcast. Null keys are left out; an empty input gives no key.
    """
    keys = rows.where(F.col(key).isNotNull()).select(key)
    kind = rows.schema[key].dataType.simpleString()
    part = keys.mapInPandas(_summaries(key, counters), f"{key} {kind}, seen long")
    return (
        part.groupBy(key)
        .agg(F.sum("seen").alias("seen"))
        .where(F.col("seen") > F.lit(total / (counters + 1)))
        .select(key)
    )
