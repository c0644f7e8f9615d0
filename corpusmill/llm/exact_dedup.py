"""Exact deduplication with a heavy-hitter split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .heavy import COUNTERS, frequent
from .shared import SPACE, keyed, scoped, stored, whole_text, without_few


def normalised(name: str = "text"):
    """The text with each run of blanks as one space; null as empty.

    Only runs that are not already one space are replaced.
    """
    text = whole_text(name)
    return F.regexp_replace(text, rf"[{SPACE}]{{2,}}|[\x09-\x0D]", " ")


def fingerprints(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, other columns and the SHA-256 of the normalised text, 32 bytes."""
    return docs.select("doc_id", *others, F.unhex(F.sha2(normalised().cast("binary"), 256)).alias("digest"))


def groups(facts: DataFrame, counters: int = COUNTERS, key: str = "doc_id") -> DataFrame:
    """Rows with digest and ``key``, and the group's keep_id and group_size.

    Misra-Gries summaries name the digests that may be frequent. Their
    smallest key and exact count are verified by one aggregation, the few
    winners are broadcast, and rows of frequent digests are settled on the map
    side. All other digests, each with less than ``2 / counters`` of the rows,
    are shuffled.
    """
    total = facts.count()
    named = F.broadcast(frequent(facts, "digest", total, counters))
    winners = stored(
        facts.join(named, "digest").groupBy("digest").agg(F.min(key).alias("keep_id"), F.count("*").alias("group_size")),
        "winners",
        keep=True,
    )
    settled = facts.join(F.broadcast(winners), "digest").select(*facts.columns, "keep_id", "group_size")
    rest = facts.join(F.broadcast(winners), "digest", "left_anti")
    same = Window.partitionBy("digest")
    shuffled = rest.select(
        *facts.columns, F.min(key).over(same).alias("keep_id"), F.count("*").over(same).alias("group_size")
    )
    return settled.unionByName(shuffled)


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per document: which document of equal texts stays.

    Takes ``doc_id`` and ``text``; other columns are ignored. Texts are equal
    when identical after each run of blanks became one space; a null text is
    an empty one. The row with the smallest doc_id stays. Rows that repeat a
    doc_id as well as the text share one verdict and are all counted. Rows
    without a doc_id never win over rows with one. An empty table gives an
    empty result.
    """
    facts = stored(fingerprints(docs), "digests")
    return groups(facts, counters).select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


@scoped
def keep_first(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The documents that stay, with all their columns: one row of each group of equal texts.

    That is a row of the smallest doc_id; rows without one stay only where no
    row of the group has one, and of rows that repeat doc_id and text one
    stays. The verdict is a row's own: a row of another text stays, whatever
    doc_id it shares. Null texts are empty ones; an empty table stays one.

    Only the keys of the dropped rows are shuffled against the documents.
    """
    named, key = keyed(docs)
    facts = fingerprints(named) if key == "doc_id" else fingerprints(named, key)
    best = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("key"))
    facts = stored(facts.select(best.alias("best"), "digest"), "digests")
    out = groups(facts, counters, "best").where(F.col("best.key") != F.col("keep_id.key")).select(F.col("best.key").alias(key))
    return without_few(named, out, key).select(*docs.columns)
