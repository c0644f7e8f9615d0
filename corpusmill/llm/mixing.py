"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, cells_for, scoped, stored, whole_text

#: A source gives at most this many times its words.
MOST_EPOCHS = 3
#: Rows of a source that one sorted cell holds, about.
PER_CELL = 20_000
#: Most sources whose rows are broadcast.
MOST_BROADCAST = 100_000


def words(name: str = "text"):
    """How many words the text has; none if null."""
    return F.regexp_count(whole_text(name), F.lit(rf"[^{SPACE}]+")).cast("long")


def targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = MOST_EPOCHS) -> DataFrame:
    """Each source's target in words: source, source_size, target, for (source, n) rows.

    Sources, by code point and null last, weigh as ``cycle`` says. They share
    all words by weight; one above ``most`` times its own words stops there,
    and the excess is shared again by weight among the others.

    Sources are numbered by ranges, each range by itself behind the ranges
    before it. The level, words for a weight of one, is raised until no other
    source stops; each step is one sum over the sources, of which only totals
    reach the driver.
    """
    spark = sizes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = sizes.repartitionByRange(parts, F.col("source").asc_nulls_last()).select("source", "n", F.spark_partition_id().alias("part"))
    ranged = stored(ranged, "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    firsts = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    nth = F.col("first") + F.row_number().over(inside) - 1
    weights = F.array(*[F.lit(w) for w in cycle])
    weighed = ranged.join(F.broadcast(firsts), "part").select(
        "source", F.col("n").alias("source_size"), F.element_at(weights, (nth % len(cycle) + 1).cast("int")).cast("double").alias("weight")
    )
    weighed = stored(weighed, "weights", keep=True)
    level, full = -1.0, most * F.col("source_size").cast("double")
    while True:
        stops = F.lit(level) * F.col("weight") > full
        total, held, left = weighed.agg(
            F.sum("source_size"), F.sum(F.when(stops, most * F.col("source_size")).otherwise(0)), F.sum(F.when(stops, 0.0).otherwise(F.col("weight")))
        ).first()
        raised = (total - held) / left if left else level
        if raised <= level:
            return weighed.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), full).alias("target"))
        level = raised


def _key(seed: int):
    """A random number of 63 bits, so that cells by its first bits are ranges of it."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", whole_text()), 1)


def _placed(docs: DataFrame, cycle: tuple[int, ...], seed: int, per_cell: int) -> DataFrame:
    """Rows with their source's figures, whole epochs, and what is left of the budget before them.

    Rows that repeat doc_id, source and text are one row here, with their
    number in ``copies``: added up before they move, they are no large group.
    """
    facts = docs.select("doc_id", "source", words().alias("size"), _key(seed).alias("key"))
    facts = stored(facts.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("copies")), "mixing-rows", keep=True)
    cells = cells_for(facts.count(), per_cell, 256)
    facts = facts.withColumn("cell", (F.shiftright("key", 32) * cells / F.lit(float(2**31))).cast("int")).withColumn("whole_size", F.col("size") * F.col("copies"))
    by_cell = stored(facts.groupBy("source", "cell").agg(F.sum("whole_size").alias("cell_size")), "mixing-cells", keep=True)
    plan = targets(by_cell.groupBy("source").agg(F.sum("cell_size").alias("n")), cycle)
    plan = plan.select(
        F.col("source").alias("of"), "source_size", "target", F.least(F.rint("target").cast("long"), MOST_EPOCHS * F.col("source_size")).alias("budget")
    )
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_cell.withColumn("offset", F.coalesce(F.sum("cell_size").over(before), F.lit(0)))
    offsets = offsets.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("source").alias("of"), F.col("cell").alias("at"), "offset", "source_size", "target", "budget"
    )
    inside = Window.partitionBy("source", "cell").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = facts.withColumn("run", F.coalesce(F.sum("whole_size").over(inside), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    joined = placed.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("at"))).withColumn("epochs", whole)
    return joined.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("offset") - F.col("run"))


def _each_copy(placed: DataFrame, per_cell: int) -> DataFrame:
    """A row for each copy, with what is left of the budget before it; many copies are dealt out in lots."""
    lots = F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(per_cell).cast("long"))
    lot = placed.withColumn("lot", F.explode(lots))
    if not placed.where(F.col("copies") > per_cell).isEmpty():
        lot = lot.repartition("key", "lot")
    nth = lot.withColumn("nth", F.explode(F.sequence("lot", F.least(F.col("lot") + per_cell, "copies") - 1)))
    return nth.withColumn("rest", F.col("rest") - F.col("nth") * F.col("size"))


@scoped
def mix(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), seed: int = 7, per_cell: int = PER_CELL) -> DataFrame:
    """How many words of each document the mix takes.

    Takes ``doc_id``, ``text`` and ``source``; other columns are ignored. Each
    row gets a random key by hash of doc_id and text. The keys' ranges cut
    every source, however large, into cells; sums per cell give each cell's
    offset, and a running sum inside the cell each row's place in its source.
    Whole epochs of the source are taken first, then rows in key order up to
    the exact budget, the row at the cut in part.

    A null source is a source of its own; null and empty texts have no words
    and give none. Rows that repeat a doc_id are rows like others; those that
    repeat the text and the source as well stand together. Reruns
    agree. An empty table gives an empty result.
    """
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest")))
    return _each_copy(_placed(docs, cycle, seed, per_cell), per_cell).select(
        "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken")
    )


@scoped
def mixed_documents(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), seed: int = 7, per_cell: int = PER_CELL) -> DataFrame:
    """The mix itself: documents of which words are taken, with all columns.

    A document that is taken in k epochs, the last one perhaps in part, occurs
    k times; one of which nothing is taken goes. Documents without words, null
    texts among them, are no part of a mix by words: they stay once. A null
    source is a source. Rows that repeat both the doc_id and the text at the
    cut are all taken once more. An empty table stays one.

    What the mix decides is one row a source: its whole epochs, and the key
    and doc_id at the cut. Documents are compared with that where they are,
    and their texts are not shuffled.
    """
    placed = _placed(docs, cycle, seed, per_cell)
    none = F.col("doc_id").isNull()
    last = F.max(F.when((F.col("rest") > 0) & (F.col("size") > 0), F.struct("key", ~none, "doc_id")))  # nulls are first in a cell
    cuts = stored(placed.groupBy("source").agg(F.first("epochs").alias("epochs"), last.alias("last")), "cuts", keep=True)
    if cuts.count() <= MOST_BROADCAST:
        cuts = F.broadcast(cuts)
    here = F.struct(_key(seed).alias("key"), ~none, F.col("doc_id"))
    row = docs.select(  # the document's own columns as one, so that no name of theirs is in the way
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("source").alias("of"),
        here.alias("here"),
        whole_text().rlike(rf"[^{SPACE}]").alias("has_words"),
    )
    times = F.col("epochs") + F.when(F.col("here") <= F.col("last"), 1).otherwise(0)
    joined = row.join(cuts, F.col("of").eqNullSafe(F.col("source")))
    taken = joined.withColumn("times", F.when(F.col("has_words"), times).otherwise(1).cast("int")).where(F.col("times") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
