"""Byte-balanced sharding by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .heavy import frequent
from .shared import cells_for, scoped, stored, whole_text

#: Groups that one task differences at a time, about.
PER_CELL = 2_000
#: Partial partitions that one task combines at a time, at most.
FAN_IN = 1_024
#: Rows of one shard that one task numbers, about.
PER_RUN = 20_000


def difference(vectors: list[list[int]]) -> list[list[int]]:
    """Combine partial partitions; returns for each its part -> part map.

    Each vector holds the sizes of the parts of one partial partition. The two
    of largest spread are combined again and again, the largest part of one
    with the smallest of the other, until a single partition is left.
    """
    if not vectors:
        return []
    k = len(vectors[0])
    heap, order, made = [], [], []
    for i, v in enumerate(vectors):
        by = sorted(range(k), key=lambda p: (-v[p], p))
        sums = [v[p] for p in by]
        order.append(by)
        heap.append((sums[-1] - sums[0], i, [x - sums[-1] for x in sums]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        sums = [x + y for x, y in zip(left, reversed(right), strict=True)]
        by = sorted(range(k), key=lambda p: (-sums[p], p))
        made.append((a, b, by))
        least = sums[by[-1]]
        heapq.heappush(heap, (least - sums[by[0]], len(vectors) + len(made) - 1, [sums[p] - least for p in by]))
    label: list[list[int]] = [[]] * (len(vectors) + len(made))
    label[-1] = list(range(k))
    for n in range(len(made) - 1, -1, -1):
        a, b, by = made[n]
        mine, left, right = label[len(vectors) + n], [0] * k, [0] * k
        for j, p in enumerate(by):
            left[p] = mine[j]
            right[k - 1 - p] = mine[j]
        label[a], label[b] = left, right
    out = []
    for i, by in enumerate(order):
        parts = [0] * k
        for j, p in enumerate(by):
            parts[p] = label[i][j]
        out.append(parts)
    return out


def _assign(units: DataFrame, shards: int, per_cell: int, fan_in: int) -> DataFrame:
    """(unit, weight) rows with their shard.

    Units are dealt to cells by hash and differenced there; the cells' partial
    partitions are differenced in turn, ``fan_in`` to a task, until one is
    left. No task ever holds more than a cell or ``fan_in`` vectors.
    """
    cells = cells_for(units.count(), per_cell)

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "unit"], ascending=[False, True])
        maps = difference([[int(w)] + [0] * (shards - 1) for w in pdf["weight"]])
        return pd.DataFrame({"unit": pdf["unit"], "weight": pdf["weight"], "cell": pdf["cell"], "part": [m[0] for m in maps]})

    placed = stored(
        units.withColumn("cell", F.pmod(F.xxhash64("unit"), F.lit(cells)))
        .groupBy("cell")
        .applyInPandas(first, "unit binary, weight long, cell long, part int"),
        "parts",
    )

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        maps = difference([[int(x) for x in v] for v in pdf["sums"]])
        return pd.DataFrame({"cell": pdf["cell"], "parent": pdf["parent"], "sums": pdf["sums"], "maps": maps})

    sums = [F.sum(F.when(F.col("part") == p, F.col("weight")).otherwise(0)).alias(f"s{p}") for p in range(shards)]
    level = placed.groupBy("cell").agg(*sums).select("cell", F.array(*[f"s{p}" for p in range(shards)]).alias("sums"))
    while True:
        level = stored(
            level.withColumn("parent", F.expr(f"cell div {fan_in}"))
            .groupBy("parent")
            .applyInPandas(combine, "cell long, parent long, sums array<long>, maps array<int>"),
            "partitions",
        )
        moves = level.select("cell", F.col("parent").alias("up"), "maps")
        placed = placed.join(moves, "cell").select(
            "unit", "weight", F.col("up").alias("cell"), F.element_at("maps", F.col("part") + 1).alias("part")
        )
        cells = -(-cells // fan_in)
        if cells == 1:
            return placed.select("unit", F.col("part").alias("shard"))
        turned = level.select("parent", F.posexplode(F.arrays_zip("maps", "sums")).alias("i", "x"))
        level = turned.groupBy(F.col("parent").alias("cell")).agg(
            *[F.sum(F.when(F.col("x.maps") == p, F.col("x.sums")).otherwise(0)).alias(f"s{p}") for p in range(shards)]
        )
        level = level.select("cell", F.array(*[f"s{p}" for p in range(shards)]).alias("sums"))


def numbered(rows: DataFrame, group: str, by: list[Column | str], per_run: int = PER_RUN) -> DataFrame:
    """``rows`` with a gapless ``slot`` from 0 in each ``group``.

    Each group is cut into runs by a hash of ``row``, which tells each row from
    all others, so that rows that share a doc_id, or have none, spread as well;
    counts per run give the run's first slot, and rows are numbered inside
    their run only.
    """
    runs = cells_for(rows.count(), per_run, 64)
    rows = rows.withColumn("run", F.pmod(F.xxhash64("row"), F.lit(runs)))
    before = Window.partitionBy(group).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row a run
    firsts = rows.groupBy(group, "run").agg(F.count("*").alias("n"))
    firsts = firsts.select(group, "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy(group, "run").orderBy(*by)
    counted = rows.withColumn("nth", F.row_number().over(inside) - 1)
    return counted.join(firsts, [group, "run"]).withColumn("slot", (F.col("first") + F.col("nth")).cast("long"))


@scoped
def shard(docs: DataFrame, shards: int = 8, per_cell: int = PER_CELL, fan_in: int = FAN_IN, cut_large: bool = True) -> DataFrame:
    """All documents in ``shards`` shards of near equal bytes.

    Takes ``doc_id`` and ``text``; other columns are ignored. A row's size is
    the UTF-8 bytes of its text plus 1 (null: 1, as an empty text). Equal texts
    form one indivisible group and share a shard. With ``cut_large``, a group
    with more bytes than one shard's fair share, of which there are fewer than
    ``shards``, is cut into pieces by a hash of the row's number, since no
    balance exists otherwise; ``group_cut`` marks its rows. Without, no group
    is ever cut. Rows that repeat a doc_id or have none are rows like others.
    Slots run from 0 without gaps in each shard. An empty table gives an empty
    result.
    """
    text = whole_text()
    facts = stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        ),
        "sharding",
    )
    n, total = facts.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    fair = max(1, total // shards) if cut_large else total
    by_text = facts.groupBy("digest").agg(F.sum("size").alias("weight"))
    large = by_text.where(F.col("weight") > fair).select("digest", F.ceil(F.col("weight") * 8 / fair).alias("pieces"))
    facts = facts.join(F.broadcast(large), "digest", "left")
    piece = F.pmod(F.xxhash64("row"), F.coalesce("pieces", F.lit(1)))
    facts = stored(
        facts.withColumn("unit", F.concat("digest", F.when(F.col("pieces").isNotNull(), F.encode(piece.cast("string"), "UTF-8")).otherwise(F.lit(b"")))).withColumn("group_cut", F.col("pieces").isNotNull()).drop("pieces", "digest"),
        "sharding-units",
    )
    units = facts.groupBy("unit").agg(F.sum("size").alias("weight"))
    assigned = stored(_assign(units, shards, per_cell, fan_in), "assigned")
    hot = F.broadcast(frequent(facts, "unit", n))
    settled = stored(assigned.join(hot, "unit"), "hot-units")  # as bounded as hot
    rows = facts.join(F.broadcast(settled), "unit").unionByName(
        facts.join(F.broadcast(settled.select("unit")), "unit", "left_anti").join(assigned, "unit")
    )
    rows = stored(rows.select("row", "doc_id", "size", "text_crc32", "shard", "group_cut"), "sharded", keep=True)
    return numbered(rows, "shard", ["doc_id", "text_crc32"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "group_cut",
    )
