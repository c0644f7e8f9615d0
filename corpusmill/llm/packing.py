"""Best-fit packing of documents into windows under conflicts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import words
from .shared import cells_for, stored, whole_text

#: Words of one window.
CAPACITY = 2_048
#: Pieces that one task packs at a time, about.
PER_BLOCK = 4_096


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; sources and clusters are small numbers.

    Pieces are placed by falling size. Bins stand in residual order; each
    carries a bitmap of its sources and one of its duplicate clusters. From
    the piece's size upwards, the search goes to the next residual that any
    bin has, until a bin there has neither the source nor the cluster; that is
    the tightest compatible bin. None: a new bin opens. A piece of full size
    gets its own.
    """
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    standing = 0  # bit r: a bin with residual r exists
    has_source: list[int] = []
    has_cluster: list[int] = []
    residual: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size, source, cluster = sizes[i], 1 << sources[i], 1 << clusters[i]
        found, above = -1, standing >> size << size
        while above and found < 0:
            r = (above & -above).bit_length() - 1
            above &= above - 1
            for b in by_residual[r]:
                if not (has_source[b] & source or has_cluster[b] & cluster):
                    found = b
                    break
        if found < 0:
            found = len(residual)
            residual.append(capacity)
            has_source.append(0)
            has_cluster.append(0)
        else:
            r = residual[found]
            by_residual[r].remove(found)
            if not by_residual[r]:
                standing &= ~(1 << r)
        out[i] = (found, capacity - residual[found])
        has_source[found] |= source
        has_cluster[found] |= cluster
        residual[found] -= size
        by_residual[residual[found]].append(found)
        standing |= 1 << residual[found]
    return out


def _pack(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "cluster", "piece", "row"], kind="stable", ignore_index=True)
        source, _ = pd.factorize(pdf["source"], use_na_sentinel=False)
        cluster, _ = pd.factorize(pdf["cluster"])
        placed = best_fit(pdf["n_words"].tolist(), source.tolist(), cluster.tolist(), capacity)
        return pdf.assign(bin=[f"{k}-{b}" for k, (b, _) in zip(pdf["block"], placed, strict=True)], offset=[o for _, o in placed])[
            ["doc_id", "piece", "first_word", "n_words", "bin", "offset"]
        ]

    return pack


def pack(docs: DataFrame, capacity: int = CAPACITY, per_block: int = PER_BLOCK) -> DataFrame:
    """Every document's pieces with their bin and the word offset in it.

    Takes ``doc_id``, ``text`` and ``source``; other columns are ignored. A
    text of more words than ``capacity`` is cut into pieces of that many words
    and a rest; no word is dropped. A bin holds no two pieces of one source
    and no two of one duplicate cluster (equal texts); null is a source too.
    So there are at least as many bins as the largest source has pieces: where
    one source dominates, most bins hold a piece of it and what fits beside it.
    Pieces are dealt to blocks by a hash of the row's number and the piece, so
    that a source, a cluster or one row repeated, however often, spreads over
    all blocks, and each block is packed best-fit by itself; the blocks' last bins
    are all that this costs.

    Columns: doc_id, piece (from 0), first_word, n_words, bin, offset. A text
    without words has one piece of none, with null bin and offset. Repeated
    rows are packed as rows, and as one cluster never share a bin. An empty
    table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", words().alias("size"), F.xxhash64(whole_text()).alias("cluster")), "packing", keep=True)
    last = F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)).cast("int")
    n_pieces = sized.agg(F.sum(last + 1)).first()[0] or 0
    pieces = sized.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "row",
        "doc_id",
        "source",
        "cluster",
        "piece",
        (F.col("piece").cast("long") * capacity).alias("first_word"),
        F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece").cast("long") * capacity).alias("n_words"),
    )
    none = pieces.where(F.col("n_words") == 0).select(
        "doc_id", "piece", "first_word", "n_words", F.lit(None).cast("string").alias("bin"), F.lit(None).cast("long").alias("offset")
    )
    blocks = cells_for(n_pieces, per_block)
    placed = (
        pieces.where(F.col("n_words") > 0)
        .withColumn("block", F.pmod(F.xxhash64(F.lit(5), "row", "piece"), F.lit(blocks)))
        .groupBy("block")
        .applyInPandas(_pack(capacity), f"doc_id {kind}, piece int, first_word long, n_words long, bin string, offset long")
    )
    return placed.unionByName(none)
