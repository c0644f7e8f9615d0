"""Set-similarity join of word shingles by PartEnum signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .exact_dedup import groups
from .heavy import frequent
from .shared import MOST_HOT, joined_few, joined_hot, keyed, scoped, stored, without_few
from .shingles import classed, mixed, shingle_set, word_shingles
from .utf8 import rows

#: Rounds that test each signature's documents against one of them.
STAR_ROUNDS = 3
#: Most cells of a sketch.
CELLS = 1 << 17
#: Documents of one signature that are compared with each other at a time, about.
BLOCK = 512
#: A signature of so few elements or fewer also tells what is in the part left out.
WEAK = 1
#: Elements of a first-level partition, about, from which on two second-level parts do.
LARGE = 14
#: Counters of the summaries of frequent signatures.
HOT_SIGNATURES = 8_192
_STEP = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=64)
def bands(percent: int, most: int) -> tuple[tuple[int, int, int, int], ...]:
    """(largest size, first-level partitions, second-level parts of one, partitions a set may drop) of each size band.

    A band's pairs have the smaller set in the band, the larger one there or
    in the next. Linked sets of sizes s <= t have t <= 100 s / percent and
    differ in at most (s + t)(100 - percent) / (100 + percent) elements. A
    partition is good if they differ in at most one element there: then all
    but one of its second-level parts are equal. At most half as many
    partitions as elements differ are not good. With 1 + 2 d partitions more
    than that half, 1 + 2 d are good, and one of them is left if each set
    drops d partitions, which are its emptiest. No partitions: only equal sets
    link.
    """
    found, low = [], 1
    while low <= most:
        high = low * 100 // percent
        differ = (high + high * 100 // percent) * (100 - percent) // (100 + percent)
        first, drop, second = differ // 2 + 1 if differ else 0, 0, 3
        if first and high // first >= LARGE:
            second = 2
        elif first:
            drop = (first + 8) // 16
        found.append((high, first + 2 * drop, second, drop))
        low = high + 1
    return tuple(found)


def signatures(sets: np.ndarray, percent: int) -> np.ndarray:
    """The PartEnum signatures of one sorted set of 64-bit elements.

    For each partition, every choice of all second-level parts but one is a
    signature. Where those parts hold ``WEAK`` elements at most, the signature
    would be that of many sets; as good partitions differ in one element at
    most and their chosen parts are equal, it is replaced by signatures that
    add the part left out, once whole and once without each of its elements:
    of two that differ in one element, the larger one without it is the other.
    """
    size = len(sets)
    every = bands(percent, 1 << max(4, size.bit_length()))
    own = next((i for i, x in enumerate(every) if size <= x[0]), None) if size else None
    out = []
    for band in () if own is None else (own - 1, own):
        if band < 0 or not every[band][1]:
            continue
        _, first, second, drop = every[band]
        cell = (sets % np.uint64(first * second)).astype(np.int64)
        part = np.zeros(first * second, dtype=np.uint64)
        np.add.at(part, cell, sets)
        held = np.bincount(cell, minlength=first * second).reshape(first, second)
        part = part.reshape(first, second)
        place = (np.arange(first, dtype=np.uint64) << np.uint64(8)) + (np.uint64(band) << np.uint64(40))
        h = place[:, None] + np.arange(second, dtype=np.uint64)  # [partition, part left out]
        for kept in np.array([[j for j in range(second) if j != skip] for skip in range(second)]).T:
            h = mixed(h * _STEP + part[:, kept])
        total = held.sum(axis=1)
        used = np.ones((first, second), dtype=bool)
        if drop:
            used[np.argsort(total, kind="stable")[:drop]] = False
        weak = used & (total[:, None] - held <= WEAK)
        out.append(h[used & ~weak])
        if weak.any():
            out.append(mixed(h[weak] * _STEP + mixed(part[weak])))
            on = weak.ravel()[cell]
            at = cell[on]
            out.append(mixed(h.ravel()[at] * _STEP + mixed(part.ravel()[at] - sets[on])))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, dtype=np.int64)


def _profile(n: int, percent: int, counters: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each document's set size and class; behind them, in rows without a class, a Misra-Gries summary of the task's signatures and how many there were."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, total, kind = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, pa.int64()
        names = ["doc_id", "n_shingles", "digest", "sig", "seen"]
        for batch in batches:
            kind = batch.schema.field(0).type
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                sets, classes = zip(*(classed(raw, n) for raw in rows(part.column(1))), strict=True)
                sizes = [len(s) for s in sets]
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), none, none], names)
                signed = [signatures(s, percent) for s in dict(zip(classes, sets, strict=True)).values()]  # copies get one representative
                found, times = np.unique(np.concatenate([*signed, np.zeros(0, np.int64)]), return_counts=True)
                total += int(times.sum())
                held, nth = np.unique(np.concatenate([held, found]), return_inverse=True)
                seen = np.bincount(nth, np.concatenate([seen, times]), len(held)).astype(np.int64)
                if len(held) > counters:
                    seen = seen - np.partition(seen, len(seen) - counters - 1)[len(seen) - counters - 1]
                    held, seen = held[seen > 0], seen[seen > 0]
        of = len(held) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(of, kind), pa.nulls(of, pa.int64()), pa.nulls(of, pa.binary()), pa.array([*held.tolist(), None], pa.int64()), pa.array([*seen.tolist(), total], pa.int64())], names
        )

    return profile


def _signed(n: int, percent: int, sizes: frozenset[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each document's signatures, and its class if its set has one of the sizes."""

    def one(raw: np.ndarray) -> tuple[np.ndarray, bytes | None]:
        sets = shingle_set(raw, n)
        return classed(raw, n) if len(sets) in sizes else (sets, None)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                sets, classes = zip(*(one(raw) for raw in rows(part.column(1))), strict=True)
                signed = [signatures(s, percent) for s in sets]
                at = np.cumsum([0, *(len(x) for x in signed)]).astype(np.int32)
                flat = np.concatenate([*signed, np.zeros(0, np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(classes, pa.binary()), pa.ListArray.from_arrays(at, pa.array(flat))],
                    ["doc_id", "digest", "signatures"],
                )

    return sign


def sketch(sets: np.ndarray) -> np.ndarray:
    """Parities of the numbers of elements by cell: cells in which sets differ hold elements in which they differ.

    Cells are the low bits of a hash, about twice as many as elements, packed
    into 64-bit words, so that sketches of different lengths compare after
    folding.
    """
    cells = min(CELLS, 1 << max(6, (2 * len(sets)).bit_length()))
    h = mixed(sets ^ np.uint64(0x5851F42D4C957F2D))
    odd = np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _fold(one: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(one.reshape(-1, words), axis=0)


def differ_at_most(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """In how many elements linked sets of these sizes may differ."""
    return (na + nb) * (100 - percent) // (100 + percent)


def _near(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (a, b, na, nb, sa, sb), the pairs whose sketches allow a link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = differ_at_most(batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
            keep = []
            for x, y, m in zip(batch.column(4), batch.column(5), most, strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                words = min(len(x), len(y))
                keep.append(np.bitwise_count(_fold(x, words) ^ _fold(y, words)).sum() <= m)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return check


def _near_in_block(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of two blocks of one signature, the pairs in different components whose sketches allow a link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs: list[tuple] = []
            for lo, hi, every in zip(*(batch.column(k) for k in range(3)), strict=True):
                lo, hi, every = lo.as_py(), hi.as_py(), every.as_py()
                words = min(len(m["sketch"]) for m in every) // 8
                one, two = ([m for m in every if m["block"] == k] for k in (lo, hi))
                if not one or not two:
                    continue
                y = np.stack([_fold(np.frombuffer(m["sketch"], np.uint64), words) for m in two])
                sizes, labels = np.array([m["size"] for m in two]), [m["label"] for m in two]
                for m in one:
                    on = [j for j, o in enumerate(two) if labels[j] != m["label"] and (lo != hi or o["rep"] > m["rep"])]
                    if on:
                        differ = np.bitwise_count(y[on] ^ _fold(np.frombuffer(m["sketch"], np.uint64), words)).sum(axis=1)
                        near = differ <= differ_at_most(sizes[on], m["size"], percent)
                        pairs += [(m["rep"], two[j]["rep"]) for j, ok in zip(on, near, strict=True) if ok]
            kind = batch.schema.field(2).type.value_type.field("rep").type
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], kind) for k in range(2)], ["a", "b"])

    return check


def _sketched(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(shingle_set(raw, n)).tobytes() for raw in rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["rep", "sketch"])

    return make


def _linked(n: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (a, b, x, y), the pairs that link: their words are compared, not hashes."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            last, a = None, set()
            for x, y in zip(rows(batch.column(2)), rows(batch.column(3)), strict=True):
                x = x.tobytes()
                last, a = (last, a) if x == last else (x, word_shingles(x, n))  # a hub's pairs lie together
                b = word_shingles(y.tobytes(), n)
                common = len(a & b)
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return check


class _Links:
    """Tests pairs of documents and keeps the components they form."""

    def __init__(self, texts: DataFrame, live: DataFrame, n: int, percent: int):
        self.texts, self.n, self.percent = texts, n, percent
        self.labels = stored(live.select("rep").distinct().withColumn("label", F.col("rep")), "labels", keep=True)
        self.kind = dict(live.dtypes)["rep"]
        self.sketches = stored(texts.mapInArrow(_sketched(n), f"rep {self.kind}, sketch binary"), "sketches")
        self.tested: list[DataFrame] = []

    def near(self, pairs: DataFrame) -> DataFrame:
        """Of (a, b, na, nb) pairs, those whose sizes and sketches allow a link; many pairs may have an a in common."""
        pairs = stored(pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent).distinct(), "met")
        one = self.sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"))
        two = self.sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))
        both = joined_hot(pairs, one, "a", wide=True).join(two, "b").select("a", "b", "na", "nb", "sa", "sb")
        return both.mapInArrow(_near(self.percent), f"a {self.kind}, b {self.kind}")

    def join(self, pairs: DataFrame) -> None:
        """Verify (a, b) pairs on their texts and join the components that links connect."""
        once = pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.max(F.struct("a", "b")).alias("pair"))
        for old in self.tested:
            once = once.join(old, ["lo", "hi"], "left_anti")
        once = stored(once.select("lo", "hi", "pair.*"), "pairs")
        if once.isEmpty():
            return
        self.tested.append(once.select("lo", "hi"))
        one = self.texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
        two = self.texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
        both = joined_hot(once.select("a", "b"), one, "a", wide=True).join(two, "b").select("a", "b", "x", "y")
        links = stored(both.mapInArrow(_linked(self.n, self.percent), f"a {self.kind}, b {self.kind}"), "links")
        if links.isEmpty():
            return
        labels = self.labels
        edges = (
            joined_hot(links, labels.select(F.col("rep").alias("a"), F.col("label").alias("la")), "a")
            .join(labels.select(F.col("rep").alias("b"), F.col("label").alias("lb")), "b")
            .select(F.col("la").alias("a"), F.col("lb").alias("b"))
        )
        found = stored(components(edges).withColumnRenamed("node", "label"), "joined")
        told = joined_hot(labels, found, "label", how="left")
        self.labels = stored(told.select("rep", F.coalesce("least", "label").alias("label")), "labels", keep=True)

    def open(self, live: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows with their labels, and (sig, hub, n) of the signatures whose documents are in several components.

        The hub is a document of the component that most of them are in; n
        counts them all. Both come from sums by component, which are
        pre-aggregated, so that a signature of many documents is no large group.
        """
        labelled = stored(live.select("sig", "rep", "size").join(self.labels, "rep"), "labelled")
        member = F.struct(F.xxhash64(F.lit(len(self.tested)), "rep").alias("h"), F.col("rep"), F.col("size"))
        by = labelled.groupBy("sig", "label").agg(F.count("*").alias("share"), F.max(member).alias("m"))
        first = F.struct("share", F.col("m.h").alias("h"), F.col("m.rep").alias("rep"), F.col("m.size").alias("size"), "label")
        hubs = by.groupBy("sig").agg(F.max(first).alias("hub"), F.count("*").alias("of"), F.sum("share").alias("n"))
        return labelled, stored(hubs.where(F.col("of") > 1).select("sig", "hub", "n"), "hubs")


@scoped
def similar(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id: documents that links connect.

    Takes ``doc_id`` and ``text``; other columns are ignored. A document's set
    is its distinct n-word shingles (A-Z as a-z); with fewer words the whole
    sequence is one shingle; without words it is empty and links with nothing.
    Two documents link when ``100 * |a & b| >= percent * |a | b|``. A
    component's id is its smallest doc_id.

    Documents of equal sets are one class, by the heavy-hitter split of exact
    dedup, and only a class's first document goes on. It gets PartEnum
    signatures for its size band and the one below; linked sets share at least
    one. Frequent signatures, told by Misra-Gries summaries, are not shuffled
    to one task. The documents of a signature are tested against one of them,
    another one each round, until they are one component; pairs of documents
    of a signature that are still in different components are then all tested,
    so no link is lost, and groups of copies never expand into all their pairs.

    Each row is a document of its own, also where rows share a doc_id or have
    none: they are then numbered first, and a component's id is the smallest
    doc_id in it, null if it has none. Null and empty texts have no words.
    Repeated rows are rows, of one class. An empty table gives an empty result.
    """
    named, key = keyed(docs)
    if key == "doc_id":
        return _similar(docs, n, percent)
    found = _by_row(named, key, n, percent)
    least = found.groupBy("component").agg(F.min("doc_id").alias("least"))
    told = joined_hot(found, least, "component")
    return told.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def _by_row(named: DataFrame, key: str, n: int, percent: int) -> DataFrame:
    """(row, doc_id, n_shingles, component) of documents that ``key`` numbers."""
    found = _similar(named.select(F.col(key).alias("doc_id"), "text"), n, percent)
    found = found.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("component"))
    return stored(found.join(named.select(F.col(key).alias("row"), "doc_id"), "row"), "rows", keep=True)


def _similar(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The same for rows of which each has a doc_id of its own."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", "text")
    profiles = stored(
        read.mapInArrow(_profile(n, percent, HOT_SIGNATURES), f"doc_id {kind}, n_shingles long, digest binary, sig long, seen long"), "profiles", keep=True
    )
    facts = profiles.where("digest is not null").select("doc_id", "n_shingles", "digest")
    counted = profiles.where("digest is null")
    most = counted.where("sig is null").agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0] / (HOT_SIGNATURES + 1)
    frequent_sigs = counted.where("sig is not null").groupBy("sig").agg(F.sum("seen").alias("seen")).where(F.col("seen") > most).select("sig")
    frequent_sigs = F.broadcast(stored(frequent_sigs, "frequent"))  # HOT_SIGNATURES rows at most
    nodes = stored(groups(facts), "classes", keep=True)
    hot = F.broadcast(frequent(facts, "digest", facts.count()))
    won = F.min(F.struct("doc_id", "n_shingles"))
    winners = nodes.join(hot, "digest").groupBy("digest").agg(won.alias("won")).select("digest", F.col("won.doc_id").alias("keeper"), F.col("won.n_shingles").alias("of"))
    winners = stored(winners, "winners")  # as bounded as hot
    sizes = frozenset(r["of"] for r in winners.select("of").distinct().collect())
    winners = winners.drop("of")
    signed = read.mapInArrow(_signed(n, percent, sizes), f"doc_id {kind}, digest binary, signatures array<long>")
    signed = signed.join(F.broadcast(winners), "digest", "left").where(F.col("keeper").isNull() | (F.col("keeper") == F.col("doc_id")))
    signed = signed.select("doc_id", F.explode("signatures").alias("sig"))
    signed = signed.join(frequent_sigs.withColumn("often", F.lit(True)), "sig", "left")
    salt = F.when(F.col("often"), F.pmod(F.xxhash64("doc_id"), F.lit(MOST_HOT))).otherwise(0)
    signed = signed.withColumn("salt", salt).withColumn("n", F.count("*").over(Window.partitionBy("sig", "salt")))
    shared = signed.where((F.col("n") > 1) | F.col("often")).select("sig", "doc_id")
    heads = nodes.where(F.col("doc_id") == F.col("keep_id")).select("doc_id", "n_shingles")
    live = stored(shared.join(heads, "doc_id").select("sig", F.col("doc_id").alias("rep"), F.col("n_shingles").alias("size")), "shared")
    # of signatures with the same documents, one is enough
    members = live.groupBy("sig").agg(
        F.bit_xor(F.xxhash64("rep")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("g"), F.count("*").alias("n")
    )
    once = members.where(F.col("n") > 1).groupBy("h", "g", "n").agg(F.min("sig").alias("sig")).select("sig", "n")
    live = stored(joined_hot(live, stored(once, "once"), "sig"), "live")
    texts = stored(joined_few(read, live.select(F.col("rep").alias("doc_id")).distinct(), "doc_id"), "texts")
    links = _Links(texts, live, n, percent)
    for turn in range(STAR_ROUNDS):
        labelled, hubs = links.open(live)
        if turn:  # where nothing has linked yet, another hub would not tell more than the blocks below
            hubs = hubs.where(F.col("hub.share") > 1)
        if hubs.isEmpty():
            break
        pairs = joined_hot(labelled, hubs.select("sig", "hub"), "sig").where(F.col("label") != F.col("hub.label"))
        pairs = pairs.select(F.col("hub.rep").alias("a"), F.col("rep").alias("b"), F.col("hub.size").alias("na"), F.col("size").alias("nb"))
        links.join(links.near(pairs))
        live = live.where(F.col("n") > 2)  # the one pair of a signature of two documents is tested now
    labelled, hubs = links.open(live.where(F.col("n") > 2))
    blocks = F.ceil(F.col("n") / BLOCK)
    rest = joined_hot(labelled, hubs.select("sig", "n"), "sig").withColumn("block", F.pmod(F.xxhash64("rep"), blocks))
    rest = rest.join(links.sketches, "rep").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    member = F.struct("block", "rep", "size", "label", "sketch")
    met = rest.groupBy("sig", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).agg(F.collect_list(member).alias("every"))  # two blocks, about
    links.join(met.select("lo", "hi", "every").mapInArrow(_near_in_block(percent), f"a {kind}, b {kind}"))
    found = joined_hot(nodes, links.labels.withColumnRenamed("rep", "keep_id"), "keep_id", how="left")
    return found.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("label", "keep_id")).alias("component_id"),
    )


@scoped
def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with all its columns.

    That is a row of the smallest doc_id; where rows share a doc_id or have
    none, the verdict is a row's own, and of a component one row stays, first
    of all one that has a doc_id. Documents without words, null texts among
    them, stay. An empty table stays one.
    """
    named, key = keyed(docs)
    if key == "doc_id":
        out = _similar(docs, n, percent).where(F.col("component_id") != F.col("doc_id")).select("doc_id")
    else:
        found = _by_row(named, key, n, percent)
        first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("first")
        told = joined_hot(found, found.groupBy("component").agg(first), "component")
        out = told.where(F.col("row") != F.col("first.row")).select(F.col("row").alias(key))
    return without_few(named, out, key).select(*docs.columns)


def brute_force(texts: dict[int, str | None], n: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (size of its set, component_id) by all pairs, for tests."""
    import re

    sets = {}
    for i, t in texts.items():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        k = min(n, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


__all__ = ["brute_force", "keep_one", "signatures", "similar"]
