"""Removal of passages that repeat across documents, by merged suffix runs."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .loser_tree import front_code, merge
from .shared import cells_for, joined_hot, scoped, scratch_dir, stored, written
from .shingles import _grown, mixed
from .utf8 import utf8

#: Length of a passage in bytes.
SPAN = 50
#: Length of an anchor in bytes.
ANCHOR = 24
#: A passage holds this many anchors-to-be; the one of least hash anchors it.
REACH = SPAN - ANCHOR + 1
#: A suffix record: the bytes from the anchor on, then those before it, backwards.
BEFORE = REACH - 1
WIDTH = SPAN + BEFORE
#: No byte of UTF-8; stands where the document ends.
PAD = 0xFF
#: Bytes of one run's text, about.
RUN_BYTES = 2 << 20
#: Anchors that one task compares at a time, about.
PER_BUCKET = 400_000
#: Suffix records that one task merges at a time, about.
PER_MERGE = 150_000
#: A run tells how often it has a kind of anchor from this number on.
FEW = 4
#: Bytes of text that one task holds runs of, about.
PER_TASK = 64 << 20
#: Stands for a null doc_id, which is larger than any other.
NO_ID = np.iinfo(np.int64).max


def _sliding(values: np.ndarray, reach: int, take) -> np.ndarray:
    """take() over each ``reach`` values in a row."""
    done = 1
    while done < reach:
        step = min(done, reach - done)
        values = take(values[:-step], values[step:])
        done += step
    return values


def _hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the anchor-to-be at each position."""
    power, inverse = _grown(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    n = len(raw) - ANCHOR + 1
    return mixed((total[ANCHOR:] - total[:n]) * inverse[:n])


@dataclass
class Run:
    """Whole documents, one after the other: a piece of the table."""

    ids: np.ndarray  # int64
    ends: np.ndarray
    body: np.ndarray

    @classmethod
    def read(cls, row: dict) -> Run:
        return cls(np.frombuffer(row["ids"], np.int64), np.cumsum(np.frombuffer(row["sizes"], np.int64)), np.frombuffer(row["body"], np.uint8))

    def anchors(self, block: int = RUN_BYTES) -> None:
        """Find the anchors: position, document, hash.

        A position is an anchor if its hash is the least of some passage that
        lies in one document. Copies of a passage so have the same anchors.
        """
        n = len(self.body)
        at, of = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        starts = np.concatenate([[0], self.ends[:-1]])
        for first in range(0, max(0, n - SPAN + 1), block):
            low = max(0, first - BEFORE)
            part = self.body[low : min(n, first + block + SPAN)]
            h = _hashes(part)
            least = _sliding(h, REACH, np.minimum)
            doc = np.searchsorted(self.ends, low + np.arange(len(least)), side="right")
            fits = low + np.arange(len(least)) + SPAN <= self.ends[np.minimum(doc, len(self.ends) - 1)]
            least = np.where(fits, least, np.uint64(0))
            edge = np.zeros(BEFORE, np.uint64)
            most = _sliding(np.concatenate([edge, least, edge]), REACH, np.maximum)
            found = np.flatnonzero(most == h[: len(most)])
            found = found[(found + low >= first) & (found + low < first + block)] if n - SPAN + 1 > first + block else found[found + low >= first]
            at.append(found + low)
            of.append(mixed(h[found]))  # least hashes are small: spread them again
        self.at, self.hash = np.concatenate(at), np.concatenate(of)
        self.doc = np.searchsorted(self.ends, self.at, side="right")
        self.begin, self.end = starts[self.doc] if len(self.at) else self.at, self.ends[self.doc] if len(self.at) else self.at
        self.kinds, self.kind = np.unique(self.hash, return_inverse=True)

    def suffixes(self, repeated: np.ndarray, buckets: int) -> None:
        """The records of anchors of repeated kinds, sorted by bucket and bytes."""
        use = np.flatnonzero(repeated[self.kind])
        at, begin, end = self.at[use, None], self.begin[use, None], self.end[use, None]
        after = at + np.arange(SPAN)
        before = at - 1 - np.arange(BEFORE)
        last = max(0, len(self.body) - 1)
        rows = np.empty((len(use), WIDTH), dtype=np.uint8)
        if len(use):
            rows[:, :SPAN] = np.where(after < end, self.body[np.minimum(after, last)], PAD)
            rows[:, SPAN:] = np.where(before >= begin, self.body[np.maximum(before, 0)], PAD)
        by = np.argsort(rows.view(f"S{WIDTH}").ravel(), kind="stable") if len(use) else np.zeros(0, np.int64)
        bucket = _bucket(self.hash[use], buckets)
        by = by[np.argsort(bucket[by], kind="stable")]
        self.use, self.rows, self.bucket = use[by], rows[by], bucket[by]
        new = np.ones(len(by), dtype=bool)
        if len(by) > 1:
            new[1:] = (self.rows[1:] != self.rows[:-1]).any(axis=1)
        self.first = np.flatnonzero(new)  # of equal records
        self.nth = np.cumsum(new) - 1

    def owners(self) -> np.ndarray:
        """The smallest doc_id of each record."""
        ids = self.ids[self.doc[self.use]]
        return np.minimum.reduceat(ids, self.first) if len(ids) else ids


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash's top 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _runs(run_bytes: int):
    """Documents to rows of (run, ids, sizes, body)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            raw, at = utf8(batch.column(1))
            low = 0
            while low < len(ids):
                high = max(low + 1, int(np.searchsorted(at, at[low] + run_bytes, side="right")) - 1)
                high = min(high, len(ids))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(task << 32) + n], pa.int64()),
                        pa.array([ids[low:high].astype(np.int64).tobytes()], pa.binary()),
                        pa.array([np.diff(at[low : high + 1]).astype(np.int64).tobytes()], pa.binary()),
                        pa.array([raw[at[low] : at[high]].tobytes()], pa.binary()),
                    ],
                    ["run", "ids", "sizes", "body"],
                )
                low, n = high, n + 1

    return pack


def _kinds(buckets: int):
    """Each run's kinds of anchors, by bucket; several: seen in two documents of the run; often, times: which it has FEW times or more, and how often."""

    def list_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                run = Run.read(row)
                run.anchors()
                lo = np.full(len(run.kinds), NO_ID)
                hi = np.full(len(run.kinds), -1)
                np.minimum.at(lo, run.kind, run.doc)
                np.maximum.at(hi, run.kind, run.doc)
                several = lo < hi
                times = np.bincount(run.kind, minlength=len(run.kinds)).astype(np.uint32)
                bucket = _bucket(run.kinds, buckets)
                have, first = np.unique(bucket, return_index=True)
                cut = [*first, len(bucket)]
                parts = [slice(cut[i], cut[i + 1]) for i in range(len(have))]
                often = [np.flatnonzero(times[p] >= FEW) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(have, pa.int64()),
                        pa.array([row["run"]] * len(have), pa.int64()),
                        pa.array([run.kinds[p].astype(np.uint32).tobytes() for p in parts], pa.binary()),
                        pa.array([(run.kinds[p] >> np.uint64(32)).astype(np.uint8).tobytes() for p in parts], pa.binary()),
                        pa.array([np.packbits(several[p]).tobytes() for p in parts], pa.binary()),
                        pa.array([o.astype(np.uint32).tobytes() for o in often], pa.binary()),
                        pa.array([times[p][o].tobytes() for p, o in zip(parts, often, strict=True)], pa.binary()),
                    ],
                    ["bucket", "run", "low", "high", "several", "often", "times"],
                )

    return list_kinds


def _find_repeated(per_merge: int):
    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each run's kinds in a bucket, which ones any two documents have.

        hot has those of which there may be over ``per_merge`` records, bits the
        others. Kinds are compared by 40 bits besides the bucket's: two may be
        taken for one, which adds candidates and changes no result.
        """
        low = [np.frombuffer(x, np.uint32) for x in pdf["low"]]
        kinds = np.concatenate(low).astype(np.uint64) | (np.frombuffer(b"".join(pdf["high"]), np.uint8).astype(np.uint64) << np.uint64(32))
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[: len(k)] for x, k in zip(pdf["several"], low, strict=True)]) > 0
        begin = np.cumsum([0, *(len(x) for x in low)])
        times = np.ones(len(kinds), dtype=np.int64)
        for at, often, n in zip(begin, pdf["often"], pdf["times"], strict=False):
            times[at + np.frombuffer(often, np.uint32).astype(np.int64)] = np.frombuffer(n, np.uint32)
        most = np.where(times < FEW, FEW - 1, times)  # of records
        by = np.argsort(kinds, kind="stable")
        ordered = kinds[by]
        start = np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]) != 0)
        size = np.diff(np.append(start, len(ordered)))
        yes = (size > 1) | np.logical_or.reduceat(several[by], start)
        many = np.add.reduceat(most[by], start) > per_merge
        repeated, hot = np.empty(len(kinds), dtype=bool), np.empty(len(kinds), dtype=bool)
        repeated[by] = np.repeat(yes & ~many, size)
        hot[by] = np.repeat(yes & many, size)
        parts, hots = np.split(repeated, begin[1:-1]), np.split(hot, begin[1:-1])
        found = [int(x[p].sum()) for x, p in zip(np.split(times, begin[1:-1]), parts, strict=True)]
        return pd.DataFrame(
            {
                "run": pdf["run"],
                "bucket": pdf["bucket"],
                "size": [len(p) for p in parts],
                "found": found,
                "bits": [np.packbits(p).tobytes() for p in parts],
                "hot": [np.packbits(h).tobytes() if h.any() else None for h in hots],
            }
        )

    return find


def _repeated(run: Run, marks: list[dict] | None, name: str = "bits") -> np.ndarray:
    """Which of a run's kinds are repeated, or hot."""
    parts = [np.unpackbits(np.frombuffer(m[name] or bytes(-(-m["size"] // 8)), np.uint8))[: m["size"]] for m in sorted(marks or [], key=lambda m: m["bucket"])]
    return np.concatenate([*parts, np.zeros(0, np.uint8)]).astype(bool) if parts else np.zeros(len(run.kinds), dtype=bool)


def _hot_passages(run: Run, marks: list[dict] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The passages around a run's hot anchors: (start, owner, number among the different ones) of each, and where to find each different one."""
    use = np.flatnonzero(_repeated(run, marks, "hot")[run.kind])
    start = run.at[use, None] - np.arange(BEFORE + 1)
    inside = (start >= run.begin[use, None]) & (start + SPAN <= run.end[use, None])
    start, first = np.unique(start[inside], return_index=True)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    owner = run.ids[np.broadcast_to(run.doc[use, None], inside.shape)[inside][first]]
    rows = np.lib.stride_tricks.sliding_window_view(run.body, SPAN)[start]
    _, one, nth = np.unique(np.ascontiguousarray(rows).view(f"S{SPAN}").ravel(), return_index=True, return_inverse=True)
    return start, owner, nth, start[one]


def _least_owners(owner: np.ndarray, nth: np.ndarray, n: int) -> np.ndarray:
    least = np.full(n, NO_ID)
    np.minimum.at(least, nth, owner)
    return least


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run's different passages around hot anchors, with the smallest doc_id."""
    for batch in batches:
        for row in batch.to_pylist():
            run = Run.read(row)
            run.anchors()
            _, owner, nth, one = _hot_passages(run, row["marks"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["run"]] * len(one), pa.int64()),
                    pa.array(np.arange(len(one)), pa.int64()),
                    pa.array([run.body[p : p + SPAN].tobytes() for p in one], pa.binary()),
                    pa.array(_least_owners(owner, nth, len(one)), pa.int64()),
                ],
                ["run", "nth", "passage", "owner"],
            )


def _hot_covered(run: Run, marks: list[dict] | None, found: list[dict] | None) -> np.ndarray:
    """Which bytes of the run are removed as parts of passages around hot anchors."""
    start, owner, nth, one = _hot_passages(run, marks)
    least = _least_owners(owner, nth, len(one))
    if found:
        least[[x["nth"] for x in found]] = [x["least"] for x in found]
    edge = np.zeros(len(run.body) + 1, dtype=np.int64)
    gone = start[least[nth] < owner] if len(start) else start
    np.add.at(edge, gone, 1)
    np.add.at(edge, gone + SPAN, -1)
    return np.cumsum(edge[:-1]) > 0


def _front_coded(buckets: int):
    """Each run's sorted records, front-coded, with their owners, by bucket."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                run = Run.read(row)
                run.anchors()
                run.suffixes(_repeated(run, row["marks"]), buckets)
                rows, bucket, owners = run.rows[run.first], run.bucket[run.first], run.owners()
                have, first = np.unique(bucket, return_index=True)
                cut = [*first, len(bucket)]
                parts = [slice(cut[i], cut[i + 1]) for i in range(len(have))]
                coded = [front_code(rows[p]) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(have, pa.int64()),
                        pa.array([row["run"]] * len(have), pa.int64()),
                        pa.array([c[0].tobytes() for c in coded], pa.binary()),
                        pa.array([c[1] for c in coded], pa.binary()),
                        pa.array([owners[p].tobytes() for p in parts], pa.binary()),
                    ],
                    ["bucket", "run", "shared", "tails", "owners"],
                )

    return code


def resolve(shared: np.ndarray, rows: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted records: the smallest owner of equal ones, and a bit mask.

    Bit o of the mask says that the passage that starts o bytes before the
    anchor is also in a document smaller than that owner, whose record there
    differs elsewhere. Records of one anchor with equal first SPAN - o bytes
    stand together, as the shared prefixes tell; of these, the ones with equal
    o bytes before the anchor have that passage in common.
    """
    new = shared < WIDTH
    first = np.flatnonzero(new)
    nth = np.cumsum(new) - 1
    least = np.minimum.reduceat(owners, first)
    mask = np.zeros(len(first), dtype=np.uint32)
    common = shared[first].astype(np.int64)
    group = np.cumsum(common < ANCHOR) - 1
    many = np.flatnonzero(np.bincount(group)[group] > 1)
    if len(many):
        unique, gap, owner = rows[first[many]], common[many], least[many]
        after = (unique[:, :SPAN] != PAD).sum(axis=1)
        left = unique[:, SPAN:]
        before = (left != PAD).sum(axis=1)
        same = np.zeros(len(many), dtype=np.int64)  # a number for each different string of the o bytes before the anchor
        for o in range(BEFORE + 1):
            if o:
                same = np.unique(same * 256 + left[:, o - 1], return_inverse=True)[1]
            near = np.cumsum(gap < SPAN - o)
            whole = (after >= SPAN - o) & (before >= o)
            key = np.where(whole, same, np.arange(len(many)))
            by = np.lexsort((key, whole, near))
            new = np.ones(len(by), dtype=bool)
            new[1:] = (near[by][1:] != near[by][:-1]) | (whole[by][1:] != whole[by][:-1]) | (key[by][1:] != key[by][:-1])
            smallest = np.empty(len(by), dtype=np.int64)
            smallest[by] = np.minimum.reduceat(owner[by], np.flatnonzero(new))[np.cumsum(new) - 1]
            mask[many[whole & (smallest < owner)]] |= np.uint32(1 << o)
    return least[nth], mask[nth]


def _merge_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("run", ignore_index=True)
    runs = [(list(s), t) for s, t in zip(pdf["shared"], pdf["tails"], strict=True)]
    of, shared, rows = merge(runs, WIDTH)
    of = np.array(of)
    by = np.argsort(of, kind="stable")  # back to each run's own order
    owners = np.empty(len(of), dtype=np.int64)
    owners[by] = np.frombuffer(b"".join(pdf["owners"]), np.int64)
    least, mask = resolve(np.array(shared), np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WIDTH), owners)
    cut = np.cumsum([len(r[0]) for r in runs])[:-1]
    return pd.DataFrame(
        {
            "run": pdf["run"],
            "bucket": pdf["bucket"],
            "least": [x.tobytes() for x in np.split(least[by], cut)],
            "mask": [x.tobytes() for x in np.split(mask[by], cut)],
        }
    )


def _covered(run: Run, found: list[dict] | None) -> np.ndarray:
    """Which bytes of the run are removed."""
    edge = np.zeros(len(run.body) + 1, dtype=np.int64)
    if found and len(run.use):
        found = sorted(found, key=lambda x: x["bucket"])
        least = np.concatenate([np.frombuffer(x["least"], np.int64) for x in found])[run.nth]
        mask = np.concatenate([np.frombuffer(x["mask"], np.uint32) for x in found])[run.nth]
        at, begin, end, mine = run.at[run.use], run.begin[run.use], run.end[run.use], run.ids[run.doc[run.use]]
        far, close = np.minimum(BEFORE, at - begin), np.maximum(0, SPAN - (end - at))  # offsets of passages that lie in the document
        whole = (least < mine) & (far >= close)
        np.add.at(edge, (at - far)[whole], 1)
        np.add.at(edge, (at - close + SPAN)[whole], -1)
        some = np.flatnonzero((least == mine) & (mask > 0))
        for o in range(BEFORE + 1):
            on = some[mask[some] >> np.uint32(o) & np.uint32(1) > 0]
            np.add.at(edge, at[on] - o, 1)
            np.add.at(edge, at[on] - o + SPAN, -1)
    return np.cumsum(edge[:-1]) > 0


def _remove(buckets: int, texts: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                run = Run.read(row)
                run.anchors()
                run.suffixes(_repeated(run, row["marks"]), buckets)
                gone = _covered(run, row["found"]) | _hot_covered(run, row["marks"], row["passages"])
                out = []
                for i, end in enumerate(run.ends):
                    begin = run.ends[i - 1] if i else 0
                    off = gone[begin:end]
                    kept = run.body[begin:end][~off].tobytes()
                    spans = int((off[1:] & ~off[:-1]).sum() + (off[:1].sum()))
                    doc_id = int(run.ids[i])
                    out.append((None if doc_id == NO_ID else doc_id, int(end - begin), int(off.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if texts else None))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return remove


@scoped
def remove_repeats(docs: DataFrame, texts: bool = False, run_bytes: int = RUN_BYTES, per_merge: int = PER_MERGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept of every document.

    Takes ``doc_id`` (an integer) and ``text``; other columns are ignored. A
    text is its UTF-8 bytes, null as empty. Each byte goes that a 50-byte
    string covers which also starts in a document with a smaller doc_id; kept
    has what is left if ``texts`` is set, else null. Rows that share a doc_id
    never remove from each other; a null doc_id is larger than any other.
    Texts under 50 bytes stay. An empty table gives an empty result.

    A 50-byte string is anchored at its 24 bytes of least hash, so that copies
    have equal anchors, and only the suffixes at anchors that two documents
    have go into the sort. Each run of documents sorts its suffix records (50
    bytes from the anchor on, 26 before it), front-codes them and sends them
    by ranges of the anchor's hash; each range is merged by a loser tree over
    the runs. The merge's order and shared prefixes tell which passages agree.
    Anchors that may have over ``per_merge`` records are not merged: each run
    sends the different passages around them with the smallest doc_id of each,
    so that a passage is one row a run at most wherever it is common.
    Documents are written once, bucketed by run, and joined with what comes
    back without being shuffled.
    """
    spark = docs.sparkSession
    name = f"corpusmill_runs_{uuid.uuid4().hex}"
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = read.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = cells_for(size, PER_TASK, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = f"{scratch_dir(spark)}/{name}"
    written(path)
    try:
        (
            read.mapInArrow(_runs(run_bytes), "run long, ids binary, sizes binary, body binary")
            .write.option("path", path)
            .bucketBy(parts, "run")
            .sortBy("run")
            .saveAsTable(name)
        )
        return _without_repeats(spark.table(name), size, parts, texts, per_merge)
    finally:
        spark.sql(f"drop table if exists {name}")


def _without_repeats(runs: DataFrame, size: int, parts: int, texts: bool, per_merge: int) -> DataFrame:
    """The same for a table of runs in ``parts`` buckets."""
    spark = runs.sparkSession
    kinds = cells_for(size // 12, PER_BUCKET, parts)
    listed = runs.mapInArrow(_kinds(kinds), "bucket long, run long, low binary, high binary, several binary, often binary, times binary")
    repeated = stored(
        listed.repartition(cells_for(kinds, 8, parts), "bucket").groupBy("bucket").applyInPandas(_find_repeated(per_merge), "run long, bucket long, size long, found long, bits binary, hot binary"), "repeated"
    )
    buckets = cells_for(repeated.agg(F.coalesce(F.sum("found"), F.lit(0))).first()[0], per_merge, parts)
    marks = repeated.repartition(parts, "run").groupBy("run").agg(F.collect_list(F.struct("bucket", "size", "bits", "hot")).alias("marks"))  # a run's own anchors
    marked = runs.join(marks, "run", "left")
    coded = marked.mapInArrow(_front_coded(buckets), "bucket long, run long, shared binary, tails binary, owners binary")
    merged = stored(coded.repartition(cells_for(buckets, 4, parts), "bucket").groupBy("bucket").applyInPandas(_merge_bucket, "run long, bucket long, least binary, mask binary"), "merged")
    found = merged.repartition(parts, "run").groupBy("run").agg(F.collect_list(F.struct("bucket", "least", "mask")).alias("found"))  # a run's own records
    told = spark.createDataFrame([], "run long, passages array<struct<nth: long, least: long>>")
    if not repeated.where("hot is not null").isEmpty():
        each = marked.where(F.exists("marks", lambda m: m["hot"].isNotNull())).mapInArrow(_passages, "run long, nth long, passage binary, owner long")
        each = stored(each, "passages-by-run")
        owners = each.groupBy("passage").agg(F.min("owner").alias("least"))  # added up before they move
        least = joined_hot(each, stored(owners, "owners"), "passage").where("least < owner")
        told = stored(least.repartition(parts, "run").groupBy("run").agg(F.collect_list(F.struct("nth", "least")).alias("passages")), "passages")  # a run's own passages
    return stored(
        marked.join(found, "run", "left").join(told, "run", "left").mapInArrow(
            _remove(buckets, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
        ),
        "kept",
        keep=True,
    )


def brute_force(texts: dict[int, str | None]) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256), for tests."""
    first: dict[bytes, int] = {}
    out = {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        off = [False] * len(raw)
        own = [raw[p : p + SPAN] for p in range(len(raw) - SPAN + 1)]
        for p, w in enumerate(own):
            if w in first:
                off[p : p + SPAN] = [True] * SPAN
        for w in own:
            first.setdefault(w, i)
        spans = sum(x and not (p and off[p - 1]) for p, x in enumerate(off))
        kept = bytes(b for b, x in zip(raw, off, strict=True) if not x)
        out[i] = (len(raw), sum(off), spans, hashlib.sha256(kept).hexdigest())
    return out
