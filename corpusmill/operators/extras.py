"""Smaller scores, plans and lookups."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.columns import clamp, rounded
from corpusmill.functions.lineage import first_of, with_runs
from corpusmill.operators.vectors import Part, blocks, matched

#: Model parameters by the first name part that matches (fixed values).
SIZES = (("large", 3.3e9), ("medium", 1.5e9), ("small", 3e8))


def quality(clipping: Column, silence: Column, lufs: Column) -> Column:
    """(score, grade, flags): 100 less penalties for clipping, silence and loudness off -14."""
    score = F.greatest(F.lit(0.0), 100.0 - 400.0 * clipping - 50.0 * silence - 2.0 * F.greatest(F.lit(0.0), F.abs(lufs + 14.0) - 2.0))
    grade = F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 50, "C").otherwise("F")
    flags = F.filter(F.array(F.when(clipping > 0.01, F.lit("clipping")), F.when(silence > 0.3, F.lit("silence")), F.when(lufs < -20, F.lit("quiet"))), lambda x: x.isNotNull())
    return F.struct(rounded(score, 2).alias("score"), grade.alias("grade"), flags.alias("flags"))


def energy_cost(model: Column, clips: Column, tokens: int = 256, epochs: Column | None = None) -> Column:
    """(params, flops, kwh) of generating clips, or of training on them for epochs."""
    params = F.lit(1e9)
    for name, n in reversed(SIZES):
        params = F.when(F.contains(F.lower(model), F.lit(name)), n).otherwise(params)
    passes = F.lit(1.0) if epochs is None else F.when(epochs > 0, 3.0 * epochs).otherwise(1.0)
    flops = params * 2.0 * tokens * clips * passes
    return F.struct(params.alias("params"), flops.alias("flops"), (flops * 1e-12 / 3.6e6).alias("kwh"))


def learning_rate(step: Column, lr: float, warmup: int, total: int, mode: str = "cosine") -> Column:
    """Linear warm-up, then cosine decay or constant."""
    done = clamp((step - warmup) / float(max(1, total - warmup)))
    after = lr * 0.5 * (1.0 + F.cos(F.lit(np.pi) * done)) if mode == "cosine" else F.lit(lr)
    return F.when(step < warmup, lr * (step + 1) / float(max(1, warmup))).otherwise(after)


def syllable_target(bpm: Column, cadence: Column, density: Column) -> Column:
    base = F.when(bpm >= 150, 7).when(bpm >= 120, 9).when(bpm >= 90, 11).otherwise(13)
    shift = F.when(cadence == "fast", 2).when(cadence == "slow", -2).otherwise(0)
    return F.greatest(F.lit(6), F.least(F.lit(16), base + shift + (density - 3)))


def grid(rows: DataFrame, **axes: list) -> DataFrame:
    """All combinations of a few values each, for each of the rows."""
    df = rows
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def provenance(rows: DataFrame, **defaults: str) -> DataFrame:
    """Columns that are missing filled with a default; ones that exist stay, nulls too."""
    return rows.withColumns({k: F.lit(v) for k, v in defaults.items() if k not in rows.columns})


def removable(files: DataFrame, keep: int, oldest: Column) -> DataFrame:
    """Backups beyond the newest ``keep`` of their kind, and temporary files older than the cut."""
    kept = first_of(files.where("kind = 'backup'"), "kind", [F.desc("mtime"), "path"], keep, "path").select(F.col("path").alias("_path"), F.col("mtime").alias("_mtime")).distinct()
    out = files.join(kept, (F.col("path") == F.col("_path")) & F.col("mtime").eqNullSafe(F.col("_mtime")), "left")
    why = F.when((F.col("kind") == "backup") & F.col("_path").isNull(), "old backup").when((F.col("kind") == "temp") & (F.col("mtime") < oldest), "stale")
    return out.withColumn("why", why).where("why is not null").groupBy("path").agg(F.max("size").alias("size"), F.min("why").alias("why"))


def row_gate(clap: Column, deviation: Column, low: Column, high: Column) -> Column:
    """Reasons why a row fails its genre's gate; missing metrics do not fail."""
    return F.filter(F.array(F.when(clap < low, F.lit("clap")), F.when(F.abs(deviation) > high, F.lit("deviation"))), lambda x: x.isNotNull())


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins from the least to the largest value, the last closed."""
    edge = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    bin_ = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins))))
    return rows.where(F.col(value).isNotNull()).join(F.broadcast(edge)).groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # one row


def headed_sections(lines: DataFrame) -> DataFrame:
    """Lines under the last bracketed header before them: (doc_id, section, n)."""
    head = F.nullif(F.regexp_extract("line", r"^\[([A-Za-z ]+)\]$", 1), F.lit(""))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    under = lines.withColumn("head", head).withColumn("section", F.coalesce(F.last("head", ignorenulls=True).over(w), F.lit("verse")))
    return under.where("head is null and trim(line) <> ''").groupBy("doc_id", F.lower("section").alias("section")).agg(F.count("*").alias("n"))


def merged_notes(frames: DataFrame, by: str, order: str, pitch: str) -> DataFrame:
    """Runs of equal pitch as notes: (by, start, n, pitch); null pitch is a gap."""
    runs = with_runs(frames, by, order, pitch).where(F.col(pitch).isNotNull())
    return runs.groupBy(by, "run").agg(F.min(order).alias("start"), F.count("*").alias("n"), F.first(pitch).alias("pitch")).drop("run")


#: Vectors of each table that tell about where the median distance is: that choice alters the time, not the median.
SAMPLE = 1_000


def _some(table: DataFrame, most: int) -> tuple[int, float, np.ndarray]:
    """(number of vectors, the longest one's length, a few vectors of each block) of a table of blocks."""
    per = max(1, most // max(1, table.count()))

    def run(batches):
        for batch in batches:
            for row in batch.to_struct_array():
                part = Part.of(row)
                yield pa.RecordBatch.from_pylist([{"n": len(part.ids), "longest": float(np.linalg.norm(part.x, axis=1).max()), "few": part.x[part.ids.argsort()[:per]].tolist()}])

    held = table.mapInArrow(run, "n long, longest double, few array<array<double>>").collect()  # a row a block
    few = [v for r in held for v in r["few"]]
    return sum(r["n"] for r in held), max((r["longest"] for r in held), default=0.0), np.array(few[: 2 * most])


def median_distance(one: DataFrame, two: DataFrame, bins: int = 65_536) -> float:
    """The median distance of a vector of one table and one of the other; both tables are blocks.

    A sample tells a range that is likely to hold it. All distances below the
    range are counted, those inside in equal ranges, and the range that holds
    a middle one again, until it is as narrow as numbers tell; if none of them
    was in the range, from the whole span. What reaches the driver is at most
    ``bins`` counts a pass and middle distance.
    """
    (n, far, x), (m, wide, y) = _some(one, SAMPLE), _some(two, SAMPLE)
    high = (far + wide) * (1 + 1e-9)
    if not n * m or not high:
        return 0.0
    near = np.sqrt(np.maximum(Part(0, np.arange(len(x)), x, np.arange(0)).squared(Part(0, np.arange(len(y)), y, np.arange(0))), 0))
    low, up = np.quantile(near, [0.47, 0.53])
    middle = {n * m // 2, (n * m - 1) // 2}
    found, held_in, spans = {}, set(), {k: (float(low), max(float(up - low), 1e-9 * high)) for k in middle}
    while spans:
        ranges = sorted(set(spans.values()))

        def count(a: Part, b: Part, ranges=ranges) -> pd.DataFrame:
            inside, below = np.zeros((len(ranges), bins), np.int64), np.zeros(len(ranges), np.int64)
            for d in a.tiles(b):
                for i, (low, width) in enumerate(ranges):
                    under = d < low * low * (1 - 1e-12) if low > 0 else np.zeros(d.shape, bool)
                    at = np.floor((np.sqrt(d[~under & (d <= (low + width) ** 2 * (1 + 1e-12))]) - low) / (width / bins))
                    below[i] += np.count_nonzero(under) + np.count_nonzero(at < 0)
                    inside[i] += np.bincount(at[(at >= 0) & (at < bins)].astype(np.int64), minlength=bins)
            i, j = np.nonzero(inside)
            at = np.arange(len(ranges))
            return pd.DataFrame({"i": np.append(at, i), "bin": np.append(np.full(len(ranges), -1), j), "n": np.append(below, inside[i, j])})

        held = matched(one, two, count, "i long, bin long, n long").groupBy("i", "bin").agg(F.sum("n").alias("n")).orderBy("i", "bin").toPandas()
        for k, (low, width) in list(spans.items()):
            mine = held[held["i"] == ranges.index((low, width))]
            at = int((mine["n"].cumsum() <= k).sum())
            if 0 < at < len(mine):
                spans[k] = (low + float(mine["bin"].iloc[at]) * (width / bins), width / bins)
            else:  # beyond the sample's range; of one that was counted, on its edge but for rounding
                spans[k] = (low if at == 0 else low + width, 0.0) if k in held_in else (0.0, high)
            held_in.add(k)
            if spans[k][1] <= 1e-10 * high:
                low, width = spans.pop(k)
                found[k] = low + width / 2
    return sum(found[k] for k in middle) / len(middle)


def kernel_discrepancy(one: DataFrame, two: DataFrame, key: str, vector: str, sigma: float | None = None) -> DataFrame:
    """Biased squared MMD with a Gaussian kernel, from sums over pairs of blocks.

    Without ``sigma``, the median distance across the tables is taken, or 1 if that is 0.
    """
    a, b = blocks(one, key, vector), blocks(two, key, vector)
    sigma = sigma or median_distance(a, b) or 1.0

    def sums(a: Part, b: Part, twice: bool) -> pd.DataFrame:
        s, times = 0.0, 2 if twice and a.block != b.block else 1
        for d in a.tiles(b):
            d /= -2 * sigma * sigma
            s += float(np.exp(d, out=d).sum())
        return pd.DataFrame({"s": [s * times], "n": [len(a.ids) * len(b.ids) * times]})

    def mean(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        own = a is b  # each pair of blocks is as good as its reverse
        return matched(a, b, lambda x, y: sums(x, y, own), "s double, n long", ordered=own).agg((F.sum("s") / F.sum("n")).alias(name))

    return mean(a, a, "xx").join(mean(b, b, "yy")).join(mean(a, b, "xy")).select(rounded(F.col("xx") + F.col("yy") - 2 * F.col("xy"), 6).alias("mmd"))  # one row each


def _closest(d: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row of distances, where the least one is; of those that are equal to six places, the one of the smallest id."""
    i, j = np.nonzero(d <= d.min(axis=1)[:, None] + 1.1e-6)
    order = np.lexsort((ids[j], np.round(d[i, j], 6), i))
    i, j = i[order], j[order]
    return j[np.append(True, i[1:] != i[:-1])]


def _closer(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
    """Of two tables of the same vectors' nearest ones, the nearer of each; a twin in either is one."""
    other = ((two["d"] < one["d"]) | ((two["d"] == one["d"]) & (two["other"] < one["other"]))).to_numpy()
    kept = {c: np.where(other, two[c], one[c]) for c in one.columns}
    return pd.DataFrame(kept | {"twin": one["twin"] | two["twin"]})


def one_nn_accuracy(rows: DataFrame, key: str, vector: str, side: str) -> DataFrame:
    """Share of vectors whose nearest other vector, by distance, is of their own side.

    0.5 under two vectors, and where a vector of one side equals one of the other: such sets cannot be told apart.
    """

    def best(d: np.ndarray, a: Part, b: Part) -> pd.DataFrame:
        at, row = _closest(d, b.ids), np.arange(len(a.ids))
        most, twin = b.norms.max(), np.zeros(len(a.ids), bool)
        for i in np.nonzero(d[row, at] < 1e-12 * np.maximum(1.0, a.norms + most) + 1.1e-6)[0]:
            twin[i] = ((a.extra[i] != b.extra) & (d[i] < 1e-12 * np.maximum(1.0, a.norms[i] + b.norms))).any()
        return pd.DataFrame({"id": a.ids, "mine": a.extra, "d": np.round(d[row, at], 6), "other": b.ids[at], "its": b.extra[at], "twin": twin})

    def near(a: Part, b: Part) -> pd.DataFrame:
        found, theirs = [], None
        for some in a.slices(b):
            d = some.squared(b)
            if a.block == b.block:
                d[some.ids[:, None] == b.ids[None]] = np.inf
            found.append(best(d, some, b))
            if a.block != b.block:
                now = best(d.T, b, some)
                theirs = now if theirs is None else _closer(theirs, now)
        return pd.concat(found if theirs is None else [*found, theirs])

    own = blocks(rows, key, vector, side)
    met = matched(own, own, near, "id long, mine long, d double, other long, its long, twin boolean", ordered=True)
    best_of = met.groupBy("id", "mine").agg(F.min_by("its", F.struct("d", "other")).alias("its"), F.bool_or("twin").alias("twin"))
    accuracy = rounded(F.avg((F.col("mine") == F.col("its")).cast("double")))
    return best_of.agg(F.count("*").alias("n"), F.when((F.count("*") < 2) | F.bool_or("twin"), 0.5).otherwise(accuracy).alias("accuracy"))


#: What a listening campaign shows of a result (fixed values).
CLIP = ("prompt", "audio_path", "checkpoint", "clap_score", "deviation", "section", "bpm_target")


def clip(columns: list[str]) -> Column:
    """A result row as the record of a clip; columns that it lacks are null."""
    return F.struct(*[F.col(c) if c in columns else F.lit(None).cast("string").alias(c) for c in CLIP])
