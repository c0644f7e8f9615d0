"""Sound by frames: one pass makes frame rows of samples, the rest are aggregates and windows over them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.columns import NOTES, rounded

FRAME = T.StructType([T.StructField("i", T.IntegerType())] + [T.StructField(n, T.DoubleType()) for n in ("t", "rms", "peak", "centroid", "rolloff", "bandwidth", "flatness", "flux")])
#: Frequency bands of instruments in Hz (fixed values).
BANDS = {"kick": (40, 120), "bass_808": (40, 160), "snare_clap": (1500, 4500), "hi_hats": (6000, 12000), "tonal": (200, 3000)}


def _spectra(y: np.ndarray, size: int, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """Frames of the samples, the last one padded, and their magnitude spectra."""
    n = 1 + max(0, -(-(len(y) - size) // hop))
    cut = np.lib.stride_tricks.sliding_window_view(np.pad(y, (0, (n - 1) * hop + size - len(y))), size)[::hop]
    return cut, np.abs(np.fft.rfft(cut * np.hanning(size), axis=1))


def frame_rows(y: np.ndarray, rate: int, size: int, hop: int) -> list[tuple]:
    """Level, spectral shape and rise of each frame; no samples, no frames."""
    if not len(y):
        return []
    cut, mag = _spectra(y, size, hop)
    hz, total = np.fft.rfftfreq(size, 1 / rate), np.maximum(mag.sum(axis=1), 1e-12)
    centroid = mag @ hz / total
    columns = (
        np.sqrt((cut**2).mean(axis=1)),
        np.abs(cut).max(axis=1),
        centroid,
        hz[(np.cumsum(mag, axis=1) >= 0.85 * total[:, None]).argmax(axis=1)],
        np.sqrt((mag * (hz[None, :] - centroid[:, None]) ** 2).sum(axis=1) / total),
        np.exp(np.log(mag**2 + 1e-10).mean(axis=1)) / (mag**2 + 1e-10).mean(axis=1),
        np.r_[0.0, np.maximum(np.diff(mag, axis=0), 0).sum(axis=1)],
    )
    return [(i, i * hop / rate, *map(float, row)) for i, row in enumerate(zip(*columns, strict=True))]


def frames(rows: DataFrame, key: str, samples: str, rate: int, size: int = 2048, hop: int = 512) -> DataFrame:
    """A row for each frame of each sound: (key, i, t, rms, peak, centroid, rolloff, bandwidth, flatness, flux)."""

    @F.pandas_udf(T.ArrayType(FRAME))
    def cut(column: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(FRAME.names, r, strict=True)) for r in frame_rows(np.asarray(y if y is not None else [], dtype=float), rate, size, hop)] for y in column])

    return rows.select(key, F.explode(cut(samples)).alias("f")).select(key, "f.*")


def mean_spectra(rows: DataFrame, key: str, samples: str, rate: int, size: int = 2048, hop: int = 512) -> DataFrame:
    """(key, hz, magnitude): each sound's mean spectrum."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def mean(column: pd.Series) -> pd.Series:
        return pd.Series([_spectra(np.asarray(y, dtype=float), size, hop)[1].mean(axis=0) if y is not None and len(y) else [] for y in column])

    return rows.select(key, F.posexplode(mean(samples)).alias("bin", "magnitude")).select(key, (F.col("bin") * (rate / size)).alias("hz"), "magnitude")


def loudness(frame: DataFrame, key: str) -> DataFrame:
    """Peak in dB, the 10th and 90th percentile of frame levels in dB under the loudest, and their distance."""
    top = F.max("rms").over(Window.partitionBy(key))
    level = F.greatest(20 * F.log10(F.greatest("rms", F.lit(1e-5))) - 20 * F.log10(F.greatest(top, F.lit(1e-5))), F.lit(-80.0))
    by = frame.withColumn("level", level).groupBy(key).agg(F.max("peak").alias("peak"), F.percentile("level", F.lit(0.1)).alias("low"), F.percentile("level", F.lit(0.9)).alias("high"))
    return by.select(key, rounded(20 * F.log10(F.col("peak") + 1e-12), 2).alias("peak_db"), rounded("low", 2).alias("rms_p10_db"), rounded("high", 2).alias("rms_p90_db"), rounded(F.col("high") - F.col("low"), 2).alias("dynamic_range_db"))


def spectral_shape(frame: DataFrame, key: str) -> DataFrame:
    """Means of the frames' spectral measures, and the crest factor."""
    crest = F.max("peak") / (F.sqrt(F.avg(F.col("rms") * F.col("rms"))) + 1e-12)
    return frame.groupBy(key).agg(*[rounded(F.avg(c), p).alias(c) for c, p in (("centroid", 1), ("rolloff", 1), ("bandwidth", 1), ("flatness", 4))], rounded(crest, 2).alias("crest_factor"), rounded(F.avg("rms"), 6).alias("rms_mean"))


def peaks(spectra: DataFrame, key: str, n: int = 6) -> DataFrame:
    """The n highest local maxima of each spectrum: above the left neighbour, not below the right one."""
    w = Window.partitionBy(key).orderBy("hz")
    tops = spectra.withColumns({"before": F.lag("magnitude").over(w), "after": F.lead("magnitude").over(w)}).where("magnitude > before and magnitude >= after")
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("magnitude"), "hz"))
    return tops.withColumn("nth", nth).where(F.col("nth") <= n).select(key, "hz", "magnitude")


def masking(spectra: DataFrame, key: str, n: int = 6, band: float = 1.26, ratio: float = 4.0) -> DataFrame:
    """Pairs of a sound's n peaks within a critical band of which one is much louder."""
    top = peaks(spectra, key, n)
    one, two = top.select(key, F.col("hz").alias("f1"), F.col("magnitude").alias("a1")), top.select(key, F.col("hz").alias("f2"), F.col("magnitude").alias("a2"))
    louder = F.greatest("a1", "a2") / F.nullif(F.least("a1", "a2"), F.lit(0.0))
    met = one.join(two, key).where((F.col("f1") > 0) & (F.col("f1") < F.col("f2")) & (F.col("f2") / F.col("f1") < band) & (louder > ratio))  # n squared a sound at most
    return met.select(key, rounded("f1", 1).alias("f1_hz"), rounded("f2", 1).alias("f2_hz"), rounded(louder, 2).alias("amplitude_ratio"))


def speakers(frame: DataFrame, key: str, threshold: float = 0.02, least: int = 40) -> DataFrame:
    """Runs of at least so many loud frames, as two voices by the median of their mean centroids.

    A sound with loud frames but no long run is one run of all its frames; a
    silent one has none.
    """
    w = Window.partitionBy(key).orderBy("i")
    marked = frame.withColumn("loud", F.col("rms") > threshold).withColumn("any", F.max("loud").over(Window.partitionBy(key))).where("any")
    marked = marked.withColumn("island", F.row_number().over(w) - F.row_number().over(Window.partitionBy(key, "loud").orderBy("i")))
    mean = F.avg("centroid").alias("centroid")
    runs = marked.where("loud").groupBy(key, "island").agg(F.min("i").alias("first"), F.max("i").alias("last"), mean, F.count("*").alias("n")).where(F.col("n") >= least)
    whole = marked.groupBy(key).agg(F.min("i").alias("first"), F.max("i").alias("last"), mean).join(runs.select(key).distinct(), key, "left_anti")
    found = runs.select(key, "first", "last", "centroid").unionByName(whole.select(key, "first", "last", "centroid"))
    middle = F.median("centroid").over(Window.partitionBy(key))
    return found.withColumn("speaker", (F.col("centroid") > middle).cast("int")).withColumn("centroid", rounded("centroid", 1))


@F.pandas_udf(T.DoubleType())
def tempo_of(flux: pd.Series, hop_s: pd.Series) -> pd.Series:
    """BPM between 60 and 200 at which the rises repeat most; null where nothing repeats."""

    def one(x, step: float) -> float | None:
        x = np.asarray(x if x is not None else [], dtype=float)
        low, high = max(1, int(0.3 / step)), min(len(x) - 1, int(1.0 / step) + 1)
        if low >= high or x.std() < 1e-12:
            return None
        x = x - x.mean()
        size = 1 << (2 * len(x) - 1).bit_length()
        ac = np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2)[: high + 1]
        return 60.0 / ((low + int(ac[low:].argmax())) * step)

    return pd.Series([one(x, s) for x, s in zip(flux, hop_s, strict=True)], dtype="float64")


def local_tempos(frame: DataFrame, key: str, hop_s: float, seconds: float = 4.0) -> DataFrame:
    """(key, t, bpm): the tempo in windows that overlap by half; a window's frames are few."""
    half = seconds / 2
    at = F.floor(F.col("t") / half).cast("int")
    each = frame.withColumn("w", F.explode(F.array(at - 1, at))).where("w >= 0")
    by = each.groupBy(key, "w").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "flux"))), lambda f: f["flux"]).alias("flux"))
    full = by.where(F.size("flux") >= int(seconds / hop_s * 0.99))
    return full.select(key, (F.col("w") * half).alias("t"), tempo_of("flux", F.lit(hop_s)).alias("bpm")).where("bpm is not null and not isnan(bpm)")


def tempo_drift(tempos: DataFrame, key: str, duration: Column) -> DataFrame:
    """Mean tempo, its deviation and slope; steady under 2 % drift over the sound, else rushing or dragging.

    Sounds with fewer than two windows have no drift and no row. duration: an
    aggregate over the windows, in seconds.
    """
    slope = F.regr_slope("bpm", "t")
    by = tempos.groupBy(key).agg(F.count("*").alias("n"), F.avg("bpm").alias("mean"), F.stddev_pop("bpm").alias("std"), slope.alias("slope"), (slope * duration).alias("drift")).where("n >= 2")
    verdict = F.when(F.col("mean") <= 0, "unknown").when(F.abs("drift") / F.col("mean") < 0.02, "steady").when(F.col("slope") > 0, "rushing").otherwise("dragging")
    return by.select(key, rounded("mean", 2).alias("mean_bpm"), rounded("std", 2).alias("std_bpm"), rounded("slope").alias("drift_bpm_per_sec"), rounded("drift").alias("total_drift"), verdict.alias("verdict"))


def downbeat_phase(beats: DataFrame, key: str, position: str, onset: str, per_bar: int = 4) -> DataFrame:
    """The place in the bar whose beats rise most on average; the earliest of equal ones."""
    by = beats.groupBy(key, (F.col(position) % per_bar).alias("phase")).agg(F.avg(onset).alias("rise"))
    return by.groupBy(key).agg(F.min_by("phase", F.struct((-F.col("rise")).alias("r"), "phase")).cast("int").alias("downbeat_phase"))


def interpolated(series: Column, at: Column) -> Column:
    """The value of an array between its positions, from 0; the end values outside."""
    top = F.size(series) - 1
    x = F.greatest(F.lit(0.0), F.least(at, top.cast("double")))
    low = F.floor(x).cast("int")
    a, b = F.get(series, low), F.get(series, F.least(low + 1, top))
    return a + (b - a) * (x - low)


def swing(rows: DataFrame, key: str, onset: str, beats: str, bpm: str, hop_s: float) -> DataFrame:
    """How far the rise half a beat later reaches that on the beat: straight below 0.5, moderate below 0.9, else swung.

    onset: array by frame; beats: array of seconds, of which the last is left out.
    """
    some = F.slice(beats, 1, F.greatest(F.size(beats) - 1, F.lit(0)))
    total = lambda shift: F.aggregate(some, F.lit(0.0), lambda a, b: a + interpolated(F.col(onset), (b + shift) / hop_s))
    on, off = total(F.lit(0.0)), total(30.0 / F.col(bpm))
    ratio = F.when((F.col(bpm) > 0) & (F.size(beats) > 1) & (on / F.size(some) > 1e-9), off / on)
    feel = F.when(F.col("r").isNull(), "unknown").when(F.col("r") < 0.5, "straight").when(F.col("r") < 0.9, "moderate").otherwise("swung")
    return rows.select(key, ratio.alias("r")).select(key, rounded("r").alias("ratio"), feel.alias("feel"))


def onset_alignment(frame: DataFrame, key: str, on_beat: Column) -> DataFrame:
    """How much of the rise falls on beat frames, from 0 at the share of such frames to 1; null without rise or beats."""
    by = frame.groupBy(key).agg(F.avg(F.when(on_beat, F.col("flux"))).alias("on"), F.avg("flux").alias("all"), F.avg(on_beat.cast("int")).alias("base"))
    score = F.when(F.col("base") >= 1, 1.0).otherwise((F.col("on") / F.col("all") - F.col("base")) / (1 - F.col("base")))
    return by.select(key, F.when((F.col("all") > 1e-9) & F.col("on").isNotNull(), rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))).alias("alignment"))


def instrument_presence(spectra: DataFrame, key: str) -> DataFrame:
    """Shares of the bands' mean magnitudes."""
    by = spectra.groupBy(key).agg(*[F.coalesce(F.avg(F.when((F.col("hz") >= a) & (F.col("hz") < b), F.col("magnitude"))), F.lit(0.0)).alias(n) for n, (a, b) in BANDS.items()])
    total = sum((F.col(n) for n in BANDS), F.lit(1e-9))
    return by.select(key, *[rounded(F.col(n) / total).alias(n) for n in BANDS])


def chord(chroma: Column) -> Column:
    """The major or minor triad nearest to a 12-bin chroma: (chord, confidence); null for silence."""
    length = F.sqrt(F.aggregate(chroma, F.lit(0.0), lambda a, x: a + x * x))
    third = lambda i, m: (F.get(chroma, F.lit(i)) + F.get(chroma, F.lit((i + m) % 12)) + F.get(chroma, F.lit((i + 7) % 12))) / math.sqrt(3)
    each = [F.struct((-third(i, m) / length).alias("far"), F.lit(2 * i + k).alias("nth"), F.lit(n + q).alias("chord")) for i, n in enumerate(NOTES) for k, (q, m) in enumerate((("", 4), ("m", 3)))]
    best = F.array_min(F.array(*each))
    return F.when((F.size(chroma) == 12) & (length > 0), F.struct(best["chord"].alias("chord"), rounded(-best["far"]).alias("confidence")))


@F.pandas_udf(T.DoubleType())
def pitch(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """Frequency between 60 and 1,200 Hz at which a frame repeats; null if quiet, short or without pitch."""

    def one(y, hz: float) -> float | None:
        y = np.asarray(y if y is not None else [], dtype=float)
        if len(y) < 64 or np.sqrt((y * y).mean()) < 1e-3:
            return None
        y = y - y.mean()
        ac = np.fft.irfft(np.abs(np.fft.rfft(y, 2 * len(y))) ** 2)[: len(y)]
        low, high = int(hz / 1200), min(int(hz / 60), len(y) - 1)
        if low >= high:
            return None
        at = low + int(ac[low:high].argmax())
        return hz / at if ac[at] >= 0.3 * (ac[0] + 1e-9) else None

    return pd.Series([one(y, r) for y, r in zip(samples, rate, strict=True)], dtype="float64")


def mixed(stems: DataFrame, key: str, name: str, samples: str, gains: dict[str, float], but: tuple[str, ...] = ()) -> DataFrame:
    """Each sound's stems added up sample by sample, by gain; stems left out in ``but`` give the instrumental.

    Shorter stems end in silence.
    """
    gain = F.lit(1.0)
    for stem, g in gains.items():
        gain = F.when(F.col(name) == stem, F.lit(g)).otherwise(gain)
    heard = F.when(F.col(name).isin(*but), 0.0).otherwise(gain) if but else gain
    each = stems.select(key, name, heard.alias("g"), F.col(samples).alias("y")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(name, "g", "y"))).alias("s"))  # a few stems a sound
    add = lambda a, s: F.zip_with(a, F.coalesce(s["y"], F.array().cast("array<double>")), lambda x, y: F.coalesce(x, F.lit(0.0)) + s["g"] * F.coalesce(y, F.lit(0.0)))
    return each.select(key, F.aggregate("s", F.array().cast("array<double>"), add).alias(samples))


# augmentation


def amplified(samples: Column, db: Column) -> Column:
    return F.transform(samples, lambda x: x * F.pow(F.lit(10.0), db / 20))


def with_noise(samples: Column, level: float, *seed: Column) -> Column:
    """Gaussian noise at a share of the peak, from a hash of the seed and the position."""
    peak = F.array_max(F.transform(samples, F.abs)) + 1e-6
    unit = lambda i, k: (F.pmod(F.xxhash64(*seed, i, F.lit(k)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    gauss = lambda i: F.sqrt(-2 * F.log(unit(i, 0))) * F.cos(2 * math.pi * unit(i, 1))
    return F.transform(samples, lambda x, i: x + level * gauss(i) * peak)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def tilted(samples: pd.Series, db: pd.Series) -> pd.Series:
    """One-pole tilt: brighter for positive dB, darker for negative ones."""

    def one(y, d: float):
        y, a = np.asarray(y if y is not None else [], dtype=float), 1 - abs(d) / 12
        return y - a * np.r_[0.0, y[:-1]] if d >= 0 and len(y) else list(accumulate((1 - a) * y, lambda held, x: a * held + x))

    return pd.Series([one(y, d) for y, d in zip(samples, db, strict=True)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def stretched(samples: pd.Series, speed: pd.Series) -> pd.Series:
    """Resampled by linear interpolation: faster and higher from speed 1 on."""
    return pd.Series([np.interp(np.arange(0, len(y), s), np.arange(len(y)), y) if y is not None and len(y) and s > 0 else [] for y, s in zip(samples, speed, strict=True)])


def variant_plan(rows: DataFrame, key: str, ops: list[str], variants: int, seed: int) -> DataFrame:
    """(key, variant, op, seed): the augmentations of each sound, the operation by hash."""
    each = rows.select(key, F.explode(F.sequence(F.lit(1), F.lit(variants))).alias("variant"))
    pick = F.pmod(F.xxhash64(F.lit(seed), key, "variant"), F.lit(len(ops))) + 1
    return each.withColumn("op", F.element_at(F.array(*[F.lit(o) for o in ops]), pick.cast("int"))).withColumn("seed", F.lit(seed) + F.col("variant") - 1)


# orchestration


def analysed(rows: DataFrame, kernel: Callable[[dict], dict], keys: str, schema: str) -> DataFrame:
    """kernel(row) for each row, and the error instead where it fails; one bad file stops nothing.

    keys and schema: DDL of the columns that are kept and that the kernel makes.
    """
    kept = [c.split()[0] for c in keys.split(",")]
    made = [c.name for c in T.StructType.fromDDL(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                base = {k: row[k] for k in kept}
                try:
                    out.append(base | dict.fromkeys(made) | kernel(row) | {"error": None})
                except Exception as e:  # the row's error is its result
                    out.append(base | dict.fromkeys(made) | {"error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=[*kept, *made, "error"])

    return rows.mapInPandas(run, f"{keys}, {schema}, error string")


def once_a_clip(rows: DataFrame, clip: str, position: str) -> DataFrame:
    """The first row of each clip; rows without a clip have nothing to check."""
    first = F.min_by(F.struct(*rows.columns), position).alias("r")
    return rows.where(F.coalesce(F.col(clip), F.lit("")) != "").groupBy(F.col(clip).alias("_clip")).agg(first).select("r.*")
