"""Measures of sample arrays and frames: column expressions, or Arrow batches of numpy work."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.columns import rounded

MEASURES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("peak", "rms", "rms_db", "dc", "clipping_ratio", "silence_ratio", "snr_db", "clicks")])


def measures(y: np.ndarray, frame: int = 512) -> tuple:
    """Peak, RMS, offset, clipping, silence, SNR of frame levels, clicks; empty sound measures nothing."""
    if not len(y):
        return (None,) * 8
    rms = float(np.sqrt((y * y).mean()))
    n = max(1, len(y) // frame)
    level = np.sqrt((y[: n * frame].reshape(n, -1) ** 2).mean(axis=1)) if len(y) >= frame else np.array([rms])
    low, high = np.percentile(level, [10, 90])
    step = np.abs(np.diff(y))
    usual = float(np.median(step)) if len(step) else 0.0
    return (
        float(np.abs(y).max()),
        rms,
        20 * float(np.log10(max(rms, 1e-10))),
        float(y.mean()),
        float((np.abs(y) >= 0.999).mean()),
        float((level < 0.01).mean()),
        20 * float(np.log10(high / low)) if low > 0 else None,
        float((step > 20 * usual).sum()) if usual > 0 else 0.0,
    )


@F.pandas_udf(MEASURES)
def _measured(samples: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measures(np.asarray(s if s is not None else [], dtype=np.float64)) for s in samples], columns=MEASURES.names)


def measured(samples: Column | str) -> Column:
    """A struct of measures of an array of samples in [-1, 1]."""
    return _measured(samples)


#: Krumhansl-Kessler key profiles (fixed values).
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


#: The 24 keys' profiles, shifted to their tonics and standardised: one row a key, major ones first.
_PROFILES = np.array([[p[(j - i) % 12] for j in range(12)] for p in (MAJOR, MINOR) for i in range(12)])
_PROFILES = (_PROFILES - _PROFILES.mean(axis=1, keepdims=True)) / _PROFILES.std(axis=1, keepdims=True)


def key_shares(chromas: np.ndarray) -> np.ndarray:
    """Softmax shares of the 24 keys for each row of 12-bin chromas, by their correlations with the profiles.

    All rows and keys are one matrix product; a flat chroma correlates with none.
    """
    spread = chromas.std(axis=1, keepdims=True)
    unit = np.divide(chromas - chromas.mean(axis=1, keepdims=True), spread, out=np.zeros_like(chromas), where=spread > 0)
    e = np.exp(6 * (unit @ _PROFILES.T / 12 - 1))
    return e / e.sum(axis=1, keepdims=True)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("share", T.DoubleType())])))
def keys(chroma: pd.Series) -> pd.Series:
    """The three likeliest keys of a column of 12-bin chromas, first the likeliest; none for anything else."""
    from corpusmill.functions.columns import NOTES

    names = [f"{n} {mode}" for mode in ("major", "minor") for n in NOTES]
    real = chroma.map(lambda c: c is not None and len(c) == 12)
    out = pd.Series([[]] * len(chroma), index=chroma.index, dtype=object)
    if real.any():
        shares = key_shares(np.stack(chroma[real].to_numpy()).astype(float))
        best = np.argsort(-shares, axis=1, kind="stable")[:, :3]
        out[real] = pd.Series([[{"key": names[j], "share": float(row[j])} for j in by] for row, by in zip(shares, best, strict=True)], index=chroma.index[real], dtype=object)
    return out


def stereo(left: Column | str, right: Column | str) -> Column:
    """A struct of two channels' arrays: width (the share of side energy), phase correlation, mono_compatible."""
    both = F.arrays_zip(F.col(left).alias("l") if isinstance(left, str) else left.alias("l"), F.col(right).alias("r") if isinstance(right, str) else right.alias("r"))
    mean = lambda f: F.aggregate(both, F.lit(0.0), lambda a, x: a + f(x["l"].cast("double"), x["r"].cast("double"))) / F.size(both)
    l, r = mean(lambda l, r: l), mean(lambda l, r: r)
    ll, rr, lr = mean(lambda l, r: l * l), mean(lambda l, r: r * r), mean(lambda l, r: l * r)
    mid, side = (ll + rr + 2 * lr) / 4, (ll + rr - 2 * lr) / 4
    phase = (lr - l * r) / (F.sqrt(F.greatest(F.lit(0.0), ll - l * l)) * F.sqrt(F.greatest(F.lit(0.0), rr - r * r)) + 1e-12)
    return F.when(F.size(both) > 0, F.struct(rounded(side / (mid + side + 1e-12)).alias("width"), rounded(phase).alias("phase_correlation"), (phase > 0).alias("mono_compatible")))


#: What a count of clicks ends at (fixed value).
MOST_CLICKS = 1_000
ARTIFACTS = T.StructType(
    [T.StructField("clicks", T.LongType()), T.StructField("clipping_ratio", T.DoubleType()), T.StructField("dc_offset", T.DoubleType()), T.StructField("dropouts", T.LongType()), T.StructField("clean", T.BooleanType())]
)


def artifacts_of(y: np.ndarray, hop: int = 512, most_clicks: int = MOST_CLICKS) -> tuple:
    """Clicks (``most_clicks`` at most), clipping, offset, dropouts, and whether none of them is there.

    A dropout is a run of 2 to 20 frames, of four hops each around a hop's
    start, more than 50 dB below the loudest one. Under four samples there is
    nothing to find.
    """
    if len(y) < 4:
        return 0, 0.0, 0.0, 0, True
    step = np.abs(np.diff(y))
    clicks = min(most_clicks, int((step > 20 * (np.median(step) + 1e-12)).sum()))
    clipping, offset = float((np.abs(y) >= 0.999).mean()), float(abs(y.mean()))
    padded = np.pad(y, 2 * hop)
    level = np.sqrt((np.lib.stride_tricks.sliding_window_view(padded, 4 * hop)[::hop] ** 2).mean(axis=1))
    silent = 20 * np.log10(np.maximum(level, 1e-5) / max(level.max(), 1e-5)) < -50
    edge = np.flatnonzero(np.diff(silent, prepend=False, append=False))
    runs = edge[1::2] - edge[0::2]
    dropouts = int(((runs >= 2) & (runs <= 20)).sum())
    return clicks, round(clipping, 5), round(offset, 5), dropouts, clicks == 0 and clipping < 0.001 and offset < 0.01 and dropouts == 0


def artifacts(samples: Column | str, hop: int = 512) -> Column:
    """A struct of an array of samples' artifacts."""

    @F.pandas_udf(ARTIFACTS)
    def found(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([artifacts_of(np.asarray(s if s is not None else [], dtype=np.float64), hop) for s in column], columns=ARTIFACTS.names)

    return found(samples)


def mean_shares(frames: DataFrame, bands: str) -> DataFrame:
    """(band, share): each frame's magnitudes as shares of their sum, averaged over all frames; silent frames count as zeros."""
    total = F.aggregate(bands, F.lit(0.0), lambda a, x: a + x.cast("double"))
    each = frames.select(F.when(total == 0, 1.0).otherwise(total).alias("total"), F.posexplode(bands).alias("band", "x"))
    return each.groupBy("band").agg(F.avg(F.col("x").cast("double") / F.col("total")).alias("share"))


def spectral_divergence(one: DataFrame, two: DataFrame, bands: str, eps: float = 1e-12) -> DataFrame:
    """One row: the symmetric divergence of two sets' mean band shares."""
    a, b = mean_shares(one, bands).select("band", F.col("share").alias("p")), mean_shares(two, bands).select("band", F.col("share").alias("q"))
    p, q = F.col("p") + eps, F.col("q") + eps
    return a.join(b, "band").agg(rounded(F.sum(p * F.log(p / q) + q * F.log(q / p)) / 2, 6).alias("divergence"))


def mean_chroma(frames: DataFrame, key: str, chroma: str) -> DataFrame:
    """(key, fingerprint): the mean of each key's 12-bin chroma frames, the fingerprint that shift_similarity compares."""
    by = frames.select(key, F.posexplode(chroma).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return by.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("fingerprint"))  # 12 a key
