"""Sound from its samples: chroma, beats, structure, loudness, changes of length and pitch.

Functions on arrays work on one sound or chunk; those on tables let Spark deal
sounds, or chunks of long ones, to tasks.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.columns import rounded
from corpusmill.operators.frames import _spectra, downbeat_phase

# chroma


def tuning_of(magnitudes: np.ndarray, rate: int, size: int, lowest: float = 100.0, highest: float = 5_000.0) -> float:
    """How far the spectral peaks are from equal temperament at 440 Hz, in semitones from -0.5 to 0.5.

    Peaks of the mean spectrum are placed between bins by a parabola; their
    distances to the next semitone are averaged as angles, by magnitude.
    """
    mean = magnitudes.mean(axis=0)
    at = np.flatnonzero((mean[1:-1] > mean[:-2]) & (mean[1:-1] >= mean[2:])) + 1
    a, b, c = (np.log(mean[at + k] + 1e-12) for k in (-1, 0, 1))
    bend = a - 2 * b + c
    hz = (at + np.where(bend < 0, 0.5 * (a - c) / np.where(bend < 0, bend, 1), 0.0)) * rate / size
    on = (hz >= lowest) & (hz <= highest) & (mean[at] > 0.01 * mean.max(initial=0.0))
    if not on.any():
        return 0.0
    off = 12 * np.log2(hz[on] / 440)
    turn = (mean[at][on] * np.exp(2j * np.pi * off)).sum()
    return float(np.angle(turn) / (2 * np.pi))


def pitch_classes(rate: int, size: int, tuning: float = 0.0, lowest: float = 100.0, highest: float = 5_000.0) -> np.ndarray:
    """bin x class: to which of the twelve pitch classes, C first, a frequency belongs; it is shared by the two next to it."""
    hz = np.fft.rfftfreq(size, 1 / rate)
    out = np.zeros((len(hz), 12))
    on = np.flatnonzero((hz >= lowest) & (hz <= highest))
    pitch = 69 + 12 * np.log2(hz[on] / 440) - tuning
    low = np.floor(pitch)
    for step in (0, 1):
        np.add.at(out, (on, (low + step).astype(int) % 12), 1 - np.abs(pitch - low - step))
    return out


def chroma_of(y: np.ndarray, rate: int, size: int = 4096, hop: int = 1024) -> np.ndarray:
    """frame x pitch class, each frame's largest 1; a silent frame has zeros."""
    if not len(y):
        return np.zeros((0, 12))
    _, mag = _spectra(y, size, hop)
    out = mag**2 @ pitch_classes(rate, size, tuning_of(mag, rate, size))
    most = out.max(axis=1, keepdims=True)
    return np.divide(out, most, out=np.zeros_like(out), where=most > 1e-12)


def chroma(rows: DataFrame, key: str, samples: str, rate: int, size: int = 4096, hop: int = 1024) -> DataFrame:
    """(key, i, t, chroma): a row a frame."""
    kind = T.ArrayType(T.ArrayType(T.DoubleType()))

    @F.pandas_udf(kind)
    def found(column: pd.Series) -> pd.Series:
        return pd.Series([chroma_of(np.asarray(y if y is not None else [], dtype=float), rate, size, hop).tolist() for y in column])

    each = rows.select(key, F.posexplode(found(samples)).alias("i", "chroma"))
    return each.select(key, "i", (F.col("i") * (hop / rate)).alias("t"), "chroma")


# beats


def tempo_in(onset: np.ndarray, step: float, usual: float = 120.0, low: float = 40.0, high: float = 240.0) -> float | None:
    """BPM at which the rises repeat most, octaves from ``usual`` counting less; between two steps by a parabola.

    None where nothing repeats, or the series is shorter than two periods.
    """
    x = np.asarray(onset, dtype=float)
    first, last = max(1, int(60 / high / step)), min(len(x) // 2, int(np.ceil(60 / low / step)))
    if first + 1 >= last or x.std() < 1e-12:
        return None
    x = x - x.mean()
    size = 1 << (2 * len(x) - 1).bit_length()
    again = np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2)[: last + 2] / np.arange(len(x), len(x) - last - 2, -1)
    lags = np.arange(first, last + 1)
    weighed = again[lags] * np.exp(-0.5 * np.log2(60 / (lags * step) / usual) ** 2)
    at = int(weighed.argmax())
    lag = float(lags[at])
    a, b, c = again[lags[at] - 1], again[lags[at]], again[lags[at] + 1]
    if b > 0 and a - 2 * b + c < 0:
        lag += float(np.clip(0.5 * (a - c) / (a - 2 * b + c), -0.5, 0.5))
    return 60 / (lag * step) if b > 0 else None


@F.pandas_udf(T.DoubleType())
def tempo(flux: pd.Series, hop_s: pd.Series) -> pd.Series:
    """``tempo_in`` of a column of series."""
    return pd.Series([tempo_in(x if x is not None else [], s) for x, s in zip(flux, hop_s, strict=True)], dtype="float64")


def beats_of(onset: np.ndarray, period: float, tightness: float = 100.0) -> np.ndarray:
    """Frames of the beats: the series of rises that is strongest and most even.

    Forward, each frame takes the best frame between half a period and two
    periods before it as the beat before; being off the period costs the
    square of its log. Backward, the series is read from the best end. Beats
    at either end that are weaker than half the usual are left out.
    """
    n = len(onset)
    if n < 2 or onset.std() < 1e-12 or period < 1:
        return np.zeros(0, dtype=int)
    reach = max(1, int(round(period / 4)))
    shape = np.exp(-0.5 * (np.arange(-reach, reach + 1) * 32.0 / period) ** 2)
    strength = np.convolve(onset / onset.std(), shape, mode="same")[:n]
    lags = np.arange(max(1, int(round(period / 2))), int(round(2 * period)) + 1)
    cost = tightness * np.log(lags / period) ** 2
    total, before = strength.copy(), np.full(n, -1)
    started = False
    for t in range(n):
        prior = t - lags
        ok = prior >= 0
        if ok.any():
            through = total[prior[ok]] - cost[ok]
            best = int(through.argmax())
            if started or strength[t] >= 0.01 * strength.max():
                total[t] = strength[t] + through[best]
                before[t] = prior[ok][best]
                started = True
    at = max(0, n - int(round(period))) + int(total[max(0, n - int(round(period))) :].argmax())
    found = []
    while at >= 0:
        found.append(at)
        at = before[at]
    beats = np.array(found[::-1])
    strong = strength[beats] >= 0.5 * np.sqrt((strength[beats] ** 2).mean())
    if not strong.any():
        return np.zeros(0, dtype=int)
    first, last = np.flatnonzero(strong)[[0, -1]]
    return beats[first : last + 1]


def beat_grid(frame: DataFrame, key: str, hop_s: float, bpm: str | None = None, delay_s: float = 0.0, per_bar: int = 4) -> DataFrame:
    """(key, beat, i, t, strength, bpm, downbeat): the beats of each sound of (i, flux) frames.

    A sound is a task's; its tempo is given or that at which the rises repeat.
    delay_s: how long after a frame's start a rise shows in it. The downbeat
    is the place in the bar whose beats rise most. Sounds without a tempo, or
    without rises, have no beats.
    """
    kind = dict(frame.dtypes)[key]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "flux"))), lambda f: f["flux"])
    given = [F.first(bpm).alias("bpm")] if bpm else []
    by = frame.groupBy(key).agg(ordered.alias("flux"), *given)  # a sound's own frames
    by = by if bpm else by.withColumn("bpm", tempo("flux", F.lit(hop_s)))

    def track(batches):
        for pdf in batches:
            out = []
            for k, flux, speed in zip(pdf[key], pdf["flux"], pdf["bpm"], strict=True):
                flux = np.asarray(flux, dtype=float)
                for beat, i in enumerate(beats_of(flux, 60.0 / speed / hop_s) if speed and speed == speed else ()):
                    out.append((k, beat, int(i), float(i * hop_s + delay_s), float(flux[i]), float(speed)))
            yield pd.DataFrame(out, columns=[key, "beat", "i", "t", "strength", "bpm"])

    beats = by.select(key, "flux", "bpm").mapInPandas(track, f"{key} {kind}, beat int, i int, t double, strength double, bpm double")
    phase = downbeat_phase(beats, key, "beat", "strength", per_bar)
    return beats.join(phase, key).select(*beats.columns, (F.col("beat") % per_bar == F.col("downbeat_phase")).alias("downbeat"))


# structure


def boundaries(features: np.ndarray, k: int) -> list[int]:
    """Starts of k stretches of rows: neighbours are merged again and again, those whose merger adds least to the squares within.

    The next merger is the top of a heap, in which mergers that are out of
    date are passed over; of equal ones the earliest goes first.
    """
    n = len(features)
    size, mean = [1] * n, [np.asarray(f, dtype=float) for f in features]
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    version = [0] * n

    def added(a: int, b: int) -> float:
        gap = mean[a] - mean[b]
        return float(size[a] * size[b] / (size[a] + size[b]) * (gap @ gap))

    heap = [(added(a, a + 1), a, a + 1, 0, 0) for a in range(n - 1)]
    heapq.heapify(heap)
    left = n
    while left > k and heap:
        _, a, b, va, vb = heapq.heappop(heap)
        if version[a] != va or version[b] != vb or after[a] != b:
            continue
        mean[a] = (size[a] * mean[a] + size[b] * mean[b]) / (size[a] + size[b])
        size[a] += size[b]
        after[a] = after[b]
        if after[b] >= 0:
            before[after[b]] = a
        version[a] += 1
        version[b] = -1
        left -= 1
        for x, y in ((before[a], a), (a, after[a])):
            if x >= 0 and y >= 0:
                heapq.heappush(heap, (added(x, y), x, y, version[x], version[y]))
    return [i for i in range(n) if version[i] >= 0]


def structure(frames: DataFrame, key: str, feature: str, hop_s: float, seconds: float = 10.0, least: int = 2, most: int = 8) -> DataFrame:
    """(key, segment, label, first, last, start, end): each sound's stretches of frames that are alike.

    About one for every ``seconds``, ``least`` to ``most``; a sound of under
    four frames has no structure and no row. frames: (key, i, feature).
    """
    kind = dict(frames.dtypes)[key]

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        n = len(pdf)
        if n < 4:
            return pd.DataFrame(columns=[key, "segment", "label", "first", "last", "start", "end"])
        k = min(n, max(least, min(most, round(n * hop_s / seconds))))
        starts = boundaries(np.stack(pdf["f"].to_numpy()), k)
        ends = [*starts[1:], n]
        rows = [(pdf[key].iloc[0], s, chr(65 + s % 26), a, b - 1, round(a * hop_s, 3), round(b * hop_s, 3)) for s, (a, b) in enumerate(zip(starts, ends, strict=True))]
        return pd.DataFrame(rows, columns=[key, "segment", "label", "first", "last", "start", "end"])

    schema = f"{key} {kind}, segment int, label string, first int, last int, start double, end double"
    return frames.select(key, "i", F.col(feature).alias("f")).groupBy(key).applyInPandas(cut, schema)


# loudness


@lru_cache(maxsize=8)
def weighting(rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The broadcast standard's weighting as a linear system of four states: (A, B, C, D).

    A shelf and a high pass, by the standard's filters carried over to the
    rate (fixed values: gain, frequency and quality of either).
    """
    gain, shelf_hz, shelf_q = 3.999843853973347, 1681.974450955533, 0.7071752369554196
    high_hz, high_q = 38.13547087602444, 0.5003270373238773

    def system(b: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        b, a = b / a[0], a / a[0]
        return np.array([[-a[1], 1.0], [-a[2], 0.0]]), np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]]), np.array([1.0, 0.0]), float(b[0])

    k, v = np.tan(np.pi * shelf_hz / rate), 10 ** (gain / 20)
    w = v**0.4996667741545416
    shelf = system(np.array([v + w * k / shelf_q + k * k, 2 * (k * k - v), v - w * k / shelf_q + k * k]), np.array([1 + k / shelf_q + k * k, 2 * (k * k - 1), 1 - k / shelf_q + k * k]))
    k = np.tan(np.pi * high_hz / rate)
    below = 1 + k / high_q + k * k
    high = system(np.array([1.0, -2.0, 1.0]), np.array([1.0, 2 * (k * k - 1) / below, (1 - k / high_q + k * k) / below]))
    (a1, b1, c1, d1), (a2, b2, c2, d2) = shelf, high
    a = np.block([[a1, np.zeros((2, 2))], [np.outer(b2, c1), a2]])
    return a, np.concatenate([b1, b2 * d1]), np.concatenate([d2 * c1, c2]), d1 * d2


def filtered(u: np.ndarray, system: tuple, state: np.ndarray, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(output, state behind it) of a linear system, a block of samples at a time: only the states go one after the other."""
    a, b, c, d = system
    powers = [np.eye(len(b))]
    for _ in range(block):
        powers.append(a @ powers[-1])
    response = np.array([d, *(c @ p @ b for p in powers[: block - 1])])
    here = np.array([[response[i - j] if i >= j else 0.0 for j in range(block)] for i in range(block)])
    seen = np.array([c @ p for p in powers[:block]])
    driven = np.array([p @ b for p in powers[:block][::-1]])
    whole = len(u) // block
    x = u[: whole * block].reshape(whole, block)
    pushes, states = x @ driven, np.empty((whole, len(b)))
    for i in range(whole):
        states[i] = state
        state = powers[block] @ state + pushes[i]
    out = [(x @ here.T + states @ seen.T).ravel()]
    rest = u[whole * block :]
    if len(rest):
        out.append(here[: len(rest), : len(rest)] @ rest + seen[: len(rest)] @ state)
        for v in rest:
            state = a @ state + b * v
    return np.concatenate(out), state


def loudness_lufs(chunks: DataFrame, key: str, channel: str, first: str, samples: str, rate: int) -> DataFrame:
    """(key, lufs): integrated loudness by the broadcast standard; null where all is below its gate.

    chunks: rows of a channel's samples from sample ``first`` on, without gaps,
    of any length, so that a sound of hours is many rows. What a chunk leaves
    in the filter is found from silence first; the states at its start follow
    from those of the chunks before it, a handful of numbers each; then every
    chunk is filtered for good. Powers are added up by tenths of a second over
    chunks and channels. Blocks of four tenths below -70, then those 10 below
    the mean of the others, do not count.
    """
    kind, part = (dict(chunks.dtypes)[c] for c in (key, channel))
    tenth = rate // 10
    rows = chunks.select(key, channel, F.col(first).cast("long").alias("first"), F.col(samples).alias("y"))

    def left(batches):
        system = weighting(rate)
        for pdf in batches:
            ends = [filtered(np.asarray(y, dtype=float), system, np.zeros(4))[1].tolist() for y in pdf["y"]]
            yield pd.DataFrame({key: pdf[key], channel: pdf[channel], "first": pdf["first"], "n": [len(y) for y in pdf["y"]], "push": ends})

    def carried(pdf: pd.DataFrame) -> pd.DataFrame:
        a, state, out = weighting(rate)[0], np.zeros(4), []
        pdf = pdf.sort_values("first")
        for n, push in zip(pdf["n"], pdf["push"], strict=True):
            out.append(state.tolist())
            state = np.linalg.matrix_power(a, int(n)) @ state + np.asarray(push)
        return pd.DataFrame({key: pdf[key], channel: pdf[channel], "first": pdf["first"], "state": out})

    pushes = rows.mapInPandas(left, f"{key} {kind}, {channel} {part}, first long, n long, push array<double>")
    states = pushes.groupBy(key, channel).applyInPandas(carried, f"{key} {kind}, {channel} {part}, first long, state array<double>")  # six numbers a chunk

    def powers(batches):
        system = weighting(rate)
        for pdf in batches:
            out = []
            for k, start, y, state in zip(pdf[key], pdf["first"], pdf["y"], pdf["state"], strict=True):
                z = filtered(np.asarray(y, dtype=float), system, np.asarray(state))[0]
                at = (start + np.arange(len(z))) // tenth
                for hop in np.unique(at):
                    on = z[at == hop]
                    out.append((k, int(hop), float((on * on).sum()), len(on)))
            yield pd.DataFrame(out, columns=[key, "hop", "power", "n"])

    each = rows.join(states, [key, channel, "first"]).mapInPandas(powers, f"{key} {kind}, hop long, power double, n long")
    hops = each.groupBy(key, "hop").agg(F.sum("power").alias("power"), F.sum("n").alias("n"))
    channels = rows.groupBy(key).agg(F.count_distinct(channel).alias("of"))
    four = Window.partitionBy(key).orderBy("hop").rowsBetween(0, 3)  # ten rows a second of sound
    blocks = hops.join(channels, key).withColumns({"z": F.sum("power").over(four) / (4 * tenth), "full": F.sum("n").over(four) == F.col("of") * 4 * tenth})
    level = lambda z: -0.691 + 10 * F.log10(z)
    loud = blocks.where("full and z > 0").where(level(F.col("z")) > -70)
    gate = loud.groupBy(key).agg((level(F.avg("z")) - 10).alias("gate"))
    heard = loud.join(gate, key).where(level(F.col("z")) > F.col("gate")).groupBy(key).agg(rounded(level(F.avg("z")), 2).alias("lufs"))
    return channels.select(key).join(heard, key, "left")


# length and pitch


def stretched_by(y: np.ndarray, speed: float, size: int = 2048, hop: int = 512) -> np.ndarray:
    """The sound ``speed`` times as fast at the same pitch, by a phase vocoder.

    Spectra are read at steps of ``speed`` frames, magnitudes between two
    frames; each bin's phase goes on by what it advanced between them; the
    frames are overlapped and added, and evened out by the windows' squares.
    """
    if not len(y) or speed <= 0:
        return np.zeros(0)
    window = np.hanning(size + 1)[:-1]
    padded = np.pad(y, (size // 2, size + hop))
    cut = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]
    spectra = np.fft.rfft(cut * window, axis=1)
    steps = np.arange(0, len(spectra) - 1, speed)
    low = steps.astype(int)
    share = (steps - low)[:, None]
    magnitude = (1 - share) * np.abs(spectra[low]) + share * np.abs(spectra[low + 1])
    usual = 2 * np.pi * hop * np.arange(spectra.shape[1]) / size
    gone = np.angle(spectra[low + 1]) - np.angle(spectra[low]) - usual
    gone = gone - 2 * np.pi * np.round(gone / (2 * np.pi)) + usual
    phase = np.angle(spectra[0]) + np.concatenate([np.zeros((1, gone.shape[1])), np.cumsum(gone[:-1], axis=0)])
    frames = np.fft.irfft(magnitude * np.exp(1j * phase), size, axis=1) * window
    out, weight = np.zeros(size + hop * (len(frames) - 1)), np.zeros(size + hop * (len(frames) - 1))
    for i, f in enumerate(frames):
        out[i * hop : i * hop + size] += f
        weight[i * hop : i * hop + size] += window**2
    out = out / np.maximum(weight, 1e-3)
    n = int(round(len(y) / speed))
    return np.pad(out[size // 2 : size // 2 + n], (0, max(0, n - len(out[size // 2 : size // 2 + n]))))


def shifted_by(y: np.ndarray, semitones: float, size: int = 2048, hop: int = 512) -> np.ndarray:
    """The sound higher by so many semitones, as long as before: stretched, then read at another rate."""
    if not len(y):
        return np.zeros(0)
    factor = 2.0 ** (semitones / 12)
    longer = stretched_by(y, 1 / factor, size, hop)
    return np.interp(np.arange(len(y)) * factor, np.arange(len(longer)), longer)


def _by_row(change):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def changed(samples: pd.Series, amount: pd.Series) -> pd.Series:
        return pd.Series([change(np.asarray(y if y is not None else [], dtype=float), a).tolist() for y, a in zip(samples, amount, strict=True)])

    return changed


#: Columns of samples and a speed; of samples and semitones.
time_stretched, pitch_shifted = _by_row(stretched_by), _by_row(shifted_by)


# features


def features(rows: DataFrame, key: str, samples: str, rate: int, chunk: int = 1 << 16, size: int = 2048, hop: int = 512) -> DataFrame:
    """The feature record of each sound: measures of its samples, loudness, tempo, key with its confidence.

    Null and empty sounds have a record of nulls.
    """
    from corpusmill.operators.frames import frames
    from corpusmill.operators.signals import keys, measured

    n = F.size(F.coalesce(samples, F.array().cast("array<double>")))
    cuts = rows.where(n > 0).select(key, F.explode(F.sequence(F.lit(0), n - 1, F.lit(chunk))).alias("first"), F.col(samples).alias("y"))
    cuts = cuts.select(key, F.lit(0).alias("channel"), "first", F.slice("y", F.col("first") + 1, F.lit(chunk)).alias("y"))
    lufs = loudness_lufs(cuts, key, "channel", "first", "y", rate)
    flux = frames(rows, key, samples, rate, size, hop).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "flux"))), lambda f: f["flux"]).alias("flux"))
    bpm = flux.select(key, rounded(tempo("flux", F.lit(hop / rate)), 2).alias("bpm"))
    mean = chroma(rows, key, samples, rate, 2 * size, 2 * hop).select(key, F.posexplode("chroma").alias("c", "x")).groupBy(key, "c").agg(F.avg("x").alias("x"))
    mean = mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "x"))), lambda s: s["x"]).alias("chroma"))  # twelve a sound
    best = mean.select(key, F.get(keys("chroma"), F.lit(0)).alias("_best")).select(key, F.col("_best.key").alias("musical_key"), rounded("_best.share").alias("key_share"))
    own = rows.select(key, (n / rate).alias("duration"), measured(samples).alias("_measures")).select(key, rounded("duration", 3).alias("duration"), "_measures.*")
    return own.join(lufs, key, "left").join(bpm, key, "left").join(best, key, "left")
