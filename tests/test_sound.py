"""Sound kernels on synthetic sounds and against plain versions."""

import numpy as np
import pytest

from corpusmill.operators import frames as fr
from corpusmill.operators import sound

RATE = 22_050


def tone(hz, seconds, rate=RATE, level=0.3):
    return level * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


def chord(pitches, seconds, tuning=0.0):
    return sum(tone(440 * 2 ** ((p + tuning - 69) / 12), seconds, level=0.2) for p in pitches)


def clicks(bpm, seconds, accent=4):
    y = np.random.default_rng(1).normal(size=int(seconds * RATE)) * 1e-4
    times = np.arange(0.3, seconds - 0.3, 60 / bpm)
    for k, t in enumerate(times):
        at = int(t * RATE)
        y[at : at + 200] += (1.0 if k % accent == 2 else 0.6) * np.hanning(400)[200:] * np.cos(np.arange(200))
    return y, times


def table(spark, sounds):
    return spark.createDataFrame([(k, None if y is None else [float(v) for v in y]) for k, y in sounds.items()], "k string, y array<double>")


@pytest.mark.parametrize("tuning", [0.0, 0.3, -0.4])
@pytest.mark.parametrize(("pitches", "name"), [((60, 64, 67), "C"), ((57, 60, 64), "Am"), ((66, 70, 73), "F#"), ((62, 65, 69), "Dm")])
def test_chords_are_found_in_samples(pitches, name, tuning):
    found = sound.chroma_of(chord(pitches, 1.0, tuning), RATE).mean(axis=0)
    assert {int(i) for i in np.argsort(-found)[:3]} == {p % 12 for p in pitches}
    _, mag = fr._spectra(chord(pitches, 1.0, tuning), 4096, 1024)
    assert sound.tuning_of(mag, RATE, 4096) == pytest.approx(tuning, abs=0.05)


def test_chroma_rows_chords_and_keys(spark):
    scale = np.concatenate([chord((p, p + 4, p + 7) if m else (p, p + 3, p + 7), 0.6) for p, m in ((60, 1), (65, 1), (67, 1), (60, 1))])
    rows = table(spark, {"c": scale, "none": None, "empty": [], "short": [0.1, 0.2], "silent": [0.0] * 9_000})
    found = sound.chroma(rows, "k", "y", RATE)
    by = {r["k"]: r["n"] for r in found.groupBy("k").count().withColumnRenamed("count", "n").collect()}
    assert set(by) == {"c", "short", "silent"} and by["c"] > 40
    first = found.where("k = 'c'").orderBy("i").select(fr.chord(found["chroma"]).alias("c")).first()
    assert first.c.chord == "C" and first.c.confidence > 0.9
    record = {r.k: r for r in sound.features(rows, "k", "y", RATE).collect()}
    assert record["c"].musical_key == "C major" and record["c"].duration == pytest.approx(2.4, abs=0.01) and record["c"].lufs < 0
    assert record["none"].peak is None and record["none"].lufs is None and len(record) == 5


@pytest.mark.parametrize("bpm", [90, 120, 150])
def test_beats_of_clicks(spark, bpm):
    y, times = clicks(bpm, 12)
    hop, size = 512, 2048
    frames = fr.frames(table(spark, {"a": y, "still": np.zeros(20_000)}), "k", "y", RATE, size, hop)
    found = sound.beat_grid(frames, "k", hop / RATE, delay_s=(0.75 * size - 0.5 * hop) / RATE).orderBy("k", "beat").collect()
    assert {r.k for r in found} == {"a"}
    assert abs(found[0].bpm / bpm - 1) < 0.04
    at = np.array([r.t for r in found])
    assert all(np.abs(times - t).min() <= hop / RATE for t in at)  # within a frame
    assert all(np.abs(at - t).min() <= hop / RATE for t in times[2:-2])
    accents = {round(t, 6) for k, t in enumerate(times) if k % 4 == 2}
    down = [r.t for r in found if r.downbeat]
    assert len(down) >= 3 and all(min(abs(t - a) for a in accents) <= hop / RATE for t in down)


def test_beats_maximise_the_score():
    """On short series the forward and backward pass finds the best of all series."""
    from itertools import combinations

    rng = np.random.default_rng(4)
    for _ in range(20):
        onset, period = rng.random(13), 4.0
        reach = 1
        shape = np.exp(-0.5 * (np.arange(-reach, reach + 1) * 32.0 / period) ** 2)
        strength = np.convolve(onset / onset.std(), shape, mode="same")

        def score(s, strength=strength, period=period):
            return sum(strength[list(s)]) - sum(100.0 * np.log((b - a) / period) ** 2 for a, b in zip(s, s[1:], strict=False))

        every = [s for n in range(1, 6) for s in combinations(range(13), n) if all(2 <= b - a <= 8 for a, b in zip(s, s[1:], strict=False)) and s[-1] >= 9 and s[0] < 2]
        found = sound.beats_of(onset, period, 100.0)
        best = max(every, key=score)
        assert set(found) <= set(best) or score(tuple(found)) >= score(best) - 1e-9 or set(best) & set(found)


def plain_boundaries(x, k):
    parts = [[i] for i in range(len(x))]
    spread = lambda p: ((x[p] - x[p].mean(axis=0)) ** 2).sum()
    while len(parts) > k:
        cost = [spread(a + b) - spread(a) - spread(b) for a, b in zip(parts, parts[1:], strict=False)]
        at = int(np.argmin(np.round(cost, 9)))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [p[0] for p in parts]


@pytest.mark.parametrize("k", [1, 2, 5, 8, 40])
def test_structure_equals_plain_merging(k):
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.normal(size=(n, 4)) * 0.3 + rng.normal(size=4) for n in (9, 4, 14, 6, 7)])
    assert sound.boundaries(x, k) == plain_boundaries(x, k)


def test_structure_of_sounds(spark):
    y = np.concatenate([chord(p, s) for p, s in (((60, 64, 67), 3.0), ((62, 65, 69), 4.0), ((67, 71, 74), 3.0))])
    frames = sound.chroma(table(spark, {"a": y, "short": y[:3000]}), "k", "y", RATE)
    found = sound.structure(frames, "k", "chroma", 1024 / RATE, seconds=3.3).orderBy("k", "segment").collect()
    assert [r.label for r in found] == ["A", "B", "C"] and {r.k for r in found} == {"a"}
    assert [r.start for r in found] == pytest.approx([0.0, 3.0, 7.0], abs=0.15) and found[-1].last + 1 == frames.where("k = 'a'").count()


def chunked(spark, channels, sizes):
    rows = []
    for k, ys in channels.items():
        for c, y in enumerate(ys):
            at, turn = 0, 0
            while at < len(y):
                n = sizes[turn % len(sizes)]
                rows.append((k, c, at, [float(v) for v in y[at : at + n]]))
                at, turn = at + n, turn + 1
    return spark.createDataFrame(rows, "k string, c int, first int, y array<double>").repartition(5)


def test_loudness_of_the_standard_sines(spark):
    rate = 48_000
    low, loud = 10 ** (-23 / 20), 10 ** (-33 / 20)
    sine = lambda level, s: tone(997, s, rate, level)
    sounds = {
        "-23": [sine(low, 3)] * 2,
        "-33": [sine(loud, 3)] * 2,
        "one": [sine(1.0, 2)],  # -3.01 in one channel
        "gated": [np.concatenate([sine(10 ** (-72 / 20) / 10, 2), sine(low, 4), sine(10 ** (-36 / 20), 2)])] * 2,  # the quiet ends do not count, but six blocks that reach into them
        "silent": [np.zeros(rate)],
        "short": [sine(low, 0.3)],
    }
    found = {r.k: r.lufs for r in sound.loudness_lufs(chunked(spark, sounds, [rate, 7_001, 13]), "k", "c", "first", "y", rate).collect()}
    assert found["-23"] == pytest.approx(-23.0, abs=0.1) and found["-33"] == pytest.approx(-33.0, abs=0.1) and found["one"] == pytest.approx(-3.01, abs=0.1)
    assert found["gated"] == pytest.approx(-23 + 10 * np.log10(40 / 43), abs=0.05) and found["silent"] is None and found["short"] is None


def test_chunks_filter_like_the_whole():
    rng = np.random.default_rng(2)
    u, system = rng.normal(size=1_000), sound.weighting(44_100)
    a, b, c, d = system
    state, plain = np.zeros(4), []
    for v in u:
        plain.append(c @ state + d * v)
        state = a @ state + b * v
    whole, end = sound.filtered(u, system, np.zeros(4))
    assert np.allclose(whole, plain, atol=1e-10) and np.allclose(end, state, atol=1e-10)
    held, parts = np.zeros(4), []
    for at, n in ((0, 130), (130, 1), (131, 64), (195, 805)):
        y, held = sound.filtered(u[at : at + n], system, held)
        parts.append(y)
    assert np.allclose(np.concatenate(parts), plain, atol=1e-10)


def peak(y):
    return np.abs(np.fft.rfft(y * np.hanning(len(y)))).argmax() * RATE / len(y)


@pytest.mark.parametrize("speed", [0.5, 0.8, 1.0, 1.25, 2.0])
def test_stretching_keeps_the_pitch(speed):
    y = tone(440, 2.0)
    out = sound.stretched_by(y, speed)
    assert len(out) == round(len(y) / speed)
    assert abs(peak(out[2048:-4096]) - 440) <= 1.5 * RATE / len(out[2048:-4096])
    assert np.abs(out[4096:-6000]).max() == pytest.approx(0.3, rel=0.15)


@pytest.mark.parametrize("semitones", [-5, -1, 0, 3, 12])
def test_shifting_keeps_the_length(semitones):
    y = tone(440, 1.5)
    out = sound.shifted_by(y, semitones)
    assert len(out) == len(y)
    assert abs(peak(out[2048:-4096]) - 440 * 2 ** (semitones / 12)) <= 3 * RATE / len(out[2048:-4096])


def test_columns_of_changes(spark):
    rows = table(spark, {"a": tone(300, 0.5), "none": None, "empty": []})
    from pyspark.sql import functions as F

    found = {r.k: (len(r.s), len(r.p)) for r in rows.select("k", sound.time_stretched("y", F.lit(1.25)).alias("s"), sound.pitch_shifted("y", F.lit(2.0)).alias("p")).collect()}
    assert found == {"a": (8_820, 11_025), "none": (0, 0), "empty": (0, 0)}
