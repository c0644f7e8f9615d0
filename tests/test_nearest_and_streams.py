"""As-of joins, WAV files as rows, streams into tables."""

import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions.asof import asof_join
from corpusmill.sources import pcm
from corpusmill.streaming import upserts


@pytest.fixture(autouse=True)
def small_ranges(monkeypatch):
    """Several ranges also of the small tables here."""
    monkeypatch.setattr("corpusmill.functions.lineage.PER_RANGE", 150)


@pytest.mark.parametrize("how", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("equal_too", [True, False])
def test_asof_join(spark, how, equal_too):
    rng = random.Random(3)
    left = [(i, rng.choice(["hot"] * 8 + ["b", None]), rng.choice([None, *range(300)])) for i in range(800)]
    right = [(k, t, f"{k}{t}") for k in ("hot", "b", "c", None) for t in rng.sample(range(300), 90)]
    one = spark.createDataFrame(left, "id int, k string, t int").repartition(6)
    two = spark.createDataFrame(right, "key string, at int, v string").withColumnRenamed("key", "k").repartition(3)
    found = {r.id: r.v for r in asof_join(one, two, ["k"], "t", "at", ["v"], how, equal_too).collect()}
    assert len(found) == 800
    for i, k, t in left:
        own = [(a, v) for key, a, v in right if key == k and t is not None]
        back = max((x for x in own if x[0] < t or equal_too and x[0] == t), default=None)
        ahead = min((x for x in own if x[0] > t or equal_too and x[0] == t), default=None)
        want = {"backward": back, "forward": ahead, "nearest": min((x for x in (back, ahead) if x), key=lambda x: (abs(x[0] - t), x[0]), default=None)}[how]
        assert found[i] == (want and want[1]), (i, k, t)


def test_asof_join_of_nothing(spark):
    none = spark.createDataFrame([], "k string, t int, v int")
    some = spark.createDataFrame([("a", 1, 2)], "k string, t int, v int")
    other = some.select("k", F.col("t").alias("u"), F.col("v").alias("w"))
    assert asof_join(none, other, ["k"], "t", "u", ["w"]).count() == 0
    assert asof_join(some, other.limit(0), ["k"], "t", "u", ["w"]).first().w is None
    assert asof_join(some, other, [], "t", "u", ["w"]).first().w == 2


def write_wav(path, data, channels, width, rate=8_000):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(data)


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_samples_equal_those_of_the_wave_module(spark, tmp_path, width):
    raw = np.random.default_rng(width).integers(0, 256, 3 * 1_001 * width, dtype=np.uint8).tobytes()
    write_wav(tmp_path / "a.wav", raw, 3, width)
    pcm.register(spark)
    rows = spark.read.format("pcm").option("bytes", 1_000).option("frames", 40).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() > 3  # a file of several partitions
    found = np.concatenate([r.samples for r in rows.orderBy("first").collect()])
    with wave.open(str(tmp_path / "a.wav")) as w:
        data = w.readframes(w.getnframes())
    if width == 1:
        want = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    else:
        want = np.array([int.from_bytes(data[i : i + width], "little", signed=True) for i in range(0, len(data), width)]) / 2.0 ** (8 * width - 1)
    assert np.array_equal(found, want)
    per = {r.channel: r.n for r in pcm.by_channel(rows).groupBy("channel").agg(F.sum(F.size("y")).alias("n")).collect()}
    assert per == {0: 1_001, 1: 1_001, 2: 1_001}
    assert list(pcm.by_channel(rows).where("channel = 1").orderBy("first").first().y[:5]) == list(want[1:15:3])


def test_broken_files_are_error_rows(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    write_wav(tmp_path / "deep" / "ok.WAV", b"\x01\x02" * 10, 1, 2)
    write_wav(tmp_path / "empty.wav", b"", 1, 2)
    (tmp_path / "bad.wav").write_bytes(b"no sound at all")
    (tmp_path / "nothing.wav").write_bytes(b"")
    (tmp_path / "head.wav").write_bytes(b"RIFF\x00\x00\x00\x00WAVEfmt \x10\x00")
    (tmp_path / "long.wav").write_bytes(b"RIFF\x00\x00\x00\x00WAVEjunk" + (9_000).to_bytes(4, "little") + b"x" * 9_000 + (tmp_path / "deep" / "ok.WAV").read_bytes()[12:])
    (tmp_path / "note.txt").write_text("x")
    pcm.register(spark)
    found = {r.path.split("/")[-1]: r for r in spark.read.format("pcm").load(str(tmp_path)).collect()}
    assert set(found) == {"ok.WAV", "bad.wav", "nothing.wav", "head.wav", "long.wav"}
    assert found["bad.wav"].error == "no WAV file" and found["nothing.wav"].error and found["head.wav"].error
    assert found["ok.WAV"].samples == found["long.wav"].samples and len(found["ok.WAV"].samples) == 10 and found["ok.WAV"].rate == 8_000
    assert spark.read.format("pcm").load(str(tmp_path / "deep")).count() == 1
    assert spark.read.format("pcm").load(str(tmp_path / "missing")).count() == 0


def test_round_trip_of_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, [((i * 7 + j) % 65_536 - 32_768) / 32_768 for j in range(500 * i)]) for i in range(1, 5)], "id int, y array<double>")
    pcm.written(rows, "id", "y", 16_000, str(tmp_path / "out"))
    pcm.register(spark)
    back = spark.read.format("pcm").option("bytes", 800).load(str(tmp_path / "out"))
    whole = back.groupBy("path").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "samples"))), lambda s: s["samples"])).alias("y"))
    assert {int(r.path.split("/")[-1][:-4]): r.y for r in whole.collect()} == {r.id: r.y for r in rows.collect()}


SCHEMA = "k string, t int, v string"


def log_files(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(f"{folder}/in")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{folder}/in")


def table(spark, folder, schema):
    return {r.k: (r.t, r.v) for r in upserts.latest(spark, f"{folder}/out", schema, ["k"], "t").collect()}


def test_replayed_batches_change_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}"
    batches = [[("a", 1, "a1"), ("b", 1, "b1"), ("a", 2, "a2")], [("a", 3, "a3"), ("c", 1, "c1")], [("b", 0, "late"), ("c", 5, "c5")]]
    for rows in batches:
        log_files(spark, folder, [rows])
    schema = stream(spark, folder).schema
    query = upserts.upsert_stream(stream(spark, folder), f"{folder}/out", ["k"], "t", fail_at=1)
    with pytest.raises(Exception, match="stopped behind batch 1"):  # dies between the write and the commit of batch 1
        query.awaitTermination()
    assert {p.name for p in (tmp_path / "out" / "rows").iterdir()} == {"batch=0", "batch=1"}
    upserts.upsert_stream(stream(spark, folder), f"{folder}/out", ["k"], "t").awaitTermination()  # batch 1 is replayed
    want = {"a": (3, "a3"), "b": (1, "b1"), "c": (5, "c5")}
    assert table(spark, folder, schema) == want
    n = spark.read.parquet(f"{folder}/out/rows").count()
    upserts.upsert_stream(stream(spark, folder), f"{folder}/out", ["k"], "t").awaitTermination()  # nothing is new
    assert spark.read.parquet(f"{folder}/out/rows").count() == n == 6
    upserts.compacted(spark, f"{folder}/out", schema, ["k"], "t", 1)
    assert table(spark, folder, schema) == want and not (tmp_path / "out" / "rows" / "batch=0").exists()
    log_files(spark, folder, [[("a", 9, "a9")]])
    upserts.upsert_stream(stream(spark, folder), f"{folder}/out", ["k"], "t").awaitTermination()
    assert table(spark, folder, schema) == want | {"a": (9, "a9")}


def test_rerun_of_what_has_not_passed(spark):
    known = spark.createDataFrame([("a", True), ("b", False), ("b", True), ("c", False)], "k string, ok boolean")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "k string, n int")
    assert {r.k for r in upserts.with_passed_kept(new, known, ["k"], "ok").collect()} == {"c", "d"}
