"""What goes by ranges, parts and sketches gives the rows of the plain way."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import lineage, quantiles, tails
from corpusmill.operators import corpus, evaluation, extras, vectors
from corpusmill.sources import readers


@pytest.fixture(autouse=True)
def small_ranges(monkeypatch):
    """Several ranges also of the small tables here."""
    monkeypatch.setattr("corpusmill.functions.lineage.PER_RANGE", 150)


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 1.0, 1.0, 2.0, 3.0]), rng.choice([True, False, None])) for i in range(2_000)]
    return spark.createDataFrame(rows, "k string, i int, v double, flag boolean").repartition(7)


def test_runs_equal_one_window(spark, events):
    w = Window.partitionBy("k").orderBy("i")
    change = F.when(F.row_number().over(w) == 1, 1).when(F.col("v").eqNullSafe(F.lag("v").over(w)), 0).otherwise(1)
    plain = events.withColumn("c", change).withColumn("run", F.sum("c").over(w)).drop("c")
    found = lineage.with_runs(events, "k", "i", "v").where("k is not null")
    assert sorted(found.collect(), key=str) == sorted(plain.where("k is not null").select(*found.columns).collect(), key=str)


def test_runs_of_flags(events):
    found = {(r.k, r.first, r.last, r.n) for r in corpus.runs_of(events.where("k is not null"), "k", "i", F.col("flag"), 2, 5).collect()}
    want = set()
    for k in "ab":
        rows = sorted(((r.i, r.flag) for r in events.where(F.col("k") == k).collect()))
        at = 0
        while at < len(rows):
            end = at
            while end + 1 < len(rows) and rows[end + 1][1] == rows[at][1]:
                end += 1
            if rows[at][1] and 2 <= end - at + 1 <= 5:
                want.add((k, rows[at][0], rows[end][0], end - at + 1))
            at = end + 1
    assert found == want and len(want) > 20


def test_running_best_equals_a_loop(events):
    some = events.where("v is not null and k is not null")
    found = {(r.k, r.step): (r.best, r.since_best, r.stop) for r in evaluation.running_best(some, "k", "i", "v").collect()}
    for k in "ab":
        best, at = float("-inf"), 0
        for step, r in enumerate(some.where(F.col("k") == k).orderBy("i").collect(), 1):
            if r.v > best:
                best, at = r.v, step
            assert found[k, step] == (best, step - at, step - at >= 3)


def test_first_rows_of_groups(events):
    found = lineage.first_of(events.where("v is not null"), "k", [F.desc("v"), "i"], 4, "i").select("k", "i", "nth")
    plain = events.where("v is not null").withColumn("nth", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"), "i"))).where("nth <= 4").select("k", "i", "nth")
    assert sorted(found.collect(), key=str) == sorted(plain.collect(), key=str)


def test_balanced_samples_and_strata(events):
    rows = events.where("k is not null")
    found = corpus.balanced(rows, "k", "i", 100, 3).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in found} == {"a": 50, "b": 50}
    split = corpus.ratio_split(rows, "i", (0.8, 0.1, 0.1), 3, F.col("k")).groupBy("stratum", "split").count().collect()
    n = {r.k: r["count"] for r in rows.groupBy("k").count().collect()}
    assert {(r.stratum, r.split): r["count"] for r in split if r.split != "train"} == {(k, s): round(n[k] * 0.1) for k in n for s in ("val", "test")}


def test_penalties_and_removable_files(spark):
    files = spark.createDataFrame([(f"f{i}", "same" if i < 500 else f"own{i}") for i in range(600)], "path string, content string")
    found = {r.path: r.penalty for r in corpus.penalties(files, F.col("content"), "path").collect()}
    assert len(found) == 500 and found["f0"] == 0.0 and sum(found.values()) == 499 * 0.25
    rows = [(f"b{i}", "backup", i, 10) for i in range(200)] + [("t1", "temp", 5, 10), ("t2", "temp", 500, 10), ("b199", "backup", 3, 7)]
    table = spark.createDataFrame(rows, "path string, kind string, mtime int, size int")
    gone = {r.path: r.why for r in extras.removable(table, 3, F.lit(100)).collect()}
    assert {p for p, w in gone.items() if w == "old backup"} == {f"b{i}" for i in range(197)} | {"b199"} and gone["t1"] == "stale" and "t2" not in gone


@pytest.mark.parametrize("values", [
    list(range(3_000)), [1.0] * 3_000, [0.0] * 2_000 + [5.0] * 1_000, [float(x) for x in np.random.default_rng(1).normal(size=4_000)],
    [float(x) for x in np.random.default_rng(2).pareto(0.5, 4_000)], [1.0, None, 2.0], [7.0],
])
def test_quantiles_are_exact(spark, values):
    rows = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").repartition(5)
    shares = [0.0, 0.1, 0.333, 0.5, 0.9, 0.999, 1.0]
    want = np.quantile([v for v in values if v is not None], shares)
    assert np.allclose(quantiles.quantiles(rows, "v", shares, few=40), want, rtol=1e-12)
    assert np.allclose(quantiles.quantiles(rows, "v", shares), want, rtol=1e-12)


def test_quantiles_of_nothing(spark):
    assert quantiles.quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == [None]


@pytest.mark.parametrize(("text", "want"), [
    ('{\n  "rows": [\n{"a": 1}\n  ],\n  "a": 7\n}\n', [7]),
    ('[{"a": 1}, 3, "x", null,\n {"a": 2}]', [1, 2]),
    ('{"a": 1}\n\nnot json\n[1]\n{"a": 2} \n{"a": 3', [1, 2]),
    ('{"a": 1}, {"a": 2}', []),
    ('{"a": 1} x\n{"a": 2}', [2]),
    ("", []), ("  \n", []), ("null", []), ('{"b": 5}', [None]), ('  {"a": 4}  ', [4]), ('{"a": 1}\r\n{"a": 2}\r\n', [1, 2]),
])
def test_tolerant_json(spark, tmp_path, text, want):
    (tmp_path / "m.jsonl").write_bytes(text.encode())
    assert [r.a for r in readers.tolerant_json(spark, str(tmp_path / "m.jsonl"), "a int").collect()] == want


def test_gaussian_divergence(spark):
    one, zero = np.array([1.0]), np.array([0.0])
    assert tails.gaussian_kl(zero, np.eye(1), one, np.eye(1)) == pytest.approx(1.0)
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=(50, 3)) @ np.diag([1, 2, 0.5]) + 0.3
    rows = lambda m: spark.createDataFrame([([float(c) for c in v],) for v in m], "v array<double>")
    (found,) = vectors.two_sample(rows(x), rows(y), "v").collect()
    c1, c2 = (np.cov(m.T) + 1e-6 * np.eye(3) for m in (x, y))
    d = x.mean(axis=0) - y.mean(axis=0)
    directed = lambda a, b: np.trace(np.linalg.inv(b) @ a) + d @ np.linalg.inv(b) @ d - 3
    assert found.kl == pytest.approx((directed(c1, c2) + directed(c2, c1)) / 2, abs=2e-6)


def test_song_files_are_read_by_what_they_are(spark, tmp_path):
    (tmp_path / "Ann - First.txt").write_text("one\n\n two \n")
    (tmp_path / "list.json").write_text('{"data": [{"artist_name": "Bob", "track_name": "B", "text": "x\\ny"}, 3, {"title": "no text"}]}')
    (tmp_path / "rows.jsonl").write_text('{"artist": "", "song": "C", "lyric": "z"}\nbroken\n')
    (tmp_path / "songs.csv").write_text('title,artist,lyrics\nD,Dee,"a\nb"\n')
    (tmp_path / "lines.csv").write_text("artist,song,lyric\nEve,E,l1\nEve,E,l2\nEve,F,m1\n")
    (tmp_path / "note.pdf").write_bytes(b"%")
    found = {(r.artist, r.title): r.lines for r in readers.imported_songs(spark, str(tmp_path)).collect()}
    assert found == {("Ann", "First"): ["one", "two"], ("Bob", "B"): ["x", "y"], ("unknown", "C"): ["z"], ("Dee", "D"): ["a", "b"], ("Eve", "E"): ["l1", "l2"], ("Eve", "F"): ["m1"]}


def test_artists_songs_are_split(spark):
    songs = spark.createDataFrame([("big", i) for i in range(45)] + [("ten", i) for i in range(10)] + [("few", i) for i in range(9)], "artist string, song int")
    found = corpus.artist_split(songs, "artist", "song", 0.1, 0.05, 3).groupBy("artist", "split").count().collect()
    assert {(r.artist, r.split): r["count"] for r in found} == {("big", "test"): 2, ("big", "val"): 4, ("big", "train"): 39, ("ten", "test"): 1, ("ten", "val"): 1, ("ten", "train"): 8, ("few", "train"): 9}


def test_line_files_grow_in_number(spark, monkeypatch):
    """A CSV file of lines is read by one task, so that their number goes with the session's partitions."""
    from corpusmill.plans import files

    paths, real = [], readers.rap_csv
    monkeypatch.setattr("corpusmill.sources.readers.rap_csv", lambda s, path: paths.append(path) or real(s, path))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "20")
        files.line_songs(spark, "/root/testdata/sf0.001")
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(spark.read.text(paths[0]).inputFiles()) > 8
