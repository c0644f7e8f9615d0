"""Recipes, sheets, checkpoints and sound frames against hand-computed cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import frames as fr
from corpusmill.operators import studio as st
from corpusmill.operators import vectors
from corpusmill.plans import registry

RATE = 8000


@pytest.fixture(scope="module")
def sounds(spark):
    t = np.arange(2 * RATE) / RATE
    tone = 0.5 * np.sin(2 * np.pi * 440 * t)
    rows = [("tone", tone), ("loud-quiet", np.where(t < 1, tone, tone / 100)), ("silence", np.zeros(RATE)), ("empty", np.array([])), ("short", tone[:10]), ("gone", None)]
    return spark.createDataFrame([(k, y.tolist() if y is not None else None) for k, y in rows], "k string, y array<double>")


def test_variants(spark):
    df = spark.createDataFrame([("dark melodic trap, piano and 808, calm",), ("plain",), ("",), (None,)], "p string")
    found = [r.v for r in df.select(st.variants(F.col("p"), ["calm", "fast"], 9).alias("v")).collect()]
    assert found[0][:2] == ["dark melodic trap, piano and 808, calm", "piano and 808, calm, dark melodic trap"]
    assert found[0][3:] == ["dark melodic trap, piano and 808, fast", "dark melodic trap piano 808 calm"]
    assert found[1] == ["plain"] and found[2] == [""] and not found[3]


def test_text_diff(spark):
    df = spark.createDataFrame([("a\nb", "a\nc"), ("x", "x"), (None, "x")], "a string, b string")
    found = [r.d for r in df.select(st.text_diff("a", "b", F.lit("one"), F.lit("two")).alias("d")).collect()]
    assert found[0] == ["--- one", "+++ two", "@@ -1,2 +1,2 @@", " a", "-b", "+c"]
    assert found[1] == [] and found[2][-1] == "+x"


def test_sheet(spark):
    section = "struct<role:string,bars:int,flow:string,cadence:string,artist:string,rhyme:string,ad_libs:array<string>,lines:array<string>>"
    song = (("Ann", "dark", "roads", 140.4, "A minor", "straight", 3, [("hook", 8, "steady", "fast", None, None, ["ay", "yo"], ["over the moon"]), (None, None, None, None, "Bo", "AA", None, None)]),)
    df = spark.createDataFrame([song, ((None,) * 8,)], f"s struct<artist:string,mood:string,topic:string,bpm:double,key:string,swing:string,seed:int,sections:array<{section}>>")
    one, two = (r.x for r in df.select(st.sheet(F.col("s")).alias("x")).collect())
    assert one.split("\n") == ["# Ann — dark / roads", "**140 BPM · A minor · swing straight · seed 3**", "", "## [HOOK] 8 bars · steady @ fast · Ann", "- over the moon  _(4 syll · rhyme free)_", "> ad-libs: (ay), (yo)", "", "## [?] ? bars ·  @  · Bo"]
    assert two.startswith("# ? — ")


def test_lookup_prefers_ids(spark):
    artists = spark.createDataFrame([("bo", "Ann", ["x"]), ("ann", "Bo", ["X ", "lil"])], "id string, name string, aliases array<string>")
    rows = spark.createDataFrame([(" ANN",), ("Bo",), ("x",), ("Lil",), ("who",), (None,)], "q string")
    found = {r.q: r.entry and r.entry.id for r in st.lookup(rows, "q", artists, F.array("id"), F.array("name"), F.col("aliases")).collect()}
    assert found == {" ANN": "ann", "Bo": "bo", "x": "ann", "Lil": "ann", "who": None, None: None}


def test_beat_context_defaults(spark):
    kind = "struct<key:struct<key:string>,beat_grid:struct<tempo:double>,swing:struct<feel:string>,structure:struct<segments:array<struct<role:string,label:string,energy:double>>>>"
    df = spark.createDataFrame([((None, None, None, None),), ((("C",), (90.0,), ("swung",), ([("hook", None, 0.4), (None, "odd", None)],)),)], f"a {kind}")
    one, two = (r.x for r in df.select(st.beat_context(F.col("a")).alias("x")).collect())
    assert (one.bpm, one.key, one.swing, one.energy, [s.bars for s in one.structure]) == (140.0, "A minor", "straight", 0.5, [4, 16, 8, 16, 8, 4])
    assert (two.bpm, two.energy, [(s.role, s.bars) for s in two.structure]) == (90.0, 0.2, [("hook", 8), ("verse", 16)])


def test_checkpoints_from_files(spark, tmp_path):
    for name, text in (("a/config.json", '{"model_type": "m", "hidden_size": 8, "num_hidden_layers": 2}'), ("a/w.safetensors", "x" * 1000), ("b/config.json", "{"), ("b/notes.txt", "n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", "length", F.col("modificationTime").alias("modified"))
    configs = spark.read.text(str(tmp_path / "*/config.json"), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    found = {r["name"]: (r.weight_files, r.size_mb, r.model_type, r.n_params) for r in st.checkpoint_registry(files, configs).collect()}
    assert found == {"a": (1, 0.0, "m", 512), "b": (0, 0.0, None, None)}


def test_kept_moments_give_the_same_distance(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    one, two = rows.where("label < 5"), rows.where("label >= 5")
    st.reference_moments(one, "embedding").write.parquet(f"{tmp_path}/kept")
    far = st.distance_from_moments(spark.read.parquet(f"{tmp_path}/kept"), two, "embedding").first().frechet
    assert far == vectors.two_sample(one, two, "embedding").first().frechet
    assert st.distance_from_moments(spark.read.parquet(f"{tmp_path}/kept"), two.limit(1), "embedding").first().frechet is None


def test_recipes_are_the_same_on_every_run(spark):
    query = registry.queries()["surprise_recipes"]
    folder = "/root/testdata/sf0.001"
    assert sorted(query(spark, folder).collect()) == sorted(query(spark, folder).collect())
    with pytest.raises(ValueError, match="no query"):
        registry.run("nothing", spark, folder)


def test_frames_of_a_tone(sounds):
    frame = fr.frames(sounds, "k", "y", RATE)
    shape = {r.k: r for r in fr.spectral_shape(frame, "k").collect()}
    assert set(shape) == {"tone", "loud-quiet", "silence", "short"}
    assert abs(shape["tone"].centroid - 440) < 25 and shape["tone"].crest_factor == pytest.approx(1.41, abs=0.1)
    level = {r.k: r for r in fr.loudness(frame, "k").collect()}
    assert level["tone"].peak_db == pytest.approx(-6.02, abs=0.01)
    assert level["loud-quiet"].dynamic_range_db == pytest.approx(40, abs=1)
    assert level["silence"].dynamic_range_db == 0
    top = fr.peaks(fr.mean_spectra(sounds, "k", "y", RATE), "k", 1).where("k = 'tone'").first()
    assert abs(top.hz - 440) < RATE / 2048


def test_pitch_and_tempo(spark, sounds):
    found = {r.k: r.f for r in sounds.select("k", fr.pitch("y", F.lit(float(RATE))).alias("f")).collect()}
    assert abs(found["tone"] - 440) < 15 and all(found[k] is None for k in ("silence", "empty", "short", "gone"))
    beats = [1.0 if i % 25 == 0 else 0.0 for i in range(400)]  # every half second
    df = spark.createDataFrame([(beats,), ([1.0] * 100,), ([],), (None,)], "x array<double>")
    assert [r.b for r in df.select(fr.tempo_of("x", F.lit(0.02)).alias("b")).collect()] == [120.0, None, None, None]
    frame = spark.createDataFrame([("a", i, i * 0.02, x) for i, x in enumerate(beats)], "k string, i int, t double, flux double")
    tempos = fr.local_tempos(frame, "k", 0.02)
    assert [(r.t, r.bpm) for r in tempos.orderBy("t").collect()] == [(0.0, 120.0), (2.0, 120.0), (4.0, 120.0)]
    assert fr.tempo_drift(tempos, "k", F.lit(8.0)).first().verdict == "steady"


def test_speakers(spark):
    rows = [("a", i, 0.5 if i not in (5, 6) else 0.0, 100.0 if i < 5 else 300.0) for i in range(12)] + [("b", i, 0.0, 1.0) for i in range(9)] + [("c", i, float(i == 3), 1.0) for i in range(9)]
    found = fr.speakers(spark.createDataFrame(rows, "k string, i int, rms double, centroid double"), "k", 0.02, 4).orderBy("k", "first").collect()
    assert [(r.k, r["first"], r["last"], r.speaker) for r in found] == [("a", 0, 4, 0), ("a", 7, 11, 1), ("c", 0, 8, 0)]


def test_chords(spark):
    one = lambda *on: [1.0 if i in on else 0.0 for i in range(12)]
    df = spark.createDataFrame([(one(0, 4, 7),), (one(9, 0, 4),), (one(),), ([1.0],), (None,)], "c array<double>")
    assert [r.x and tuple(r.x) for r in df.select(fr.chord(F.col("c")).alias("x")).collect()] == [("C", 1.0), ("Am", 1.0), None, None, None]


def test_swing(spark):
    df = spark.createDataFrame([("a", [1.0, 0.4, 1.0, 0.4, 1.0], [0.0, 1.0, 2.0], 60.0), ("b", [0.0] * 5, [0.0, 1.0, 2.0], 60.0), ("c", [1.0], [0.0], 60.0)], "k string, o array<double>, b array<double>, bpm double")
    assert [tuple(r) for r in fr.swing(df, "k", "o", "b", "bpm", 0.5).orderBy("k").collect()] == [("a", 0.4, "straight"), ("b", None, "unknown"), ("c", None, "unknown")]


def test_mix_and_augment(spark):
    stems = spark.createDataFrame([("s", "drums", [1.0, 1.0]), ("s", "vocals", [2.0, 2.0, 2.0]), ("s", "bass", None)], "k string, stem string, y array<double>")
    assert fr.mixed(stems, "k", "stem", "y", {"drums": 0.5}).first().y == [2.5, 2.5, 2.0]
    assert fr.mixed(stems, "k", "stem", "y", {}, but=("vocals",)).first().y == [1.0, 1.0, 0.0]
    y = spark.createDataFrame([([1.0, 0.5, -0.5],), ([],), (None,)], "y array<double>")
    loud = y.select(fr.amplified(F.col("y"), F.lit(20.0)).alias("y")).first().y
    assert loud == pytest.approx([10.0, 5.0, -5.0])
    bright, dark = y.select(fr.tilted("y", F.lit(6.0)), fr.tilted("y", F.lit(-6.0))).first()
    assert bright == [1.0, 0.0, -0.75] and dark == [0.5, 0.5, 0.0]
    noisy = [r[0] for r in y.select(fr.with_noise(F.col("y"), 0.1, F.lit(3))).collect()]
    assert noisy[0] != [1.0, 0.5, -0.5] and noisy[0] == y.select(fr.with_noise(F.col("y"), 0.1, F.lit(3))).first()[0] and noisy[1:] == [[], None]
    hum = spark.range(1).select(fr.with_noise(F.array_repeat(F.lit(0.0), 4000), 1e6, F.lit(1)).alias("y")).first().y
    assert abs(np.mean(hum)) < 0.1 and np.std(hum) == pytest.approx(1.0, abs=0.1)
    assert y.select(fr.stretched("y", F.lit(2.0))).first()[0] == [1.0, -0.5]


def test_one_bad_row_stops_nothing(spark):
    def kernel(row):
        return {"half": 10 / row["x"]}

    found = fr.analysed(spark.createDataFrame([("a", 2.0), ("b", 0.0)], "k string, x double"), kernel, "k string", "half double").orderBy("k").collect()
    assert (found[0].half, found[0].error) == (5.0, None)
    assert found[1].half is None and found[1].error.startswith("ZeroDivisionError")


def test_clips_are_checked_once(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("", 3), (None, 4)], "clip string, n int")
    assert [tuple(r) for r in fr.once_a_clip(rows, "clip", "n").collect()] == [("a", 1)]


def test_section_lines(spark):
    """Rhymes by scheme, templates near the target and not repeated within three lines, the same on every run."""
    from corpusmill.plans import registry

    folder = "/root/testdata/sf0.001"
    rows = registry.queries()["section_lines"](spark, folder).collect()
    songs = {}
    for r in sorted(rows, key=lambda r: r.i):
        songs.setdefault(r.c_custkey, []).append(r)
    for k, song in songs.items():
        assert [r.i for r in song] == list(range(16))
        group = {0: lambda i: i // 2, 1: lambda i: i % 2, 2: lambda i: 0}[k % 3]
        banks = {}
        for r in song:
            assert banks.setdefault(group(r.i), r.bank) == r.bank
            assert "{" not in r.line and r.line[0].isupper() and r.line.startswith("Listen, ") == (k % 2 == 0 and r.i == 0)
        ends = [r.line.split(" ")[-1] for r in song]
        assert all(a != b for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if group(i) == group(i + 1))
        if len({r.template for r in song}) >= 4:
            assert all(len({x.template for x in song[i : i + 4]}) == 4 for i in range(12))
    again = registry.queries()["section_lines"](spark, folder).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows)) and len({tuple(r.line for r in s) for s in songs.values()}) > len(songs) / 3


def test_lines_of_a_song_share_its_turns(spark):
    """Templates are drawn once a song, not once a line, and songs of one file are dealt to all tasks."""
    asked = spark.createDataFrame([(k, 16, 8, "AABB", None) for k in range(40)], "k int, bars int, target int, scheme string, opener string").coalesce(1)
    templates = spark.createDataFrame([(f"a {w} to the {{R}}",) for w in ("way", "day", "play", "stay", "say")], "template string")
    banks = spark.createDataFrame([("ight", ["night", "light", "fight", "sight"])], "bank string, words array<string>")
    made = st.verses(asked, "k", templates, banks)
    plan = made._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    assert sum(line.count("sort_array(") for line in plan[at:]) == 1
    assert made.rdd.getNumPartitions() > 1 and made.count() == 640


def test_catalogs_are_mined_from_lines(spark):
    lines = spark.createDataFrame([("Walk into the night",)] * 3 + [("a new light!",), ("we fight",), ("the sight",), ("all the way",), ("walk into the day",), ("too long a line to be a template for any verse of ours",), ("{odd} braces here",), (None,), ("",), ("42",)], "line string")
    banks = {r.bank: r.words for r in st.mined_banks(lines, "line", least=4).collect()}
    assert banks == {"ight": ["night", "fight", "light", "sight"]}
    templates = [r.template for r in st.mined_templates(lines, "line", n=2).collect()]
    assert templates == ["walk into the {R}", "a new {R}"]
