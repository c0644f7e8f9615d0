"""Hand-computed cases."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import columns as c
from corpusmill.functions import tails
from corpusmill.operators import catalog, corpus, datasets, evaluation, extras, signals, statistics, studio, text, vectors
from corpusmill.sources import readers, sinks
from corpusmill.streaming import logs

EVAL = "event_id long, checkpoint string, prompt string, section string, genre string, bpm_target double, clap_score double, deviation double, status string, seed_no int"


def ev(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], EVAL)


def one(df):
    return df.first().asDict()


def value(spark, column, **given):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]) if given else spark.range(1)
    return df.select(column.alias("v")).first().v


def test_leaderboard_order_and_ratings(spark):
    rows = ev(spark, [("b", "p1", "s", "g", 90.0, 0.8, 0.01, "ok", 0), ("a", "p2", "s", "g", 90.0, 0.3, 0.15, "rejected", 0), ("", "p3", "s", "g", 90.0, None, None, "ok", 0)])
    ratings = spark.createDataFrame([("p1", 5.0)], "prompt string, rating double")
    got = {r.checkpoint: r for r in evaluation.leaderboard(rows, ratings).collect()}
    assert got["b"].rank == 1 and got["b"].mean_human_rating == 5.0
    assert got["(unknown)"].mean_clap is None and got["(unknown)"].score == 0.4


def test_seed_aggregate_rejects(spark):
    rows = ev(spark, [("a", "p", "s", "g", 90.0, 0.3, 0.25, "ok", i) for i in range(3)])
    got = one(evaluation.seed_aggregate(rows, 0.5, 0.10))
    assert got["status"] == "rejected" and got["notes"] == "clap; deviation"


@pytest.mark.parametrize(("base", "cand", "blocked"), [((0.5, 0.1), (0.3, 0.2), True), ((0.5, 0.1), (0.49, 0.11), False)])
def test_regression_gate(spark, base, cand, blocked):
    rows = ev(spark, [(k, "p", "s", "g", 90.0, v[0], v[1], "ok", i) for i in range(3) for k, v in (("a", base), (" b ", cand))])
    assert any(r.blocking for r in evaluation.regression_gate(rows, "a", "b").collect()) == blocked


def test_missing_candidate_fails_the_gate(spark):
    rows = ev(spark, [("a", "p", "s", "g", 90.0, 0.5, 0.1, "ok", 0)])
    assert all(r.blocking for r in evaluation.regression_gate(rows, "a", "none").collect())


def test_section_interaction_needs_variation(spark):
    rows = ev(spark, [("a", "p", s, "g", 90.0 + i, 0.5, 0.1, "ok", i) for s in ("x", "y") for i in range(6)])
    got = evaluation.section_interaction(rows).collect()
    assert len(got) == 2 and all(r.bpm_dev_corr is None and r.ok_rate == 1.0 for r in got)


def test_z_scores_are_centred(spark):
    rows = ev(spark, [("a", "p", "x", "g", 90.0, 0.2 + 0.1 * i, 0.1, "ok", i) for i in range(6)] + [("a", "p", "y", "g", 90.0, 0.5, 0.1, "ok", 0)])
    got = evaluation.z_scores(rows).collect()
    assert abs(sum(r.clap_z for r in got if r.section == "x")) < 1e-9
    assert [r.clap_z for r in got if r.section == "y"] == [None]


def test_octave_fold(spark):
    f = evaluation.fold_tempo(F.lit(156.0), F.lit(78.0))
    got = value(spark, f)
    assert (got.factor, got.deviation) == (0.5, 0.0)


def test_multi_value_cells(spark):
    assert value(spark, c.multi(F.lit("a|b;c"))) == ["a", "b;c"]
    assert value(spark, c.multi(F.lit("a;b,c"))) == ["a", "b,c"]
    assert value(spark, c.multi(F.lit(" , "))) == []
    assert value(spark, c.multi(F.lit(None).cast("string"))) == []
    assert value(spark, c.any_separator(F.lit("a|b;c, d"))) == ["a", "b", "c", "d"]


@pytest.mark.parametrize(("raw", "slug"), [("data/My Song!!.wav", "My_Song"), ("...", "track"), ("a b.c.mp3", "a_b.c")])
def test_slugs(spark, raw, slug):
    assert value(spark, c.slug(F.lit(raw))) == slug


def test_dashed(spark):
    assert [value(spark, c.dashed(F.lit(x))) for x in ("Jay Z", "Fetty Wap", "--")] == ["jay-z", "fetty-wap", ""]


def test_noise_lines(spark):
    lines = ["[Intro]", "produced by X", "x", "see https://a.b", "a real line"]
    assert [value(spark, c.clean_line(F.lit(x))) for x in lines] == [None, None, None, None, "a real line"]


@pytest.mark.parametrize(("line", "n"), [("hello world", 3), ("make it", 2), ("", 0), ("rhythm's", 1), ("idea", 2)])
def test_syllables(spark, line, n):
    assert value(spark, c.syllables(F.lit(line))) == n


def test_keys(spark):
    assert value(spark, c.camelot(F.lit("C major"))) == 8 and value(spark, c.camelot(F.lit("A minor"))) == 8
    assert value(spark, c.camelot_distance(F.lit("C major"), F.lit("F# major"))) == 6
    assert value(spark, c.transposed(F.lit("Bb minor"), 3)) == "C# minor"
    assert value(spark, c.pitch_class(F.lit("?"))) is None


def test_out_of_domain(spark):
    t = spark.createDataFrame([("a", 200.0, "trap", ""), ("b", 100.0, "ambient", ""), ("c", 100.0, "trap", "dark"), ("d", 160.0, "trap", "")], "source_id string, bpm double, genre string, mood string")
    assert {r.source_id for r in corpus.out_of_domain(t, 70, 160, ["ambient"]).collect()} == {"a", "b"}


def test_histogram_shows_empty_bins(spark):
    t = spark.createDataFrame([(70.0,), (400.0,), (None,), (399.0,)], "bpm double")
    got = {r.label: r.n for r in corpus.tempo_histogram(t).collect()}
    assert len(got) == 12 and got["70-80"] == 1 and got["200-400"] == 1 and sum(got.values()) == 2


def test_version_diff(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, sha256 string")
    b = spark.createDataFrame([("b", "2"), ("c", "1")], "path string, sha256 string")
    assert {tuple(r) for r in corpus.version_diff(a, b).collect()} == {("a", "removed"), ("b", "changed"), ("c", "added")}


def test_majority_agreement(spark):
    votes = spark.createDataFrame([("i", "X", "r1"), ("i", "X", "r2"), ("i", "Y", "r3")], "item string, choice string, rater string")
    assert one(corpus.majority_agreement(votes, "item", "choice", "rater")) == {"n_items": 1, "n_ratings": 3, "agreement": 0.6667, "n_raters": 3}


def test_agreement_of_a_with_itself(spark):
    both = spark.createDataFrame([(["x", "y"], ["y", "x"]), (["x"], ["x"]), ([], [])], "a array<string>, b array<string>")
    got = one(corpus.agreement(both, "mood"))
    assert got["exact_agreement"] == 1.0 and got["rows"] == 3


@pytest.mark.parametrize(("duration", "want"), [(30.0, [(0.0, 10.0), (10.0, 20.0), (20.0, 30.0)]), (15.0, [(0.0, 10.0)])])
def test_fixed_windows(spark, duration, want):
    got = corpus.fixed_windows(spark.createDataFrame([("k", duration)], "k string, duration double"), "k", 10.0, 0.0, 8.0)
    assert sorted((r.start, r.end) for r in got.collect()) == want


def test_fixed_windows_overlap(spark):
    got = corpus.fixed_windows(spark.createDataFrame([("k", 30.0)], "k string, duration double"), "k", 10.0, 2.0, 1.0)
    assert sorted((r.start, r.end) for r in got.collect()) == [(0, 10), (8, 18), (16, 26), (24, 30)]


def test_boundary_windows(spark):
    rows = spark.createDataFrame([("k", i, 2.0 * i, 11.0) for i in range(6)], "k string, pos int, at double, duration double")
    got = datasets.boundary_windows(rows, "k", 2)
    assert sorted((r.start, r.end) for r in got.collect()) == [(0, 4), (4, 8), (8, 11)]


def test_ratio_split(spark):
    groups = spark.createDataFrame([(f"s{i}",) for i in range(10)], "g string")
    got = corpus.ratio_split(groups, "g", (0.6, 0.2, 0.2), 1).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 6, "val": 2, "test": 2}


def test_folds(spark):
    got = corpus.folds(spark.createDataFrame([(f"s{i}",) for i in range(10)], "g string"), "g", 5, 1).collect()
    assert sorted(r.fold for r in got) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_balanced_sample(spark):
    rows = spark.createDataFrame([(i, "a" if i < 90 else "b") for i in range(100)], "id long, label string")
    got = corpus.balanced(rows, "label", "id", 10, 1).collect()
    assert len(got) == 10 and sum(r.label == "b" for r in got) >= 4


def test_greedy_clusters_are_not_components(spark):
    """a~b and b~c but not a~c: b is claimed, c stands for itself."""
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (4, 6), (5, 6)], "a long, b long")
    assert {tuple(r) for r in vectors.greedy_clusters(edges).collect()} == {(1, 2), (4, 5), (4, 6)}


def test_vector_pairs(spark):
    v = spark.createDataFrame([(1, [1.0, 0, 0]), (2, [1.0, 0, 0]), (3, [0.0, 1, 0]), (4, [0.0, 0, 0])], "id long, v array<double>") if False else spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, v array<double>"
    )
    assert [(r.a, r.b) for r in vectors.pairs_above(v, "id", "v", 0.99).collect()] == [(1, 2)]
    assert one(vectors.two_sample(v, v, "v"))["frechet"] == pytest.approx(0, abs=1e-4)


def test_tails():
    assert tails.sign_test(5, 5) == 1.0 and tails.sign_test(10, 0) == pytest.approx(2 / 1024)
    assert tails.sign_test(0, 0) == 1.0
    assert tails.wilcoxon_p(4, 10, 0) is None and tails.wilcoxon_p(5, 15, 0) == pytest.approx(2 / 32)
    assert tails.wilcoxon_p(60, 60 * 61 / 4, 0) == pytest.approx(1.0)
    assert tails.ks_p(0.0, 50, 50) == 1.0 and tails.ks_p(0.9, 50, 50) < 1e-6
    eye = np.eye(3)
    assert tails.frechet(np.zeros(3), eye, np.ones(3), eye) == pytest.approx(3.0)
    assert tails.gaussian_kl(np.zeros(2), np.eye(2), np.zeros(2), np.eye(2)) == pytest.approx(0.0)


def test_signed_ranks_share_ties(spark):
    d = spark.createDataFrame([(1.0,), (-1.0,), (2.0,), (0.0,), (3.0,)], "d double")
    assert one(statistics.signed_ranks(d)) == {"n": 4, "w_plus": 8.5, "w_minus": 1.5, "ties": 6.0}


def test_pairs_take_the_last_of_b(spark):
    a = spark.createDataFrame([("p", 1.0, 0.1, 1), ("p", 1.0, 0.2, 2), (None, 1.0, 0.3, 3)], "k string, t double, m double, at int")
    b = spark.createDataFrame([("p", 1.0, 0.5, 1), ("p", 1.0, 0.6, 2), (None, 1.0, 0.7, 3)], "k string, t double, m double, at int")
    got = sorted((r.m_a, r.m_b) for r in statistics.pairs(a, b, ["k", "t"], ["m"], "at").collect())
    assert got == [(0.1, 0.6), (0.2, 0.6), (0.3, 0.7)]


@pytest.mark.parametrize(("ref", "cur", "low", "high"), [("aab", "aab", -1e-9, 1e-9), ("aaa", "bbb", 0.5, 99)])
def test_category_psi(spark, ref, cur, low, high):
    rows = spark.createDataFrame([(x, False) for x in ref] + [(x, True) for x in cur], "v string, cur boolean")
    assert low <= one(statistics.category_psi(rows, "v", F.col("cur")))["psi"] <= high


def test_bootstrap_holds_the_mean(spark):
    rows = spark.createDataFrame([(i, "a", float(i % 7)) for i in range(600)] + [(600, "b", 1.0), (601, None, 2.0)], "i long, g string, v double")
    got = {r.g: r for r in statistics.bootstrap(rows, "g", "i", "v").collect()}
    assert got["a"].low < got["a"].mean < got["a"].high and got["b"].low is None and got[None].n == 1
    again = {r.g: r for r in statistics.bootstrap(rows.repartition(7), "g", "i", "v").collect()}
    assert again == got  # draws depend on rows, not on partitions
    v, rng = np.arange(600) % 7, np.random.default_rng(1)
    means = [rng.choice(v, 600).mean() for _ in range(2000)]
    assert (got["a"].low, got["a"].high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), abs=0.02)


def test_difference_interval(spark):
    """The columns are resampled by themselves, as two samples are, not as pairs."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(0, 1, 500), rng.normal(0.5, 2, 500)
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i long, a double, b double")
    got = statistics.difference_interval(rows, "i", "a", "b").first()
    gaps = [rng.choice(y, 500).mean() - rng.choice(x, 500).mean() for _ in range(2000)]
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(gaps, [2.5, 97.5])), abs=0.03)
    assert got.middle == pytest.approx(y.mean() - x.mean(), abs=0.01)
    few = statistics.difference_interval(rows.limit(2), "i", "a", "b").first()
    assert (few.low, few.high, few.middle) == (None, None, None)


def test_score_interval(spark):
    rng = np.random.default_rng(3)
    n = 400
    ok, clap, dev = rng.random(n) < 0.6, rng.random(n), rng.normal(0, 0.1, n)
    rows = [(i, "c", "ok" if ok[i] else "bad", None if i % 9 == 0 else float(clap[i]), None if i % 11 == 0 else float(dev[i])) for i in range(n)]
    got = statistics.score_interval(spark.createDataFrame(rows, "i long, ck string, status string, clap_score double, deviation double"), "ck", "i").first()

    def score(at):
        c, d = [rows[i][3] for i in at if rows[i][3] is not None], [abs(rows[i][4]) for i in at if rows[i][4] is not None]
        return 0.4 * np.mean([rows[i][2] == "ok" for i in at]) + 0.3 * np.mean(c) + 0.3 * max(0.0, 1 - np.mean(d) / 0.2)

    assert got.score == pytest.approx(score(range(n)), abs=1e-4)
    scores = [score(rng.integers(0, n, n)) for _ in range(1000)]
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(scores, [2.5, 97.5])), abs=0.01)


def test_equal_differences(spark):
    same = spark.createDataFrame([(0.1,)] * 6, "d double")
    got = statistics.bayesian_ab(same).first()
    assert (got.posterior_mean, got.p_better) == (0.1, 1.0) and got.posterior_sd < 1e-5
    assert tuple(statistics.bayesian_ab(same.limit(1)).first()) == (1, None, None, None)
    assert statistics.wilcoxon(spark.createDataFrame([(0.0,)] * 9, "d double")).first().p == 1.0
    assert statistics.wilcoxon(spark.createDataFrame([], "d double")).first().p == 1.0


def test_kernel_width_is_the_median_distance(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(0, 1, (37, 3)), rng.normal(1, 1, (40, 3))
    table = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    far = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    assert extras.median_distance(vectors.blocks(table(x), "id", "v", size=10), vectors.blocks(table(y), "id", "v", size=15)) == pytest.approx(np.median(far), rel=1e-9)
    k = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / (2 * np.median(far) ** 2)).mean()
    assert extras.kernel_discrepancy(table(x), table(y), "id", "v").first().mmd == pytest.approx(k(x, x) + k(y, y) - 2 * k(x, y), abs=1e-6)
    assert extras.kernel_discrepancy(table(x[:1]), table(x[:1]), "id", "v").first().mmd == 0.0


def test_median_distance_beyond_the_sample(spark, monkeypatch):
    """A sample that tells a wrong range costs a pass; equal vectors have no distance; block pairs hold bounded matrices."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(0, 1, (300, 4)), rng.normal(0, 1, (200, 4))
    x[200:] += 50
    packed = lambda m, order: vectors.blocks(spark.createDataFrame([(order(i), v.tolist()) for i, v in enumerate(m)], "id long, v array<double>"), "id", "v", size=60)
    far = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    monkeypatch.setattr(extras, "SAMPLE", 5)
    monkeypatch.setattr(vectors, "TILE", 16)
    for order in (lambda i: i, lambda i: -i):  # the sample takes the first ids: near ones, or far ones
        assert extras.median_distance(packed(x, order), packed(y, order)) == pytest.approx(np.median(far), rel=1e-9)
    assert extras.median_distance(packed(np.zeros((3, 4)), abs), packed(np.zeros((2, 4)), abs)) == 0.0


def test_one_nn_across_blocks_and_slices(spark, monkeypatch):
    """Each pair of blocks is computed once, for both of its sides, some vectors at a time; ties go to smaller ids."""
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(300, 3)), 1)
    side = (np.arange(300) % 2).tolist()
    for i in range(300):  # no twins across sides
        x[i, 2] += 0.05 * side[i]
    d = np.round(((x[:, None] - x[None]) ** 2).sum(-1), 6)
    np.fill_diagonal(d, np.inf)
    want = np.mean([side[int(np.lexsort((np.arange(300), d[i]))[0])] == side[i] for i in range(300)])
    calls = []
    real = vectors.matched
    monkeypatch.setattr(extras, "matched", lambda *a, **k: calls.append(k.get("ordered")) or real(*a, **k))
    monkeypatch.setattr(extras, "blocks", lambda *a: vectors.blocks(*a, size=60))
    monkeypatch.setattr("corpusmill.operators.similarity.CELLS", 500)
    rows = spark.createDataFrame([(i, x[i].tolist(), side[i]) for i in range(300)], "id long, v array<double>, side long")
    got = extras.one_nn_accuracy(rows, "id", "v", "side").first()
    assert (got.n, got.accuracy) == (300, pytest.approx(want, abs=5e-5)) and calls == [True]


def test_one_nn_of_twins(spark):
    rows = [(0, [0.0, 1.0], 0), (1, [0.0, 1.1], 0), (2, [5.0, 1.0], 1), (3, [5.0, 1.1], 1)]
    make = lambda r: spark.createDataFrame(r, "id long, v array<double>, side long")
    assert extras.one_nn_accuracy(make(rows), "id", "v", "side").first().accuracy == 1.0
    assert extras.one_nn_accuracy(make([*rows, (4, [0.0, 1.0], 1)]), "id", "v", "side").first().accuracy == 0.5
    assert extras.one_nn_accuracy(make(rows[:1]), "id", "v", "side").first().accuracy == 0.5


def test_artifacts():
    t = np.sin(np.arange(8000) / 9) * 0.5
    assert signals.artifacts_of(t, 16)[3:] == (0, True)
    gap = t.copy()
    gap[3000:3160] = 0
    assert signals.artifacts_of(gap, 16)[3] == 1 and not signals.artifacts_of(gap, 16)[4]
    assert signals.artifacts_of(np.ones(3)) == (0, 0.0, 0.0, 0, True)
    click = np.zeros(100) + np.arange(100) * 1e-4
    click[50] = 1.0
    assert signals.artifacts_of(click, 16)[0] == 2


def test_wav_header_behind_a_long_chunk(spark, tmp_path):
    body = b"\0" * 400
    fmt = struct.pack("<HHIIHH", 1, 2, 44100, 176400, 4, 16)
    long = b"LIST" + struct.pack("<I", 20_000) + b"x" * 20_000
    chunks = b"fmt " + struct.pack("<I", 16) + fmt + long + b"data" + struct.pack("<I", len(body)) + body
    (tmp_path / "a.wav").write_bytes(b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks)
    (tmp_path / "b.wav").write_bytes(b"RIFF" + struct.pack("<I", 24) + b"WAVE" + b"fmt " + struct.pack("<I", 16) + fmt)
    good, bad = readers.wav_headers(spark, str(tmp_path)).orderBy("path").collect()
    assert (good.sample_rate, good.channels, good.frames, good.error) == (44100, 2, 100, None) and bad.error == "no samples"


def test_tracking_runs_of_nothing(spark, tmp_path):
    found = readers.tracking_runs(spark, f"{tmp_path}/none.csv")
    assert found.count() == 0 and len(found.columns) == 14


def test_label_template(spark, tmp_path):
    sinks.label_template(spark, f"{tmp_path}/labels")
    assert readers.labels(spark, f"{tmp_path}/labels").count() == 3
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.label_template(spark, f"{tmp_path}/labels")
    sinks.record(spark, {"name": "sweep", "rates": [1.0, 2.0]}, f"{tmp_path}/sweep")
    assert spark.read.json(f"{tmp_path}/sweep").first().asDict() == {"name": "sweep", "rates": [1.0, 2.0]}


def test_page_lines(spark):
    html = "<p>a&amp;b</p><script>x</script>one<br/>two &lt;3"
    assert value(spark, text.page_lines(F.lit(html))) == ["a&b", "one", "two <3"]


def test_fuzzy_match(spark):
    seg = spark.createDataFrame([("alpha_seg1",), ("my beta mix",), ("none",)], "segment string")
    songs = spark.createDataFrame([("alpha",), ("Beta",), ("alp",)], "song string")
    assert {tuple(r) for r in datasets.fuzzy_match(seg, songs).collect()} == {("alpha_seg1", "alpha"), ("my beta mix", "Beta")}


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.json").write_text('{"x": 3}\nnot json\n\n{"x": 4}\n')
    (tmp_path / "c.json").write_text('{\n "x": 5\n}')
    for name, want in (("a", [1, 2]), ("b", [3, 4]), ("c", [5]), ("none", [])):
        assert sorted(r.x for r in readers.tolerant_json(spark, f"{tmp_path}/{name}.json", "x int").collect()) == want
    (tmp_path / "l.csv").write_text("source_id,mood,energy\na,dark|calm,0.5\n,x,1\na,warm,loud\n")
    assert [(r.source_id, r.mood, r.energy) for r in readers.labels(spark, f"{tmp_path}/l.csv").collect()] == [("a", ["warm"], None)]
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps({"event": e, "ok": i}) for i, e in enumerate(("eval", "eval", "generate"))))
    assert [r.ok for r in readers.run_log(spark, f"{tmp_path}/log.jsonl", "eval").collect()] == [0, 1]
    assert [r.event for r in readers.run_log(spark, f"{tmp_path}/log.jsonl", limit=1).collect()] == ["generate"]
    assert readers.eval_results(spark, f"{tmp_path}/missing.jsonl").count() == 0
    (tmp_path / "Ann - Song+1.txt").write_text("a\n\n b \n")
    assert [tuple(r) for r in readers.song_texts(spark, f"{tmp_path}/*.txt").collect()] == [("Ann", "Song+1", ["a", "b"])]


def test_wav_headers(spark, tmp_path):
    data = b"\0" * 400
    head = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", len(data))
    (tmp_path / "a.wav").write_bytes(head + data)
    (tmp_path / "b.wav").write_bytes(b"junk")
    good, bad = readers.wav_headers(spark, str(tmp_path)).orderBy("path").collect()
    assert (good.sample_rate, good.channels, good.frames, good.duration, good.error) == (8000, 2, 100, 0.0125, None)
    assert bad.error == "no WAV file"
    assert readers.file_hashes(spark, str(tmp_path), "*.wav").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("k1", "p", "train", ["a"]), ("k2", "q", "val", [])], "k string, part string, split string, tags array<string>")
    sinks.splits(df, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").where("split = 'val'").count() == 1
    sinks.csv(df, f"{tmp_path}/c", ["k", "tags", "none"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/c").orderBy("k").collect()] == [("k1", '["a"]', None), ("k2", "[]", None)]
    for _ in range(2):
        sinks.upsert(df, f"{tmp_path}/u", "k", "part")
    assert spark.read.parquet(f"{tmp_path}/u").count() == 2


def test_signals(spark):
    t = np.arange(4096) / 8000
    rows = spark.createDataFrame([(np.sin(440 * 2 * np.pi * t).tolist(),), ([],), (None,)], "y array<double>")
    got = [r.m for r in rows.select(signals.measured("y").alias("m")).collect()]
    assert got[0].rms == pytest.approx(2**-0.5, abs=0.01) and got[0].silence_ratio == 0 and got[1].peak is None and got[2].peak is None
    chromas = spark.createDataFrame([(list(signals.MAJOR),), (np.roll(signals.MINOR, 9).tolist(),), ([1.0] * 12,), (None,), ([1.0],)], "c array<double>")
    one, two, flat, none, short = (r.k for r in chromas.select(signals.keys("c").alias("k")).collect())
    assert (one[0].key, two[0].key, none, short) == ("C major", "A minor", [], []) and flat[0].share == pytest.approx(1 / 24)
    x = [float(v) for v in t[:50]]
    pairs = spark.createDataFrame([(x, x), (x, [-v for v in x]), (x, [v * 0.5 + 3.0 for v in x])], "l array<double>, r array<double>")
    same, against, offset = (r.s for r in pairs.select(signals.stereo("l", "r").alias("s")).collect())
    assert tuple(same) == (0.0, 1.0, True) and tuple(against) == (1.0, -1.0, False) and offset.phase_correlation == 1.0
    bands = spark.createDataFrame([([1.0, 1.0, 2.0],), ([0.0, 0.0, 0.0],)], "bands array<double>")
    assert signals.spectral_divergence(bands, bands, "bands").first().divergence == 0.0


def test_early_stop_keeps_state(spark, tmp_path):
    spark.createDataFrame([("a", i, v) for i, v in enumerate((0.1, 0.5, 0.4, 0.3, 0.2))] + [("b", 0, 0.1)], "k string, at long, v double").write.parquet(f"{tmp_path}/x")
    stream = spark.readStream.schema("k string, at long, v double").parquet(f"{tmp_path}/x")
    got = {r.k: r for r in logs.drained(logs.early_stop(stream, "k", "v", "at"), f"{tmp_path}/out", "update").collect()}
    assert (got["a"].best, got["a"].since_best, got["a"].stop) == (0.5, 3, True) and not got["b"].stop


def test_comparison_verdicts(spark):
    rows = [(0.40 + 0.001 * i, 0.60 + 0.0011 * i, 0.05 + 0.0001 * i, -0.02) for i in range(12)]
    both = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, clap_a double, clap_b double, dev_a double, dev_b double")
    got = {r.metric: r for r in statistics.comparison(both, "i", {"clap": True, "dev": False}, draws=200).collect()}
    assert all(r.verdict == "improved" and r.p < 0.05 and r.n == 12 and r.p_better > 0.99 for r in got.values())
    assert all(r.low < r.delta < r.high and r.n_paired == 12 for r in got.values())
    same = spark.createDataFrame([(i, 0.5, 0.5) for i in range(10)], "i long, clap_a double, clap_b double")
    found = statistics.comparison(same, "i", {"clap": True}, draws=50).first()
    assert (found.verdict, found.p, found.low, found.high) == ("no significant difference", 1.0, 0.0, 0.0)


def test_principal_axes(spark):
    v = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.1 * (i % 2)]) for i in range(20)], "id long, v array<double>")
    got = {r.id: r for r in vectors.principal_axes(v, "id", "v").collect()}
    assert got[19].x1 - got[0].x1 == pytest.approx(19 * 5**0.5, abs=0.01) and abs(got[5].x2) < 0.1


def test_shift_similarity_is_the_best_rotation(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 1, 12).tolist(), rng.normal(0, 1, 12).tolist()) for i in range(5)]
    rows += [(9, rows[0][1], np.roll(rows[0][1], 5).tolist()), (10, [0.0] * 12, rows[0][1])]
    df = spark.createDataFrame(rows, "id long, a array<double>, b array<double>")
    got = {r.id: r.s for r in df.select("id", vectors.shift_similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    for i, a, b in rows[:6]:
        a, b = np.array(a), np.array(b)
        assert got[i] == pytest.approx(max(a @ np.roll(b, k) for k in range(12)) / (np.linalg.norm(a) * np.linalg.norm(b)))
    assert got[9] == pytest.approx(1.0) and got[10] is None


def test_routes_and_perturbed_prompts(spark):
    keys = spark.range(4000).withColumn("prompt", F.concat(F.lit("slow trap and trap "), "id"))
    routes = [r.route for r in catalog.routed(keys, "id", 0.3).collect()]
    assert routes.count("champion") / 4000 == pytest.approx(0.3, abs=0.03)
    assert {r.route for r in catalog.routed(keys, "id", 7.0).collect()} == {"champion"}
    assert [r.route for r in catalog.routed(keys.repartition(5), "id", 0.3).orderBy("id").collect()] == [r.route for r in catalog.routed(keys, "id", 0.3).orderBy("id").collect()]
    said = [r.p for r in keys.select(catalog.perturbed(F.col("prompt"), F.col("id"), 3, "trap", "house").alias("p"), "id").orderBy("id").collect()]
    changed = [p.startswith("slow house and trap ") for p in said]
    assert 0.4 < sum(changed) / 4000 < 0.6 and all(c or p.startswith("slow trap and trap ") for c, p in zip(changed, said, strict=True))


def test_drift_report(spark):
    rng = np.random.default_rng(9)
    rows = [(bool(i % 2), float(rng.normal(0, 1)), float(rng.normal(2.0 * (i % 2), 1)), "ab"[i % 2], "xyz"[i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows, "cur boolean, same double, moved double, kind string, even string")
    got = {r.feature: r for r in catalog.drift_report(df, F.col("cur"), ["same", "moved"], ["kind", "even"]).collect()}
    assert {k: r.drifted for k, r in got.items()} == {"same": False, "moved": True, "kind": True, "even": False}
    a, b = (np.sort([r[2] for r in rows if r[0] == x]) for x in (True, False))
    at = np.concatenate([a, b])
    far = np.abs(np.searchsorted(a, at, side="right") / 300 - np.searchsorted(b, at, side="right") / 300).max()
    assert got["moved"].ks_pvalue == round(tails.ks_p(round(float(far), 6), 300, 300), 6) and got["even"].psi == 0.0


def test_labelling_priority(spark):
    """Split neighbourhoods and far vectors come first."""
    known = [(i, [1.0, 0.01 * i], 0) for i in range(5)] + [(10 + i, [0.01 * i, 1.0], 1) for i in range(5)]
    asked = [(100, [1.0, 0.02], -1), (101, [1.0, 1.0], -1), (102, [-1.0, -0.9], -1)]
    make = lambda rows: spark.createDataFrame(rows, "id long, v array<double>, label int")
    got = [r.id for r in vectors.labelling_priority(make(asked), make(known), "id", "v", "label", 3).collect()]
    assert got[-1] == 100 and set(got) == {100, 101, 102}


def test_fold_summary(spark):
    segments = spark.createDataFrame([(f"s{i % 11}",) for i in range(100)], "song string")
    got = studio.fold_summary(segments, "song", 4, 7).orderBy("fold").collect()
    assert [r.val_songs for r in got] in ([3, 3, 3, 2], [2, 3, 3, 3], [3, 2, 3, 3], [3, 3, 2, 3])
    assert all(r.val_songs + r.train_songs == 11 and r.val_segments + r.train_segments == 100 for r in got) and sum(r.val_segments for r in got) == 100
