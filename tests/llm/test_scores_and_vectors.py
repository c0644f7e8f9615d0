"""Toxicity, hard negatives and whitening: against brute force, on planted texts, on awkward tables."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import hard_negatives, toxicity, whitening
from corpusmill.llm.toxicity import CLASSES, EDGE

VECTORS = "vec_id long, label long, embedding array<float>, v string, x int, score string, anchor_id long, turn int, component int, n long, dims int"


def vectors(spark, rows):
    """(vec_id, label, embedding) rows as a table with extra columns of clashing names."""
    return spark.createDataFrame([(*r, "v", 1, "s", 2, 3, 4, 5, 6) for r in rows], VECTORS)


def brute_negatives(rows, positives=5, negatives=10, low=30, high=90):
    """The contract, row by row."""
    ok = [(i, y, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, y, v in rows if i is not None and y is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    anchors = {}
    for i, y, v in ok:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, y) for i, y, w in ok if i != a and len(w) == len(v))
        for s, p, _ in [t for t in scored if t[2] == label][:positives]:
            fit = [t for t in scored if t[2] != label and low * -s <= 100 * -t[0] <= high * -s][:negatives]
            out += [(a, p, k + 1, t[1], -s, -t[0]) for k, t in enumerate(fit)]
    return sorted(out)


def mined(df, **more):
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, **more).collect())


def test_hard_negatives(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 8))
    rows = []
    for i in range(600):
        v = centres[i % 4] * 0.5 + rng.normal(size=8) * 0.4
        rows.append((i, int(rng.integers(0, 4)), [float(x) for x in v]))
    assert mined(vectors(spark, rows), per_block=64, per_turn=2) == brute_negatives(rows)


def test_hard_negatives_of_many_ties(spark):
    """One vector held by most rows, of either label: the ids decide, digit by digit."""
    same = [0.5, 0.25, 0.5, 0.25]
    rows = [(i, i % 2, same) for i in range(3_000)]
    rows += [(5_000 + i, 1, [0.25, 0.25, 0.25, 0.25]) for i in range(900)]
    assert mined(vectors(spark, rows), per_block=500) == brute_negatives(rows)


def test_hard_negatives_of_repeated_ids(spark):
    """Rows that repeat an id are candidates each; an anchor's own copies are not."""
    rows = [(100, 0, [1.0, 0.0]), (100, 0, [1.0, 0.0]), (100, 1, [0.5, 0.0])]
    rows += [(7, 0, [0.9, 0.1])] * 3 + [(8, 1, [0.6, 0.0])] * 500 + [(9, 1, [0.6, 0.0])] * 4
    assert mined(vectors(spark, rows)) == brute_negatives(rows)


def test_hard_negatives_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 1.0]), (2, 2, [0.5, 0.5]), (3, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (4, 1, None), (5, 1, []), (6, 2, [nan, 1.0]), (8, 2, [inf, 1.0]), (9, 2, [None, 1.0]), (10, 2, [1.0, 1.0, 1.0]), (200, 3, [1.0, 1.0, 1.0]), (300, 1, [-1.0, -1.0]), (11, 2, [1e6, 1e6])]
    assert mined(vectors(spark, rows)) == brute_negatives(rows)
    assert mined(vectors(spark, [])) == []
    assert mined(vectors(spark, [r for r in rows if r[0] and r[0] % 100])) == []


def test_large_scores_are_exact():
    """Beyond 2^52 products are summed as integers."""
    block = hard_negatives.Block(np.arange(2), np.zeros(2, dtype=np.int64), np.array([[3_037_000_499, 1], [3_037_000_498, 7]]))
    assert block.scores(np.array([[1_000_000_007, 1]])).tolist() == [[3_037_000_499 * 1_000_000_007 + 1, 3_037_000_498 * 1_000_000_007 + 7]]


def test_whitening(spark):
    rng = np.random.default_rng(5)
    table = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * 0.1
    rows = [(i, 0, [float(np.float32(c)) for c in v]) for i, v in enumerate(table)]
    found = whitening.whiten(vectors(spark, rows)).toPandas()
    x = np.floor(1024 * np.array([r[2] for r in rows])).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    want = (centred @ components[:, ::-1][:, :8]) / np.sqrt(values[::-1][:8])
    got = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-9)
    assert np.allclose(got.T @ got / n, np.eye(8), atol=1e-9)
    first = found[found["component"] == 1].sort_values("vec_id")
    assert [int(d) for d in first["deviation"]] == [int(d) for d in ((n * x - sums) ** 2).sum(axis=1)]
    assert np.allclose(found.groupby("component")["explained"].first(), values[::-1][:8] / values.sum())
    assert (found["n"] == n).all() and found["identity_error"].nunique() == 1 and found["identity_error"].iloc[0] < 1e-9


def test_whitening_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(None, 1, None), (4, 1, []), (6, 2, [nan, 1.0]), (8, 2, [inf, 1.0]), (9, 2, [None, 1.0])]
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, bad)).count() == 0
    assert whitening.whiten(vectors(spark, [(1, 1, [0.5, 0.5])] * 3)).count() == 0  # no variance
    rows = [*bad, (1, 1, [0.0, 1.0]), (1, 1, [0.0, 1.0]), (None, 1, [1.0, 0.0]), (2, 1, [1.0, 1.0, 1.0])]
    found = whitening.whiten(vectors(spark, rows)).toPandas()
    assert sorted(found["component"]) == [1, 1, 1] and (found["n"] == 3).all()  # the second component has no variance
    assert np.allclose(sorted(np.abs(found["whitened"])), [0.5**0.5, 0.5**0.5, 2**0.5])
    assert np.allclose(found["explained"], 1.0)


def test_deviations_beyond_63_bits():
    x = np.array([[2**40, -(2**40)], [0, 5]])
    sums, n = (2**62 + 2**61, 77), 10**10
    assert whitening.deviations(x, n, sums) == [sum((n * int(c) - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]


WORDS = "you are such an awful idiot moron trash and the stone river walks over green hills while people speak about stupid clown things".split()


def model_of(texts):
    return toxicity.log_chances(sum(toxicity.trigrams(t) for t in texts)).tolist()


def said(classes, chances):
    """Log chance of a class sequence that is framed by boundaries, those in a row being one."""
    a, b, total = EDGE, EDGE, 0.0
    for c in [*classes, EDGE]:
        if c != EDGE or b != EDGE:
            total += chances[(a * CLASSES + b) * CLASSES + c]
            a, b = b, c
    return total


@pytest.mark.parametrize("seen", ["1d10t", "m0r0n", "s t u p 1 d", "cl0wnnn", "tr@$h", "a.b", "i d10", "0", "ss11"])
def test_viterbi_is_the_best_way(seen):
    chances = model_of([" ".join(WORDS)] * 5)
    runs = [(k, len(list(g))) for k, g in itertools.groupby(seen)]
    at, columns = 0, []
    for char, run in runs:
        inside = 0 < at and at + run < len(seen) and seen[at - 1] not in toxicity.GAPS and seen[at + run] not in toxicity.GAPS
        columns.append(toxicity._options(char, run, inside))
        at += run
    score = lambda way: sum(o[2] for o in way) + said([c for o in way for c in o[1]], chances)
    ways = {"".join(o[0] for o in way): score(way) for way in sorted(itertools.product(*columns), key=score)}
    assert ways[toxicity.decode(seen, chances)] == pytest.approx(max(ways.values()))


@pytest.mark.parametrize(
    ("seen", "want"),
    [
        ("1d10t", "idiot"), ("IDIOOOOT", "idiot"), ("you i d i o t", "you idiot"), ("s.t.u.p.i.d", "stupid"), ("tr@sh!!", "trash!!"), ("cl0wn", "clown"), ("tr@$h", "trash"), ("covid19 src12", "covid19 src12"),
        ("m​or­on", "moron"), ("id!ot", "idiot"), ("plain words stay, 2024 too", "plain words stay, 2024 too"), ("1 2 3 4", "1 2 3 4"), ("", ""), ("stop!!!", "stop!!!"),
    ],
)
def test_restoring(seen, want):
    assert toxicity.Channel(model_of([" ".join(WORDS)] * 50)).restore(seen) == want


def test_restoring_long_texts_is_linear():
    channel = toxicity.Channel(model_of([" ".join(WORDS)]))
    for seen in ("a" * 300_000, "a " * 100_000, "1a" * 50_000, "!" * 300_000, "a1" * 20_000 + " x", "a!" * 30_000):
        assert channel.restore(seen) is not None


DOCS = "doc_id long, text string, lang string, toxic int, score string, key string, term string, predicted int, held_out string, n int"
LABELS = "doc_id long, quality int, toxic int, text string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 5, "s", "k", "t", 7, "h", 8) for i, t in rows], DOCS)


def labels(spark, rows):
    return spark.createDataFrame([(i, 0, y, "x") for i, y in rows], LABELS)


def planted(n=400):
    rng = random.Random(2)
    insults = ["idiot", "moron", "trash", "stupid", "clown"]
    spelt = {"idiot": "1d10t", "moron": "m0r0n", "trash": "t r a s h", "stupid": "stuuuupid", "clown": "cl0wn"}
    clean = [w for w in WORDS if w not in insults]
    texts, truth, hidden = [], [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(words) // 25):
                words[rng.randrange(len(words))] = rng.choice(insults)
        texts.append(" ".join(words))
        truth.append(int(toxic))
        hidden.append(" ".join(spelt.get(w, w) for w in words))
    return texts, truth, hidden


def test_toxicity_of_planted_texts(spark):
    texts, truth, hidden = planted()
    rows = list(enumerate(texts)) + [(10_000 + i, t) for i, t in enumerate(hidden)]
    found = {r["doc_id"]: r for r in toxicity.score_documents(docs(spark, rows), labels(spark, list(enumerate(truth)))).collect()}
    out = [i for i in range(len(texts)) if found[i]["held_out"]]
    assert len(out) > 40
    assert np.mean([found[i]["predicted"] == truth[i] for i in out]) > 0.98
    assert np.mean([found[10_000 + i]["predicted"] == y for i, y in enumerate(truth)]) > 0.98  # disguised
    assert all((r["score"] >= 0.5) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in found.values())


def test_held_out_labels_are_not_read(spark):
    texts, truth, _ = planted(200)
    table = docs(spark, list(enumerate(texts)))
    parts = {r["doc_id"]: r["h"] for r in table.select("doc_id", toxicity.held_out().alias("h")).collect()}
    plain = toxicity.score_documents(table, labels(spark, list(enumerate(truth))))
    turned = toxicity.score_documents(table, labels(spark, [(i, 1 - y if parts[i] else y) for i, y in enumerate(truth)]))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, turned.collect()))


def test_toxicity_of_awkward_rows(spark):
    texts, truth, _ = planted(40)
    rows = [*enumerate(texts), (None, "idiot"), (None, None), (900, None), (900, None), (901, ""), (902, "   \n"), (903, "you idiot " * 60_000), (904, "a" * 200_000), (3, texts[3])]
    held = labels(spark, [*enumerate(truth), (None, 1), (5, None), (6, 0), (6, 1), (12_345, 1)])
    found = toxicity.score_documents(docs(spark, rows), held).collect()
    assert len(found) == len(rows) and all(r["held_out"] is not None and r["score"] is not None for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (900, 901, 902)}) == 1
    assert toxicity.score_documents(docs(spark, []), held).count() == 0
    assert {r["score"] for r in toxicity.score_documents(docs(spark, rows), labels(spark, [])).collect()} == {0.5}
    assert {r["predicted"] for r in toxicity.score_documents(docs(spark, rows), labels(spark, [(1, 0), (2, 0)])).collect()} == {0}


def test_the_sample_is_bounded(spark):
    table = docs(spark, [(i, "word") for i in range(600)] + [(7, "other")] * 300)
    sample = toxicity.labelled_sample(table, labels(spark, [(i, i % 2) for i in range(600)]), per_class=50)
    assert 60 < sample.count() < 140 and sample.where("toxic = 1").where("text = 'other'").count() <= 1


def test_restored_texts(spark):
    texts, truth, _ = planted(40)
    table = docs(spark, [*enumerate(texts), (77, None), (78, "M0R0N i d i o t")])
    model = toxicity.train(table, labels(spark, list(enumerate(truth))))
    found = {r["doc_id"]: r["text"] for r in toxicity.restored(table, model).collect()}
    assert found[77] == "" and found[78] == "moron idiot" and found[0] == texts[0]


def test_prefilters_skip_nothing():
    """What the character traits rule out, the patterns would not have found."""
    rng = random.Random(8)
    for _ in range(20_000):
        text = "".join(rng.choice("abßé  .-_1@$!|+*A\n٣ª") for _ in range(rng.randint(0, 9)))
        low = text.lower()
        traits, odd = toxicity._marks(low)
        assert odd.any() or not toxicity.SUSPECT.search(low), text
        assert toxicity._alone(traits) or not toxicity.SPACED.search(low), text


def test_strength_is_that_of_the_best_term():
    model = toxicity.Model(np.zeros(1), {"tras": 3.0, "trash$": 5.0, "ab$": 4.0, "clown": 3.5}, np.zeros(3))
    assert model.measures({"trash": 1, "trashy": 1, "ab": 1, "abc": 1, "clow": 1, "clowns": 1})[1] == pytest.approx(np.log1p(5 + 3 + 4 + 3.5))


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from corpusmill.llm.shared import scratch_dir

    def session(master, **named):
        conf = SimpleNamespace(get=lambda k, d=None: {"spark.sql.warehouse.dir": "file:/w", **named}.get(k, d), set=lambda k, v: None)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: None)))

    assert scratch_dir(session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    assert scratch_dir(session("local[4]")) == "file:/w/corpusmill-scratch"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(session("spark://host:7077"))
