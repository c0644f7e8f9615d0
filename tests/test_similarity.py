"""Similarity joins by codes and balls against all pairs."""

import re

import numpy as np
import pytest

from corpusmill.operators import similarity, vectors


def table(spark, x, groups=None):
    rows = [(i, None if v is None else [float(c) for c in v], int(groups[i]) if groups is not None else 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>, g int")


def cosines(x):
    size = np.linalg.norm(x, axis=1)
    unit = x / np.where(size == 0, 1, size)[:, None]
    return np.round(unit @ unit.T, 6)


def clustered(n, dims, centres, spread, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    return c[rng.integers(0, centres, n)] + rng.normal(size=(n, dims)) * spread


@pytest.mark.parametrize(("least", "dims", "spread"), [(0.9, 16, 0.2), (0.98, 16, 0.1), (0.3, 8, 1.0), (-0.2, 3, 1.0)])
def test_pairs_equal_all_pairs(spark, least, dims, spread):
    x = clustered(400, dims, 12, spread)
    x[7] = 0
    x[20:30] = x[19]  # copies
    found = {(r.a, r.b): r.similarity for r in similarity.pairs_above(table(spark, x), "id", "v", least, size=60).collect()}
    s = cosines(x)
    want = {(i, j): s[i, j] for i in range(400) for j in range(i + 1, 400) if s[i, j] >= least}
    assert found.keys() == want.keys() and len(want) > 50
    assert all(abs(found[p] - want[p]) < 2e-6 for p in want)


def test_pairs_of_many_blocks_by_cells(spark):
    """A table large enough for cells: copies of one vector in a cell that is several blocks."""
    x = clustered(2_400, 6, 30, 0.02)
    x[:500] = x[0]
    groups = np.arange(2_400) % 2
    found = {(r.a, r.b) for r in similarity.pairs_above(table(spark, x, groups), "id", "v", 0.995, "g", size=200).collect()}
    i, j = np.nonzero(np.triu(cosines(x) >= 0.995, 1))
    assert found == {(int(a), int(b)) for a, b in zip(i, j, strict=True) if groups[a] != groups[b]}


def test_few_block_pairs_meet_in_clusters(spark):
    """Of a clustered table under a tenth of the block pairs are shipped at 0.9; none that holds a match is left out."""
    rows = table(spark, clustered(3_000, 16, 40, 0.05))
    sample = similarity.sampled(rows, "id", "v", similarity.SAMPLE)
    code = similarity.code_for(sample, 0.9)
    own, most = similarity.blocks(rows, "id", "v", code, similarity.spread_out(sample), size=1_000)
    n = own.count()
    met = similarity.meeting(own, own, most, float(np.arccos(0.9)), ordered=True).count()
    assert n >= 20 and met < 0.1 * n * (n + 1) / 2
    assert code.kept == 8  # a byte for half of the coordinates is enough


@pytest.mark.parametrize("k", [1, 5, 500])
def test_nearest_equal_all(spark, k):
    x = clustered(300, 8, 5, 0.5)
    x[3] = 0
    x[10:20] = x[9]  # ties
    rows = table(spark, x)
    found = [tuple(r) for r in similarity.nearest(rows.where("id % 30 = 0"), rows, "id", "v", k, size=70).orderBy("query", "rank").collect()]
    s = cosines(x)
    want = []
    for q in range(0, 300, 30):
        by = sorted((j for j in range(300) if j != q), key=lambda j: (-s[q, j], j))[:k]
        want += [(q, n + 1, j, s[q, j]) for n, j in enumerate(by)]
    assert [f[:2] for f in found] == [w[:2] for w in want]
    assert np.allclose([f[3] for f in found], [w[3] for w in want], atol=2e-6)
    assert np.mean([f[2] == w[2] for f, w in zip(found, want, strict=True)]) > 0.99  # a sixth place may round either way


def test_awkward_tables(spark):
    none = table(spark, [])
    assert similarity.pairs_above(none, "id", "v", 0.5).count() == 0
    assert similarity.nearest(none, none, "id", "v", 3).count() == 0
    odd = table(spark, [None, [0.0, 0.0], [1.0, 0.0], None, [2.0, 0.0]])
    assert [(r.a, r.b) for r in similarity.pairs_above(odd, "id", "v", 0.5).collect()] == [(2, 4)]
    assert similarity.pairs_above(table(spark, [[0.0, 0.0]] * 3), "id", "v", 0.5).count() == 0
    assert {(r.query, r.id, r.similarity) for r in similarity.nearest(odd, odd, "id", "v", 1).collect()} == {(1, 2, 0.0), (2, 4, 1.0), (4, 2, 1.0)}
    own = similarity.nearest(odd.where("id = 2"), odd, "id", "v", 2, own=True).collect()
    assert [(r.rank, r.id) for r in own] == [(1, 2), (2, 4)]


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes, _ = np.linalg.qr(rng.normal(size=(10, 10)))
    for code in (similarity.Code(axes, 5, "int8"), similarity.Code(axes, 10, "int8"), similarity.Code(axes, 10, "int16"), similarity.full_code(10)):
        middle, half = code.bounds(code.of(x), code.of(x))
        assert (np.abs(x @ x.T - middle) <= half).all()


def test_nearest_reads_no_vectors_in_pairs(spark):
    """What is shipped by pairs of blocks are codes."""
    rows = table(spark, clustered(100, 8, 5, 0.5))
    plan = similarity.nearest(rows, rows, "id", "v", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan


def test_edges_are_computed_once(spark):
    """A greedy pass of many rounds reads its edges from what the first one wrote."""
    computed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 7)], "a long, b long").mapInArrow(counted, "a long, b long")
    assert {tuple(r) for r in vectors.greedy_clusters(edges).collect()} == {(1, 2), (3, 4), (5, 6)}
    assert computed.value == 6


@pytest.mark.parametrize("least", [0.35, 0.999])
def test_pairs_with_many_similar_are_told_in_blocks(spark, least):
    """No pair of a dense join is joined with its vectors; of a sparse one, those left open are. Both by cells and across groups."""
    x = np.random.default_rng(3).normal(size=(1_500, 24))
    x[5], x[9] = 0, x[8]
    x[1_001:1_006] = x[:5] * 1.0001
    groups = np.arange(1_500) % 2
    made = similarity.pairs_above(table(spark, x, groups), "id", "v", least, "g", size=300)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert ("n_x" not in plan) == (least == 0.35)
    i, j = np.nonzero(np.triu(cosines(x) >= least, 1))
    want = {(int(a), int(b)) for a, b in zip(i, j, strict=True) if groups[a] != groups[b]}
    assert {(r.a, r.b) for r in made.collect()} == want and (len(want) > 1_000) == (least == 0.35)


def test_tasks_hold_bounded_matrices(spark, monkeypatch):
    """However large blocks are, so many cosines at a time."""
    monkeypatch.setattr(similarity, "CELLS", 1_000)
    rows = table(spark, clustered(400, 8, 5, 0.5))

    def take(x, y, middle, half):
        return similarity.pa.table({"n": [middle.size]})

    code = similarity.full_code(8)
    own, n = similarity.blocks(rows, "id", "v", code, np.zeros((0, 0)))
    sizes = [r.n for r in similarity.candidates(own, own, similarity.meeting(own, own, n, None), code, take, "n long").collect()]
    assert max(sizes) <= 1_000 and sum(sizes) == 160_000


def test_search_deals_pairs_of_blocks_to_tasks(spark):
    """Few blocks are many pairs: each is met once, and tasks get them by pair, not by block."""
    rows = table(spark, clustered(600, 8, 5, 0.5))
    code, none = similarity.full_code(8), np.zeros((0, 0))
    (asked, m), (held, n) = (similarity.blocks(t, "id", "v", code, none, size=size) for t, size in ((rows.where("id % 5 = 0"), 40), (rows, 100)))
    met = similarity.every_pair(asked, m, held, n).selectExpr("a", "b", "one.block as one", "two.block as two").collect()
    assert sorted((r.a, r.b) for r in met) == [(a, b) for a in range(m) for b in range(n)] and m == 3 and n == 6
    assert all((r.a, r.b) == (r.one, r.two) for r in met)
    plan = similarity.nearest(rows.where("id % 5 = 0"), rows, "id", "v", 3, size=100)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(a#\d+, b#\d+", plan)


def test_labelling_of_many_blocks_equals_all_pairs(spark, monkeypatch):
    """What to label next over several blocks on either side, dealt by pair, as by all cosines."""
    monkeypatch.setattr(similarity, "LEAST", 40)
    x, kind = clustered(600, 8, 12, 0.8), np.arange(600) % 3
    rows = table(spark, x, kind)
    made = vectors.labelling_priority(rows.where("id % 5 = 0"), rows.where("id % 5 <> 0"), "id", "v", "g", 20)
    assert re.search(r"hashpartitioning\(a#\d+, b#\d+", made._jdf.queryExecution().executedPlan().toString())
    s, known = cosines(x), np.flatnonzero(np.arange(600) % 5)
    near = {q: sorted(known, key=lambda j: (-s[q, j], j))[:5] for q in range(0, 600, 5)}
    split = np.array([1 - np.bincount(kind[n]).max() / 5 for n in near.values()])
    far = np.array([1 - s[q, n[0]] for q, n in near.items()])
    priority = (split - split.mean()) / split.std() + (far - far.mean()) / far.std()
    best = sorted(zip(-priority, near, strict=True))[:20]
    got = [(r.id, r.priority) for r in made.collect()]
    assert [g[0] for g in got] == [b[1] for b in best]
    assert np.allclose([g[1] for g in got], [-b[0] for b in best], atol=1e-4)


def test_labelling_holds_bounded_matrices_however_many_rows(spark, monkeypatch):
    """In tables of one block and of several, no task computes more cosines at a time than it may; the rows are those of larger matrices."""
    monkeypatch.setattr(similarity, "CELLS", 10**9, raising=False)

    def bounded(dims):
        class Bounded(similarity.Code):
            def bounds(self, one, two):
                if len(one[0]) * len(two[0]) > 2_000:
                    raise ValueError(f"{len(one[0])} x {len(two[0])} cosines at a time")
                return super().bounds(one, two)

        return Bounded(np.eye(dims), dims, "int16")

    for n in (300, 1_500):
        rows = table(spark, clustered(n, 8, 12, 0.8), np.arange(n) % 3)
        made = lambda: [tuple(r) for r in vectors.labelling_priority(rows.where("id % 5 = 0"), rows.where("id % 5 <> 0"), "id", "v", "g", 20).collect()]  # noqa: B023, E731
        want = made()
        with monkeypatch.context() as m:
            m.setattr(similarity, "full_code", bounded)
            with pytest.raises(Exception, match="cosines at a time"):
                made()
            m.setattr(similarity, "CELLS", 2_000, raising=False)
            assert made() == want and len(want) == 20
