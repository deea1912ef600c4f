"""Vector operators against brute force, on invalid, repeated and clustered vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import ivfpq, lattice

RNG = np.random.default_rng(5)
SCHEMA = "vec_id long, embedding array<double>, label int, key string, rep string, links int, list int"


def vectors(n=500, dim=24, copies=60, near=150):
    base = RNG.standard_normal((n, dim))
    same = np.repeat(base[:1], copies, 0)
    close = base[1] + 0.02 * RNG.standard_normal((near, dim)) * np.linalg.norm(base[1])
    border = base[2:42] + RNG.standard_normal((40, dim)) * 0.24
    scaled = base[50:60] * 3
    return np.vstack([base, same, close, border, scaled])


V = vectors()
BAD = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23]


def rows():
    out = [(i, v.tolist()) for i, v in enumerate(V)] + [(5000 + i, b) for i, b in enumerate(BAD)] + [(7000, [1.0, 2.0]), (7001, [2.0, 4.0]), (None, V[0].tolist()), (3, V[3].tolist())]
    return [(i, v, 1, "k", "r", 2, 3) for i, v in out]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(4)


def brute(threshold=0.95):
    unit = V / np.linalg.norm(V, axis=1, keepdims=True)
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    component = np.arange(len(V))
    while True:
        low = np.array([min(component[i], component[linked[i]].min(initial=len(V))) for i in range(len(V))])
        if (low == component).all():
            return linked.sum(1), component
        component = low


@pytest.mark.parametrize("chunk", [2048, 16])
def test_lattice(frame, chunk):
    got = {r.vec_id: r for r in lattice.near_vectors(frame, chunk=chunk).collect()}
    assert len(got) == len(V) + len(BAD) + 2
    links, component = brute()
    mine = np.array([got[i].n_links for i in range(len(V))])
    assert (mine <= links).all() and mine.sum() >= 0.995 * links.sum()
    assert np.mean([got[i].component_id == component[i] for i in range(len(V))]) > 0.99
    assert got[0].n_links == links[0] == 60  # copies, counted without expanding them
    for i in range(len(BAD)):
        assert (got[5000 + i].n_links, got[5000 + i].component_id, got[5000 + i].kept) == (0, 5000 + i, True)
    assert got[7000].n_links == 1 and got[7001].component_id == 7000 and not got[7001].kept


def test_lattice_keys_do_not_depend_on_the_batch():
    unit = V / np.linalg.norm(V, axis=1, keepdims=True)
    lat = lattice.Lattice(24, 5, 5.0, 4)
    whole = lat.keys(unit)
    assert (np.concatenate([lat.keys(unit[i : i + 7]) for i in range(0, len(unit), 7)]) == whole).all()


@pytest.mark.parametrize("dim", [8, 12, 16, 24, 32])
@pytest.mark.parametrize("n", [1000, 1_000_000, 100_000_000])
def test_lattice_misses_few_pairs_of_short_vectors(dim, n):
    rng = np.random.default_rng(dim)
    x, y = rng.standard_normal((2, 4000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    lat = lattice.Lattice(dim, **lattice.parameters(n))
    p, q = lat.keys(x), lat.keys(y)
    assert ((p[:, :, :1] == q) | (q[:, :, :1] == p)).any((1, 2)).mean() >= 0.999


def test_e8():
    assert lattice.ROOTS.shape == (240, 8) and ((lattice.ROOTS**2).sum(1) == 8).all()
    y = RNG.uniform(-2, 2, (2000, 8))
    points = lattice.decode_e8(y)
    assert ((points % 2 == points[:, :1] % 2).all(1)).all() and (points.sum(1) % 4 == 0).all()
    assert (((y - points / 2) ** 2).sum(1) <= 1 + 1e-9).all()  # covering radius
    nearer = ((y[:, None] - (points[:, None] + lattice.ROOTS) / 2) ** 2).sum(2) < ((y - points / 2) ** 2).sum(1)[:, None] - 1e-9
    assert not nearer.any()


@pytest.mark.parametrize("small", [False, True])
def test_ivfpq(frame, monkeypatch, small):
    if small:  # many chunks
        monkeypatch.setattr(ivfpq, "ROWS_CHUNK", 40)
        monkeypatch.setattr(ivfpq, "QUERIES_CHUNK", 3)
    got = ivfpq.nearest_neighbours(frame, F.col("vec_id") % 20 == 0, 20).collect()
    scores = V @ V.T
    hit = total = 0
    for q in range(0, len(V), 20):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and q not in [r.vec_id for r in mine]
        assert all(abs(r.score - scores[q, r.vec_id]) < 1e-9 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        want = np.lexsort((np.arange(len(V)), -np.where(np.arange(len(V)) == q, -np.inf, scores[q])))[:20]
        hit, total = hit + len(set(want) & {r.vec_id for r in mine}), total + 20
    assert hit / total >= 0.9
    assert {r.query_id for r in got} == set(range(0, len(V), 20)) | {7000}
    assert [(r.vec_id, r.score) for r in got if r.query_id == 7000] == [(7001, 10.0)]  # a length of its own


def test_ivfpq_lengths_and_large_values(spark):
    """Each length is searched by itself, whichever comes first; values whose products overflow are still found."""
    rng = np.random.default_rng(8)
    short, wide = rng.standard_normal((59, 3)), rng.standard_normal((80, 24)) * 1e200
    rows_ = [(0, [1.0, 2.0, 3.0, 4.0])] + [(i + 1, v.tolist()) for i, v in enumerate(wide)] + [(100 + i, v.tolist()) for i, v in enumerate(short)]
    got = ivfpq.nearest_neighbours(spark.createDataFrame(rows_, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 5).collect()
    assert {r.query_id for r in got} == {20, 40, 60, 80, 100, 120, 140}
    unit = wide / 1e200
    hit = 0
    for q in (20, 40, 60, 80):
        mine = [r for r in got if r.query_id == q]
        assert len(mine) == 5 and all(1 <= r.vec_id <= 80 and r.score == float("inf") for r in mine)
        best = np.argsort(-(unit @ unit[q - 1]))
        hit += len({r.vec_id - 1 for r in mine} & set([b for b in best if b != q - 1][:5]))
    assert hit >= 18
    mine = [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 120]
    assert mine == [100 + i for i in np.argsort(-(short @ short[20])) if i != 20][:5]


@pytest.mark.parametrize("k", [3, 60])
def test_ivfpq_depth_follows_k(frame, k):
    got = ivfpq.nearest_neighbours(frame, F.col("vec_id") % 100 == 0, k).collect()
    scores, hit, total = V @ V.T, 0, 0
    for q in range(0, len(V), 100):
        want = [j for j in np.lexsort((np.arange(len(V)), -scores[q])) if j != q][:k]
        hit, total = hit + len(set(want) & {r.vec_id for r in got if r.query_id == q}), total + k
    assert hit / total >= 0.9


def test_an_id_with_several_vectors(spark):
    rows_ = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 2.0]), (4, None), (4, [-1.0, 0.0])]
    got = sorted(map(tuple, lattice.near_vectors(spark.createDataFrame(rows_, "vec_id long, embedding array<double>")).collect()))
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True), (4, 0, 4, True)]
    found = ivfpq.nearest_neighbours(spark.createDataFrame(rows_, "vec_id long, embedding array<double>"), F.col("vec_id") == 4, 2).collect()
    assert [(r.vec_id, r.rank) for r in found] == [(2, 1), (3, 2)]


@pytest.mark.parametrize("n", [1_000_000, 100_000_000])
def test_lattice_with_other_settings(frame, n):
    got = {r.vec_id: r for r in lattice.near_vectors(frame, settings=lattice.parameters(n)).collect()}
    links, _ = brute()
    mine = np.array([got[i].n_links for i in range(len(V))])
    assert (mine <= links).all() and mine.sum() >= 0.995 * links.sum()


def test_few_candidates(spark):
    frame = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(6)], "vec_id long, embedding array<double>")
    got = ivfpq.nearest_neighbours(frame, F.col("vec_id") % 2 == 0, 20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got if r.query_id == 0] == [(0, 5), (0, 4), (0, 3), (0, 2), (0, 1)]
    assert len(got) == 15


def test_empty(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert lattice.near_vectors(frame).count() == 0
    assert ivfpq.nearest_neighbours(frame, F.col("vec_id") % 20 == 0).count() == 0
