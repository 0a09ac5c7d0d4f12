import numpy as np
import pytest

from iterix.llm import vector_dup as V
from iterix.session import ship

CFG = V.VectorDupConfig()


def truth(rows):
    """Links and components by all pairs, in double precision."""
    ok = [(i, np.array(x, float)) for i, x in rows if i is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    links = {i: 0 for i, _ in rows}
    parent = {i: i for i, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    seen = {(i, x.tobytes()): (i, x) for i, x in ok}
    ok = list(seen.values())
    for k, (i, x) in enumerate(ok):
        for j, y in ok[:k]:
            if len(x) == len(y) and i != j and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (links[i], find(i)) for i in links}


def planted(g, d=64):
    rows, k = [], 0
    for size, noise in [(1, 0.0)] * 200 + [(2, 0.02), (3, 0.03), (5, 0.035), (40, 0.02), (300, 0.02), (30, 0.0)]:
        centre = g.standard_normal(d)
        for _ in range(size):
            rows.append((k, (centre / np.linalg.norm(centre) + noise * g.standard_normal(d)).astype(np.float32).astype(float).tolist()))
            k += 1
    g.shuffle(rows)
    return [(int(i), x) for i, x in rows]


@pytest.mark.parametrize("slice_vectors", [2048, 50])
def test_against_all_pairs(spark, slice_vectors):
    rows = planted(np.random.default_rng(1))
    df = ship(spark).createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in V.near_vectors(df, V.VectorDupConfig(slice_vectors=slice_vectors)).collect()}
    want = truth(rows)
    whole = sum(n for n, _ in want.values())
    assert all(got[i][0] <= n for i, (n, _) in want.items())  # none below the threshold
    assert sum(n for n, _ in got.values()) >= 0.98 * whole
    assert sum(got[i][1] == c for i, (_, c) in want.items()) >= 0.99 * len(want)


def test_dense_buckets_without_pairs(spark):
    """The same links, whether pairs are emitted or vectors come to the bucket."""
    rows = planted(np.random.default_rng(4))
    df = ship(spark).createDataFrame(rows, "vec_id long, embedding array<float>")
    found = [sorted(tuple(r) for r in V.near_vectors(df, V.VectorDupConfig(dense=dense)).collect()) for dense in (0, 10**9)]
    assert found[0] == found[1]


def around(x, cosine, g):
    """Unit vectors at given cosines of those of x."""
    y = g.standard_normal(x.shape)
    y = V.unit(y - (y * x).sum(1, keepdims=True) * x)
    return cosine[:, None] * x + np.sqrt(1 - cosine[:, None] ** 2) * y


@pytest.mark.parametrize("n", [2000, 12000])
def test_recall_of_planted_pairs(spark, n):
    """Pairs between 0.93 and 0.97 in a table of their own: at the size of the table, its bits and bands."""
    g = np.random.default_rng(n)
    x = V.unit(g.standard_normal((n, 64)))
    cosine = g.uniform(0.93, 0.97, n)
    rows = [(2 * k, v.tolist()) for k, v in enumerate(x)] + [(2 * k + 1, v.tolist()) for k, v in enumerate(around(x, cosine, g))]
    df = ship(spark).createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in V.near_vectors(df).collect()}
    above = np.flatnonzero(cosine >= 0.95 + 1e-12)
    assert all(got[2 * k] == got[2 * k + 1] == (0, 2 * k) or got[2 * k + 1][0] == 0 for k in np.flatnonzero(cosine < 0.95 - 1e-12))
    assert np.mean([got[2 * k] == (1, 2 * k) == got[2 * k + 1] for k in above]) > 0.985


def test_recall_at_the_threshold_is_the_same_at_every_size():
    g = np.random.default_rng(2)
    x = V.unit(g.standard_normal((2000, 64)))
    near = around(x, np.full(2000, 0.9501), g)
    for size in (1000, 10**5, 10**7):
        of = V.shape(size, CFG)
        a, b = (V.band_keys(V.encode(v, of, CFG)[0], of) for v in (x, near))
        assert (a == b).any(1).mean() > 0.98
        other = V.band_keys(V.encode(V.unit(g.standard_normal((2000, 64))), of, CFG)[0], of)
        assert (a == other).sum() * size / 2000 < 4 * of.bands * 2000  # chance meetings of a vector in a band


def test_estimates_are_unbiased_and_bounds_hold():
    g = np.random.default_rng(3)
    of = V.shape(1000, CFG)
    x = V.unit(g.standard_normal((700, 64)))
    signs, factor, turned, scale = V.encode(x, of, CFG)
    code = np.unpackbits(signs, axis=1, count=64).astype(np.float32) * 2 - 1
    estimate = (turned * scale[:, None])[500:] @ (code[:500] / 8 / factor[:500, None]).T
    error = estimate - x[500:] @ x[:500].T
    assert abs(error.mean()) < 0.005
    bound = CFG.confidence * np.sqrt((1 - factor**2) / factor**2 / 63)
    assert (np.abs(error) <= bound[:500] + 4 * scale[500:, None] / factor[:500]).mean() > 0.995
    one = np.concatenate([V.encode(v[None], of, CFG)[0] for v in x])
    assert (one == signs).all()


def test_pairs_of_units():
    """Small and large units, one slice and two: the pairs of the bound, written out."""
    g = np.random.default_rng(6)
    of, sizes = V.shape(1000, CFG), [1, 5, 64, 65, 600, 2]
    start = np.cumsum([0, *sizes[:-1]])
    n = sum(sizes)
    x = V.unit(g.standard_normal((n, 16)) + 3 * g.standard_normal((1, 16)))
    signs, factor, turned, scale = V.encode(x, of, CFG)
    code = np.unpackbits(signs, axis=1, count=16).astype(np.float32) * 2 - 1
    side, two = g.random(n) < 0.5, np.array([False, True, True, False, True, False])
    i, j = V.hopeful(code, factor, turned, scale, start, side, two, CFG)
    own, error = turned * scale[:, None], 3 * np.sqrt((1 - factor**2) / factor**2 / 15)
    want = set()
    for u, (lo, m) in enumerate(zip(start, sizes)):
        for a in range(lo, lo + m):
            for b in range(a + 1, lo + m):
                if (not two[u] or side[a] != side[b]) and own[a] @ code[b] / 4 / factor[b] + error[b] + 2 * scale[a] / factor[b] >= 0.95:
                    want.add((a, b))
    assert len(want) > 50 and len(set(zip(i.tolist(), j.tolist())) ^ want) <= 2  # but for rounding at the threshold


def test_edge_rows(spark):
    v, w = [1.0] + [0.0] * 7, [0.0, 1.0] + [0.0] * 6
    rows = [
        (1, v, "a"), (1, v, "a"), (2, [2.0] + [0.0] * 7, "b"), (3, w, "c"), (4, None, "d"), (5, [], "e"), (6, [0.0] * 8, "f"),
        (7, [None] + v[1:], "g"), (8, [float("nan")] * 8, "h"), (9, [float("inf")] + v[1:], "i"), (None, v, "j"), (10, [1.0, 0.0], "k"), (11, w, None), (12, [1e-40] + [0.0] * 7, "l"),
    ]
    df = ship(spark).createDataFrame(rows, "vec_id long, embedding array<double>, node string")
    got = sorted((tuple(r) for r in V.near_vectors(df).collect()), key=str)
    want = [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (12, 2, 1, False), (3, 1, 3, True), (11, 1, 3, False), (10, 0, 10, True), (None, 0, None, True)] + [(k, 0, k, True) for k in range(4, 10)]
    assert got == sorted(want, key=str)
    assert V.near_vectors(df.limit(0)).count() == 0
