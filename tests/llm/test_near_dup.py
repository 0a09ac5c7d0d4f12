import random

import numpy as np
import pyarrow as pa
import pytest

from iterix.llm import _links, _text
from iterix.llm import near_dup as N
from iterix.session import ship

SCHEMA = "doc_id long, text string, class_id string, bucket int"


def corpus(seed=3):
    g = random.Random(seed)
    word = lambda: "".join(g.choice("abcdefghij") for _ in range(g.randint(2, 8)))
    texts = [" ".join(word() for _ in range(g.randint(5, 200))) for _ in range(60)]
    for size, edits in [(2, 1), (3, 2), (40, 1), (80, 2), (5, 12)]:
        base = [word() for _ in range(120)]
        for _ in range(size):
            own = list(base)
            for _ in range(edits):
                own[g.randrange(len(own))] = word()
            texts.append(" ".join(own))
    texts += [texts[0]] * 30 + [texts[70].replace(" ", "\n ")]
    ids = list(range(len(texts)))
    g.shuffle(ids)
    return list(zip(ids, texts))


def brute(rows, cfg=N.NearDupConfig()):
    """Classes by all pairs' weighted similarity, with the operator's own document frequencies."""
    raw, off = _text.utf8(pa.array([t for _, t in rows], pa.string()))
    e, doc = _text.elements(raw, off)
    counts = np.bincount(e & np.uint32(cfg.df_buckets - 1), minlength=cfg.df_buckets)
    factor = N.weights(counts, len(rows))
    sets = [{int(x): float(factor[x & (cfg.df_buckets - 1)]) for x in e[doc == k]} for k in range(len(rows))]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            common = sum(w for x, w in a.items() if x in b)
            if a and b and common >= cfg.threshold * (sum(a.values()) + sum(b.values()) - common) - 1e-9:
                parent[find(i)] = find(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), doc_id), doc_id)
    return {doc_id: least[find(k)] for k, (doc_id, _) in enumerate(rows)}


@pytest.mark.parametrize("slice_docs,elements", [(2048, 2_000_000), (16, 2_000_000), (2048, 3000)])
def test_against_all_pairs(spark, slice_docs, elements):
    rows = corpus()
    df = ship(spark).createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    got = {r.doc_id: r.class_id for r in N.near_duplicates(df, N.NearDupConfig(slice_docs=slice_docs, slice_elements=elements)).collect()}
    want = brute(rows)
    assert len(set(want.values())) < len(rows) - 60
    assert got == want


def test_sampling_estimates_weighted_similarity():
    g = np.random.default_rng(5)
    cfg = N.NearDupConfig(bands=400, rows=1)
    sampler = N.Sampler(cfg)
    for share in (0.5, 0.8, 0.95):
        common, a, b = (g.integers(0, 2**32, n, dtype=np.uint32) for n in (int(400 * share), int(200 * (1 - share)), int(200 * (1 - share))))
        w = lambda e: np.log(1 + 0.5 * ((e >> np.uint32(8)) % 7) / 7).astype(np.float32)
        keys = [sampler.bands(e, w(e), np.array([0]))[0] for e in (np.concatenate([common, a]), np.concatenate([common, b]))]
        mass = lambda e: float(np.exp(w(e)).sum())
        true = mass(common) / (mass(common) + mass(a) + mass(b))
        assert abs((keys[0] == keys[1]).mean() - true) < 0.08


def test_edge_rows(spark):
    long = "word " * 30000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one\ttwo"), (6, "one"), (7, long), (8, long), (9, "a b c d e f g h i j"), (9, "a b c d e f g h i j"), (None, "a b c d e f g h i j"), (10, "b a c d e")]
    df = ship(spark).createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in N.near_duplicates(df).collect()), key=str)
    want = [(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (6, 6, True), (7, 7, True), (8, 7, False), (9, 9, True), (9, 9, True), (None, None, True), (10, 10, True)]
    assert got == sorted(want, key=str)
    assert N.near_duplicates(df.limit(0)).count() == 0
    left = N.one_of_each(df)
    assert left.columns == df.columns and sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(map(str, (1, 2, 3, 4, 6, 7, 9, 10)))


def test_rows_that_stay(spark):
    """By row: equal rows leave one, one id on two texts loses neither, and names of all kinds may be there."""
    rows = [(1, "a b c d e f g", 0), (1, "a b c d e f g", 1), (2, "a b c d e f g", 2), (2, "quite another text here", 3), (None, "no id on this text", 4), (None, "no id on this text", 5), (3, "", 6), (3, None, 7), (None, "a b c d e f g", 8)]
    df = ship(spark).createDataFrame(rows, "doc_id long, text string, gone_id long")
    for c in ("gone_id", "digest", "stays_id", "node", "root", "stays", "a.b"):
        named = df.withColumnRenamed("gone_id", c)
        got = N.one_of_each(named)
        assert got.columns == named.columns
        assert sorted(((str(r[0]), r[1]) for r in got.collect()), key=str) == sorted([("1", rows[0][1]), ("2", rows[3][1]), ("None", rows[4][1]), ("3", ""), ("3", None)], key=str)


def test_work_in_a_unit_of_near_copies_is_linear(monkeypatch):
    """All texts are joined by one leader, and no pair is met through the index."""
    g = np.random.default_rng(3)
    base = g.integers(0, 2**32, 400, dtype=np.uint32)
    factor = np.ones(1 << 16, np.float32)
    asked = []
    like = N._like_leader
    monkeypatch.setattr(N, "_like_leader", lambda leader, flat, *a: asked.append(len(flat)) or like(leader, flat, *a))
    for m in (500, 2000):
        asked.clear()
        sets = [np.sort(np.unique(np.concatenate([base[: 400 - k % 20], g.integers(0, 2**32, k % 20, dtype=np.uint32)]))) for k in range(m)]
        links = N.verified(np.arange(m), sets, np.zeros(m, bool), factor, 0.8)
        assert len(links) == m - 1 and {b for _, b in links} == set(range(1, m)) and len(asked) <= 8 and sum(asked) <= 8 * 400 * m


def test_components(spark):
    g = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(g.randrange(1000, 1100), g.randrange(1000, 1100)) for _ in range(60)] + [(7, 7)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.root for r in _links.components(ship(spark).createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent if n in got} and {a for e in edges for a in e if e[0] != e[1]} <= set(got)
