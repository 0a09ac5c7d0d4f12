import random

import pytest
import test_models as M
from test_near_dup import brute

import corpus_pipeline as P
from iterix.llm import language_id, quality
from iterix.session import ship


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents in two languages, good and bad ones, copies, and texts without a letter."""
    g = random.Random(9)
    docs, labels = [], []
    for k in range(500):
        good, lang = g.random() < 0.8, g.choice(["aa", "bb"])
        words = [M.speak(g, lang, 1) for _ in range(g.randint(30, 90))]
        if not good:
            words = [w + "###" if g.random() < 0.6 else w.upper() for w in words]
        docs.append((k, " ".join(words), lang, f"src{k % 3}", 1))
        if g.random() < 0.6:
            labels.append((k, int(good), 0))
    good = [d for d in docs if "###" not in d[1]]
    docs += [(1000 + k, good[k % 7][1], good[k % 7][2], "src0", 1) for k in range(60)]
    docs += [(2000 + k, " ".join([*good[8][1].split()[:-1], f"kato{'x' * (k % 3)}"]), good[8][2], "src1", 1) for k in range(30)]
    docs += [(3000, None, None, None, None), (3001, "", "aa", "src1", 0)]
    top = tmp_path_factory.mktemp("tables")
    docs_df = ship(spark).createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    docs_df.repartition(4).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top), docs, labels


def test_stages_and_run(spark, folder):
    """Each stage against its operator's decisions on plain rows."""
    top, rows, labels = folder
    assert [n for n, _ in P.STAGES] == ["quality", "language", "near_dup", "packing"]
    docs = spark.read.parquet(f"{top}/documents.parquet")
    state = {r[0]: r for r in rows}
    out = P.by_quality(spark, docs, top)
    assert out.columns == docs.columns
    model = quality.fit(docs, spark.read.parquet(f"{top}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}
    assert {r.doc_id: tuple(r) for r in out.collect()} == {k: state[k] for k in good}
    marked = dict((k, q) for k, q, _ in labels)
    assert all(marked[k] for k in good if k in marked) and all(k in good for k, q in marked.items() if q)

    second = P.by_language(spark, out, top)
    assert second.columns == docs.columns
    lang = language_id.fit(out.where(~language_id.held_out(4, 2)))
    want = {k for k, (p, s) in zip(sorted(good), lang.predict([state[k][1] for k in sorted(good)])) if p != "und" and s >= 0.5}
    assert {r.doc_id for r in second.collect()} == want

    third = P.one_of_each(spark, second, top)
    classes = brute([(k, state[k][1]) for k in sorted(want)])
    stay = {k for k, c in classes.items() if k == c}
    assert len(stay) < len(want) - 50
    assert {r.doc_id: tuple(r) for r in third.collect()} == {k: state[k] for k in stay}

    pieces = P.run(spark, top).collect()
    assert {r.doc_id for r in pieces} == stay
    lengths = {}
    for r in pieces:
        lengths.setdefault(r.doc_id, [0, r.doc_tokens])[0] += r.length
    assert all(a == b for a, b in lengths.values())


def test_empty_table(spark, folder):
    top, _, _ = folder
    docs = spark.read.parquet(f"{top}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, docs, top)
        assert out.count() == 0
