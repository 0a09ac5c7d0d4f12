import gc
import pickle
import random
import re
import tracemalloc
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest

from iterix.llm import _bpe, _links
from iterix.llm import language_id as L
from iterix.llm import quality as Q
from iterix.session import ship

VOICES = {"aa": "kato mili runa sevo tapi lomu", "bb": "strag bront klemf zwurt plisk drong", "cc": "ouelle jaieux beaure fleuti moisne"}


def speak(g, lang, n):
    words = VOICES[lang].split()
    return " ".join(g.choice(words) + g.choice(["", "", g.choice(words)[-3:]]) for _ in range(n))


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def spoken(n=400, seed=1):
    g = random.Random(seed)
    return [(k, speak(g, lang := g.choice(list(VOICES)), g.randint(1, 40)), lang if g.random() < 0.8 else None, "s", 0.5) for k in range(n)], g


DOCS = "doc_id long, text string, lang string, source string, score double"


def test_languages_of_held_out_texts(spark):
    rows, _ = spoken()
    docs = ship(spark).createDataFrame(rows, DOCS)
    model = L.fit(docs.where(~L.held_out(4, 2)))
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    assert all(got[k].held_out == (fold(k, 4) == 2) and 0 <= got[k].score <= 1 for k, *_ in rows)
    held = [(k, lang) for k, _, lang, *_ in rows if lang and got[k].held_out]
    assert len(held) > 40 and np.mean([got[k].lang_pred == lang for k, lang in held]) > 0.97


def test_backoff():
    model = L.fit_rows([(lang, text) for lang, text in VOICES.items()] * 2)
    (lang, _), (sure, share) = model.predict(["zwurtplisk", "strag bront"])
    assert lang == "bb" and sure == "bb" and share > 0.5
    assert model.word_scores("kato") == model.words["kato"]
    unseen = model.word_scores("katomil")
    order = 5
    found = [model.grams[order][g] for g in ("<kato",) if g in model.grams[order]]
    assert found and np.argmax(unseen) == model.languages.index("aa")
    assert max(map(abs, model.word_scores("ωω"))) < 0.2  # only its ends are known


def test_language_edge_rows(spark):
    rows, _ = spoken()
    odd = [(1000, None, "aa", None, None), (1001, "", None, None, None), (1002, "123 !!!", "aa", None, None), (1003, "kato " * 50000, None, None, None), (None, "strag bront", None, None, None), (1004, "ωω", None, None, None)]
    docs = ship(spark).createDataFrame(rows + odd + odd[3:4], DOCS)
    model = L.fit(docs.where(~L.held_out(4, 2)))
    got = [r for r in L.identify(docs, model).collect() if r.doc_id is None or r.doc_id >= 1000]
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == [("1000", "und"), ("1001", "und"), ("1002", "und"), ("1003", "aa"), ("1003", "aa"), ("1004", "aa"), ("None", "bb")]
    kept = L.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id and r.doc_id >= 1000} == {1003}
    none = L.fit(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in L.identify(docs, none).collect()} == {("und", 0.0)}
    assert L.identify(docs.limit(0), model).count() == 0


def written(n=600, seed=2):
    """Documents whose form tells their quality, with labels for half of them."""
    g = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        good = g.random() < 0.8
        words = [speak(g, "aa", 1) for _ in range(g.randint(20, 120))]
        if not good:
            words = [w + "###" if g.random() < 0.5 else w.upper() for w in words]
        docs.append((k, " ".join(words), "aa", "s", 0.5))
        if g.random() < 0.5:
            labels.append((k, int(good), 0))
    return docs, labels, g


LABELS = "doc_id long, quality int, toxic int"


def test_texts_in_no_language_are_not_accepted(spark):
    g = random.Random(7)
    vocabulary = {lang: ["".join(g.choice(letters) for _ in range(g.randint(3, 7))) for _ in range(80)] for lang, letters in (("aa", "abcdeo"), ("bb", "mnopqu"))}
    say = lambda lang, n: " ".join(g.choice(vocabulary[lang]) for _ in range(n))
    noise = lambda n: " ".join("".join(g.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(g.randint(4, 9))) for _ in range(n))
    model = L.fit_rows([(lang, say(lang, 40)) for lang in vocabulary for _ in range(50)])
    good = [say(lang, n) for lang in vocabulary for n in (3, 20, 200)] + [say("aa", 20) + " " + noise(10), vocabulary["aa"][0] + " zyxwv"]
    bad = [noise(n) for n in (20, 50, 200)]
    assert all(score >= 0.5 for _, score in model.predict(good + bad))  # the score alone tells nothing
    df = ship(spark).createDataFrame([(t,) for t in good + bad + ["", "12 34", None]], "text string")
    assert sorted(r.text for r in L.accepted(df, model).collect()) == sorted(good)
    one = L.fit_rows([("aa", "only only one one"), ("bb", "und und noch noch")])  # nothing to measure what is usual
    assert one.accepts(["only words unheard of in this"], 0.0) == [True]


def test_model_counts_and_predictions_are_the_plain_ones(spark):
    """fit() against fit_rows() on all rows, and predict() against the formula."""
    rows, g = spoken(300, 3)
    docs = ship(spark).createDataFrame(rows + rows[:40], DOCS)  # repeated rows count once
    model, plain = L.fit(docs), L.fit_rows([(lang, text) for _, text, lang, *_ in rows if lang])
    assert model.languages == plain.languages and model.known == plain.known and model.usual == pytest.approx(plain.usual)
    many = L.fit(docs, L.LanguageConfig(few_languages=0))  # sizes by salted keys
    assert (many.words, many.grams, many.usual) == (model.words, model.grams, model.usual)
    for found, want in [(model.words, plain.words), *((model.grams[o], plain.grams[o]) for o in model.orders)]:
        assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in found)
    assert sum(map(len, plain.known)) > 0 and all(len(c) > 20 for c in plain.grams.values())
    for text in [speak(g, "aa", 5), "zwurtplisk", "kato zz ü", "strag " * 100, "mili ouelle bront"]:
        words = re.findall(r"[a-zü]+", text.lower())
        total = [0.0] * len(model.languages)
        for w in words:
            scores = model.words.get(w)
            for order in model.orders:
                if scores is None:
                    hits = [model.grams[order][x] for k in range(len(w) + 3 - order) if (x := f"<{w}>"[k : k + order]) in model.grams[order]]
                    scores = tuple(sum(c) / len(hits) for c in zip(*hits)) if hits else None
            total = [a + b for a, b in zip(total, scores or (0.0,) * len(total))]
        e = np.exp(np.array(total) / len(words) * min(len(words), 12))
        lang, score = model.predict([text])[0]
        assert lang == model.languages[int(np.argmax(e))] and score == pytest.approx(e.max() / e.sum())


def test_numerals_are_no_letters():
    model = L.fit_rows([(lang, text) for lang, text in VOICES.items()] * 2)
    assert [lang for lang, _ in model.predict(["½ ²", "① Ⅻ ³", "12_3 !", "½kato"])] == ["und", "und", "und", "aa"]


def test_no_size_is_set():
    """All words seen twice are in the model, however many there are."""
    g = random.Random(2)
    words = ["".join(g.choice("abcdefghij") for _ in range(9)) for _ in range(50_000)]
    model = L.fit_rows([("aa", " ".join(words)), ("aa", " ".join(words)), ("bb", "und noch einer")])
    assert set(words) == model.words.keys()


def test_filters_hold_a_bounded_run_of_texts(spark):
    """A worker judges about 1 MB at once, however large the batch, and drops what encoders it has; each row is judged."""
    texts = [f"{k} " + "x" * 3000 for k in range(3000)] + [None, "", "y" * 3_000_000, None, "z"]
    ship(spark)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)

    def keep(column):
        found = [t or "" for t in column.to_pylist()]
        fits = (len(found) == 1 or sum(map(len, found)) <= 1 << 20) and not _bpe._encoders
        return [fits and not t.startswith("7") for t in found]

    want = [k for k, t in enumerate(texts) if not (t or "").startswith("7")]
    for df in (rows, rows.withColumnRenamed("text", "TEXT"), rows.selectExpr("doc_id", "cast(text as binary) as text")):
        out = _links.kept_rows(df, keep)
        assert out.schema == df.schema and [r.doc_id for r in out.select("doc_id").collect()] == want
    assert _links.kept_rows(rows.limit(0), keep).count() == 0


def test_encoders_are_released():
    made = _bpe.Encoder.__new__(_bpe.Encoder)
    made.table = _bpe.Table(made.encode)  # a cycle, as in a whole one
    gone, before = weakref.ref(made), dict(_bpe._encoders)
    _bpe._encoders["some", "byte"] = made
    del made
    _bpe.release()
    assert not _bpe._encoders and gone() is None
    _bpe._encoders.update(before)


def test_a_model_is_small_and_goes_with_its_task():
    g = random.Random(2)
    words = ["".join(g.choice("abcdefghij") for _ in range(9)) for _ in range(20_000)]
    whole = L.fit_rows([(lang, " ".join(words)) for lang in ("aa", "bb", "cc", "dd") for _ in range(2)])
    keys = len(whole.words) + sum(map(len, whole.grams.values()))
    sent = pickle.dumps(whole)
    gc.collect()
    gc.disable()
    try:
        tracemalloc.start()
        model = pickle.loads(sent)
        assert tracemalloc.get_traced_memory()[0] / keys < 300
        assert model.predict([words[0] + " unheard"]) == whole.predict([words[0] + " unheard"])
        gone = weakref.ref(model)
        del model
        assert gone() is None
    finally:
        tracemalloc.stop()
        gc.enable()


def test_scores_do_not_depend_on_what_is_held(monkeypatch):
    rows, g = spoken(200, 5)
    model = L.fit_rows([(lang, text) for _, text, lang, *_ in rows if lang])
    texts = [text for _, text, *_ in rows] + [speak(g, "aa", 3) + f" neu{k * 'e'} strag" for k in range(40)]
    want = [(model.predict([t])[0], model.accepts([t], 0.5)[0]) for t in texts]
    monkeypatch.setattr(L, "_SEEN_LIMIT", 3)
    assert [(x, y) for x, y in zip(model.predict(texts), model.accepts(texts, 0.5))] == want


def test_quality_of_held_out_texts(spark):
    rows, known, _ = written()
    docs, labels = ship(spark).createDataFrame(rows, DOCS), spark.createDataFrame(known, LABELS)
    model = Q.fit(docs, labels)
    got = {r.doc_id: r for r in Q.score(docs, model).collect()}
    assert all(got[k].held_out == (fold(k, 5) == 0) and 0 <= got[k].score <= 1 and got[k].predicted == int(got[k].score >= 0.3) for k, *_ in rows)
    held = [(got[k].predicted, q) for k, q, _ in known if got[k].held_out]
    assert len(held) > 30 and np.mean([p == q for p, q in held]) > 0.95
    kept = Q.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.predicted}


def test_positive_unlabelled_risk_beats_treating_unlabelled_as_negative():
    g = np.random.default_rng(4)
    pos = g.normal(1, 1, (2000, Q.N_FEATURES))
    neg = g.normal(-1, 1, (2000, Q.N_FEATURES))
    unlabelled = np.concatenate([pos[:800], neg[:200]])
    model = Q.train(pos[1000:1400], unlabelled, 0.8)
    assert (model.score(pos[1400:]) >= 0.5).mean() > 0.95 and (model.score(neg[200:]) < 0.5).mean() > 0.9


def test_quality_edge_rows(spark):
    rows, known, _ = written(200)
    odd = [(1000, None, "aa", None, None), (1001, "", None, None, None), (1002, "mili " * 50000, None, None, None), (None, "kato mili", None, None, None), (1003, "日本", None, None, None)]
    docs = ship(spark).createDataFrame(rows + odd + odd[2:3], DOCS)
    labels = spark.createDataFrame(known + [(None, 1, 0), (5, None, None), (7, 3, 0), *known[:3]], LABELS)
    got = Q.score(docs, Q.fit(docs, labels)).collect()
    assert len(got) == len(rows) + 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1000, 1001)}) == 1
    assert Q.score(docs.limit(0), Q.fit(docs.limit(0), labels)).count() == 0
    assert {r.score for r in Q.score(docs, Q.fit(docs, labels.where("quality = 0"))).collect()} == {Q.QualityConfig().default_prior}
    # neither labels 0 nor ids with both labels have a part in the fit, nor has the order of rows
    labels = labels.where("quality in (0, 1)")
    model = Q.fit(docs, labels)
    for other in (labels.where("quality = 1"), labels.where("quality = 1").repartition(3).union(labels.where("quality = 0"))):
        assert Q.fit(docs.repartition(5), other).layers[0][0] == pytest.approx(model.layers[0][0], abs=1e-9)
    both = labels.union(labels.where("quality = 0").selectExpr("doc_id", "1", "toxic"))
    assert Q.fit(docs, both).layers[0][0] == pytest.approx(model.layers[0][0], abs=1e-9)


def test_statistics_do_not_depend_on_the_batch():
    texts = [t for _, t, *_ in written(40)[0]] + ["", "a", "A!|B " * 300]
    whole = Q.batch_statistics(pa.array(texts))
    assert whole.shape == (43, Q.N_FEATURES)
    for k, t in enumerate(texts):
        assert Q.batch_statistics(pa.array([t]))[0] == pytest.approx(whole[k], abs=1e-12)


def plain_statistics(text):
    words = re.findall(r"[^ \t-\r]+", text)
    raw, w = text.encode(), max(len(words), 1)
    b = max(len(raw), 1)
    count = lambda chars: sum(raw.count(c) for c in chars.encode())
    symbols, letters = "#*$%&<>@^~=+_{}[]\\/", lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    again, follows = len(words) - len(set(words)), sum(x == y for x, y in zip(words, words[1:]))
    threes = list(zip(words, words[1:], words[2:]))
    same = len(threes) - len(set(threes))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    loud = sum(65 <= x <= 90 and 65 <= y <= 90 for x, y in zip(raw, raw[1:]))
    tail = sum(letters(x) and chr(y) in symbols for x, y in zip(raw, raw[1:]))
    high, space = sum(c >= 128 for c in raw), sum(c in b" \t\n\x0b\x0c\r" for c in raw)
    out = [
        np.log1p(len(words)) / 10, count(symbols) / w, count(upper) / b * 10, count(upper.lower()) / b, count("0123456789") / b * 10, count("!") / w, count("|") / w, high / b, tail / w, loud / w, count(".,") / w,
        again / w, follows / w, same / w, count("\n") / w * 10, (b - space) / w / 10, follows**0.5 / 10, same**0.5 / 10, (count("!") + count("|") + count(symbols)) ** 0.5 / 10,
    ]
    return np.minimum(out, 10) if raw else np.zeros(Q.N_FEATURES)


def test_statistics_are_the_plain_ones():
    texts = [t for _, t, *_ in written(40)[0]] + ["", "a", "A!|B " * 300, "one\ntwo\n\n#tag naïve 12 | x | y", "same same same same", " \t"]
    for found, text in zip(Q.batch_statistics(pa.array(texts)), texts):
        assert found == pytest.approx(plain_statistics(text), abs=1e-9), text


def test_prior_without_negatives():
    g = np.random.default_rng(5)
    for share in (0.3, 0.6, 0.9):
        pos = g.normal(1, 1, (3000, Q.N_FEATURES))
        n = int(2000 * share)
        unlabelled = g.permutation(np.concatenate([g.normal(1, 1, (n, Q.N_FEATURES)), g.normal(-1, 1, (2000 - n, Q.N_FEATURES))]))
        assert Q.estimate_prior(pos, unlabelled) == pytest.approx(share, abs=0.08)
