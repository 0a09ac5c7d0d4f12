import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from iterix.llm import segmentations as S
from iterix.session import ship

MODEL = "piece_bpe_32k.model"
CFG = S.SegmentationConfig()


@pytest.fixture(scope="module")
def v():
    return S.vocabulary(MODEL)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))


def every(text, v, cfg=CFG):
    """All segmentations of a text with their probabilities, by enumeration."""
    ids = {s.decode(): i for i, s in enumerate(v.surface) if i >= 259 and s}
    s, out = S.normalise(text), {}

    def go(at, found, w):
        if at == len(s):
            out[tuple(found)] = w
            return
        for to in range(at + 1, len(s) + 1):
            if s[at:to] in ids:
                go(to, found + [ids[s[at:to]]], w * (1 + v.rank[ids[s[at:to]]]) ** -cfg.alpha)
        if s[at] not in ids:
            go(at + 1, found + [int(v.byte_id[b]) for b in s[at].encode()], w * (1 + cfg.unknown_rank) ** -cfg.alpha)

    go(0, [], 1.0)
    total = sum(out.values())
    return {k: w / total for k, w in out.items()}


def run(texts, v, cfg=CFG, keys=None):
    keys = S.row_keys(pa.array(range(len(texts)), pa.int64()), cfg.seed) if keys is None else keys
    out = [[] for _ in texts]
    for rank, s, ids, n in S.Sampler(v, cfg).samples(texts, keys):
        end = np.cumsum(n)
        for k, t in enumerate(s.text):
            out[t].append((tuple(ids[end[k] - n[k] : end[k]].tolist()), s.log_prob[k], s.inclusion[k]))
    return out


@pytest.mark.parametrize("text", ["cat", "the cat", "a  b", "né\n", "日 x", "12.5"])
def test_all_segmentations_with_exact_probabilities(v, text):
    truth = every(text, v)
    found = run([text], v, S.SegmentationConfig(samples=len(truth) + 3))[0]
    assert {x[0] for x in found} == set(truth) and len(found) == len(truth)
    assert sum(truth.values()) == pytest.approx(1)
    for ids, log_prob, inclusion in found:
        assert log_prob == pytest.approx(math.log(truth[ids]))
        assert inclusion == 1


def test_samples_follow_the_distribution_and_inclusion_scores_are_unbiased(v):
    text, cfg, n = "the cat", S.SegmentationConfig(samples=3, alpha=0.3), 6000
    truth = every(text, v, cfg)
    found = run([text] * n, v, cfg)
    first, weight = {}, {}
    for samples in found:
        assert len({x[0] for x in samples}) == 3
        first[samples[0][0]] = first.get(samples[0][0], 0) + 1
        for ids, _, inclusion in samples:
            weight[ids] = weight.get(ids, 0) + 1 / inclusion
    for ids, p in sorted(truth.items(), key=lambda x: -x[1])[:5]:
        assert first.get(ids, 0) / n == pytest.approx(p, abs=4 * math.sqrt(p / n))
        assert weight.get(ids, 0) / n == pytest.approx(1, abs=0.25)
    # without replacement: the second sample given the first
    top = max(truth, key=truth.get)
    second = [s[1][0] for s in found if s[0][0] == top]
    for ids, p in sorted(truth.items(), key=lambda x: -x[1])[1:4]:
        q = p / (1 - truth[top])
        assert second.count(ids) / len(second) == pytest.approx(q, abs=4 * math.sqrt(q / len(second)))


def test_round_trip_with_the_library(v, library):
    texts = ["Hello world, a test.", " two  spaces ", "tab\tline\nend", "naïve 日本 🙂", "▁", "x" * 5000, "<s> </s> <0x41>", "a\x00b"]
    for text, samples in zip(texts, run(texts, v)):
        assert library.normalize(text) == S.normalise(text)
        assert len(samples) == min(4, len(samples)) > 0
        for ids, _, _ in samples:
            assert v.decode(ids) == S.normalise(text).replace(S.SPACE, " ")[1:] == library.decode(list(ids))
        assert v.decode(library.encode(text)) == library.decode(library.encode(text))


def test_same_samples_in_any_batch(v):
    texts = ["one two three", "four five", "", None, "one two three"]
    keys = S.row_keys(pa.array([7, 8, 9, None, 7], pa.int64()), 1)
    whole = run(texts, v, keys=keys)
    assert whole[0] == whole[4] and whole[2] == whole[3] == [((), 0.0, 1.0)]
    for k, t in enumerate(texts):
        assert [x[0] for x in run([t], v, keys=keys[k : k + 1])[0]] == [x[0] for x in whole[k]]


def test_query_columns_and_edge_rows(spark):
    rows = [(1, "a cat sat", "x"), (1, "a cat sat", "x"), (2, None, "y"), (3, "", None), (None, "word", "z"), (4, "long " * 30000, "z")]
    docs = ship(spark).createDataFrame(rows, "doc_id long, text string, sample string")
    ids = {(r.doc_id, r.sample, tuple(r.ids)) for r in S.sample_segmentations(docs).collect()}
    digests = S.segmentation_digests(docs).collect()
    assert all(r.round_trip for r in digests)
    assert {(r.doc_id, r.sample, r.n_tokens, r.ids_crc32) for r in digests} == {(d, s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, s, i in ids}
    assert len(digests) == 4 * 4 + 2
    back = S.decode(S.sample_segmentations(docs)).collect()
    assert {r.text for r in back if r.doc_id == 1} == {"a cat sat"} and {r.text for r in back if r.doc_id in (2, 3)} == {""}
    assert S.segmentation_digests(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.decode(S.sample_segmentations(docs).withColumnRenamed("sample", "text"))
    assert {r.found for r in S.decode(S.sample_segmentations(docs).withColumnRenamed("sample", "text"), column="found").collect() if r.doc_id == 1} == {"a cat sat"}
    assert list(itertools.islice(S._runs(["a" * 10, "b" * 10, None], 12), 5)) == [(0, 1), (1, 3)]


def test_masses_are_noted_only_where_they_count(v, monkeypatch):
    texts = ["the cat sat on the mat. " * 300 + "end", "日" * 900 + " cat", "日" * 900, "cat", None]

    def search(ahead):
        monkeypatch.setattr(S.Search, "AHEAD", ahead)
        sampler = S.Sampler(v, CFG)
        words, counts = sampler._words(texts)
        found = S.Search(sampler.lattice, words, counts, S.row_keys(pa.array(range(len(texts)), pa.int64()), CFG.seed), CFG.samples)
        return found, found.run()

    short, got = search(S.Search.AHEAD)
    assert short.size[:, 0].min() > 1000 and (short.noted - short.own)[:, 0].max() <= S.Search.AHEAD
    assert [sum(t in s.text for s in got) for t in range(len(texts))] == [4, 4, 1, 4, 1]  # choices come after 900 steps without one
    for ahead in (1, 1 << 30):
        for a, b in zip(got, search(ahead)[1], strict=True):
            assert a.text.tolist() == b.text.tolist() and a.edges.tolist() == b.edges.tolist()
            assert a.log_prob == pytest.approx(b.log_prob) and a.inclusion == pytest.approx(b.inclusion)


def test_bounds_of_keys_follow_the_probabilities(v):
    lattice = S.Lattice(v, CFG)
    lattice.add([S.SPACE + "nation", "日", S.SPACE])
    lattice.add([S.SPACE + "the"])
    for begin, degree in zip(lattice.begin[: lattice.size[1]], lattice.degree[: lattice.size[1]]):
        edges = range(begin, begin + degree)
        share = np.cumsum(np.exp(lattice.logp[edges]))
        assert [b / 2**64 for b in lattice.step["bound"][edges].tolist()] == pytest.approx(share.tolist(), abs=1e-12)
        assert not degree or int(lattice.step["bound"][begin + degree - 1]) == 2**64 - 1
    u = np.arange(1, 2000, dtype=np.uint64) * np.uint64((2**64 - 1) // 2000) | np.uint64(1)
    first = int(lattice.first[0])
    n, edges = lattice.walk(np.full(len(u), first), u)
    p = np.exp(lattice.logp[first : first + lattice.degree[lattice.start[first]]])
    taken = np.bincount(edges[np.cumsum(n) - n] - first, minlength=len(p)) / len(u)
    assert taken.tolist() == pytest.approx(p.tolist(), abs=1e-3)


def test_trie_and_pieces_of_any_length(v):
    pieces = {s.decode(): i for i, s in enumerate(v.surface) if i >= 259 and s}
    starts = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
    words = [w for w in list(pieces)[::97]] + ["zzq", "日a", "a日", "éa"]
    letters = lambda w: v.letter[[ord(c) for c in w]].astype(np.int64)
    for word in words:
        node, before = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level in range(len(word)):
            now = letters(word)[level : level + 1]
            node, before = v.below(level, node, now, before), now
            assert bool(node[0]) == (word[: level + 1] in starts)
            if not node[0]:
                break
            assert v.final[node[0]] == pieces.get(word[: level + 1], -1)
    ids, texts = np.array([pieces[S.SPACE + "characteristics"], pieces["a"]]), ["characteristicsa", "characteristic a", "characteristicsb"]
    assert v.spells(np.tile(ids, 3), np.full(3, 2), v.targets(texts), np.arange(3)).tolist() == [True, False, False]
