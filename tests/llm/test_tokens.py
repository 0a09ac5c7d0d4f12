import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from iterix.llm import _bpe, packing, token_counts, token_files
from iterix.llm._links import table_path
from iterix.session import ship

SCHEMA = "doc_id long, text string, n_tokens string, start int"
ODD = [
    None, "", " ", "\n\n  \t", "Hello world, it's 12 o'clock.", "  two  spaces ", "naïve café ²½ ÀÉ", "日本語 and <|endoftext|> mixed", "<|startoftext|>", "'s 's's' '", "a\nb\r\nc", "🙂" * 50, "x" * 5000,
    "DON'T I'LL we'VE", "\u0085  space", "á ẞ", "5 5 55 5\n\n5", "\x00\x01", "word " * 20000, "|<>|", "\n", "5",
]


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def table(spark, texts=ODD):
    return ship(spark).createDataFrame([(k // 2 if k else None, t, "x", 1) for k, t in enumerate(texts)], SCHEMA)


def ids(t, text):
    return t.encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


WORDS = list(" \n\t  ab'sé½ß字。\u3000\xa0\x85\x1c éΣσ5\r\x0b💥İ'“”-12.,") + ["<|endoftext|>", "<|startoftext|>", " the", " foo", "\n    return", "'ll", " hello", "  ", ", ", ". "]


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_encoder_is_the_library(name, kind, monkeypatch):
    import public_tokenizers

    t, e = library(name), _bpe.Encoder(public_tokenizers.path(name), kind)
    g = random.Random(1)
    texts = [x or "" for x in ODD] + ["".join(g.choice(WORDS) for _ in range(g.randint(0, 14))) for _ in range(8000)]
    texts += [f"a{chr(k)}b {chr(k)} {chr(k)}c{chr(k)} d {chr(k)}" for k in (*range(0x500), *range(0x1FF0, 0x2070), 0x3000, 0xFEFF)]
    texts += ["a" * 24, "  " * 40, "x" * 63, "x" * 64, "x" * 65, "ab" * 200]
    want = [ids(t, x) + [1] for x in texts]
    column = pa.array(texts, pa.string())

    def all_ids(limit):
        for first, run in _bpe.runs(column, limit):
            found, n = e.encode(run, 1)
            end = np.cumsum(n)
            yield from (found[j - m : j].tolist() for j, m in zip(end, n))

    assert list(all_ids(1 << 20)) == want
    monkeypatch.setattr(_bpe, "_KEPT_KEYS", 50)
    assert list(all_ids(2000)) == want


def test_only_words_with_other_characters_go_to_the_library(monkeypatch):
    e = _bpe.encoder("byte_bpe_50k.json", "byte")
    asked = []
    merged = e.merged
    monkeypatch.setattr(e.parts, "make", lambda tokens: asked.extend(t for t in tokens if type(t) is tuple) or merged(tokens))
    e.encode(pa.array(["it’s a plain zebrafish, “quoted” 字 and so on. " * 3]), 1)
    assert 0 < len(asked) <= 6 and all(len(t[0]) < 12 for t in asked)


def test_counts(spark):
    t = library("byte_bpe_50k.json")
    got = sorted((tuple(r) for r in token_counts.token_counts(table(spark)).collect()), key=str)
    want = [(k // 2 if k else None, len((x or "").encode()), len(ids(t, x)), len(ids(t, x)) > 1024) for k, x in enumerate(ODD)]
    assert got == sorted(want, key=str)
    assert token_counts.token_counts(table(spark).limit(0)).count() == 0


def test_whole_tokens_are_proven():
    c = token_counts.counter("byte_bpe_50k.json")
    assert len(c.whole) > 30_000 and " the" in c.whole and "<|endoftext|>" not in c.whole
    for token in random.Random(2).sample(sorted(c.whole), 300):
        assert len(ids(c.encoder.tokenizer, token)) == 1


@pytest.mark.parametrize("parts", [1, 4])
def test_files_round_trip(spark, parts):
    t = library("word_bpe_49k.json")
    df = table(spark).repartition(parts)
    folder = table_path(spark, "test-files")
    listed = token_files.write(df, folder)
    got = [tuple(r) for r in token_files.read(spark, folder, listed).orderBy("start").collect()]
    rows = [(k // 2 if k else None, ids(t, x) + [1]) for k, x in enumerate(ODD)]
    assert sorted((d, n, c) for d, _, n, c in got if d is not None) == sorted((d, len(i), crc(i)) for d, i in rows if d is not None)
    assert [d for d, *_ in got] == sorted([d for d, _ in rows], key=lambda d: (d is not None, d))
    base = 0
    for _, start, n, _ in got:
        assert start == base
        base += n
    # the files themselves: flat ids, offsets from 0
    whole = np.concatenate([token_files._File(folder, p["stem"] + ".ids", "<u2" if p["width"] == 2 else "<u4").map for p in listed])
    assert len(whole) == base and sum(p["n_docs"] for p in listed) == len(rows)
    for p in listed:
        off = token_files._File(folder, p["stem"] + ".off", "<i8").map
        assert off[0] == 0 and off[-1] == p["n_ids"] and len(off) == p["n_docs"] + 1
    empty = token_files.write(df.limit(0), table_path(spark, "test-empty"))
    assert empty == [] and token_files.read(spark, "file:///nowhere", empty).count() == 0


def test_first_fit_decreasing_is_first_fit():
    g = random.Random(3)
    for _ in range(50):
        sizes = [g.randint(1, 100) for _ in range(g.randint(0, 200))]
        bins, want = [], {}
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            b = next((b for b, used in enumerate(bins) if used + sizes[k] <= 100), len(bins))
            if b == len(bins):
                bins.append(0)
            want[k] = (b, bins[b])
            bins[b] += sizes[k]
        assert packing.first_fit_decreasing(sizes, 100) == [want[k] for k in range(len(sizes))]


@pytest.mark.parametrize("group_pieces", [8192, 8])
def test_packing(spark, group_pieces):
    t = library("byte_bpe_50k.json")
    texts = ODD + ["some words " * n for n in range(0, 3000, 97)]
    got = packing.pack(table(spark, texts), group_pieces=group_pieces).collect()
    want = sorted((crc(i[s : s + 2048]), k // 2 if k else -1, s, len(i[s : s + 2048]), len(i)) for k, x in enumerate(texts) for i in [ids(t, x) + [1]] for s in range(0, len(i), 2048))
    assert sorted((r.ids_crc32, -1 if r.doc_id is None else r.doc_id, r.start, r.length, r.doc_tokens) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    if group_pieces == 8192:
        total = sum(r.length for r in got)
        assert len(by) <= -(-total // 2048) + 3
    assert packing.pack(table(spark).limit(0)).count() == 0


def test_equal_rows_are_spread(spark):
    """20,000 equal rows: in more than one part and group, none lost."""
    rows = ship(spark).range(20_000).selectExpr("cast(7 as long) as doc_id", "'the same text' as text")
    folder = table_path(spark, "test-hot")
    listed = token_files.write(rows, folder)
    assert len(listed) > 1 and max(p["n_docs"] for p in listed) < 10_000 and sum(p["n_docs"] for p in listed) == 20_000
    got = token_files.read(spark, folder, listed).collect()
    assert sorted(r.start for r in got) == list(range(0, 20_000 * got[0].n_tokens, got[0].n_tokens)) and len({r.ids_crc32 for r in got}) == 1
    placed = packing.pack(rows, group_pieces=1000).selectExpr("sequence_id >> 24 as g").groupBy("g").count().collect()
    assert len(placed) == 20 and max(r["count"] for r in placed) < 1300 and sum(r["count"] for r in placed) == 20_000


def test_least_id_and_blocks(spark, monkeypatch):
    rows = ship(spark).createDataFrame([(-(2**63), "least"), (None, "none"), (2**63 - 1, "most"), (0, "zero " * 50)], "doc_id long, text string")
    folder = table_path(spark, "test-least")
    listed = token_files.write(rows, folder)
    got = token_files.read(spark, folder, listed).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -(2**63), 0, 2**63 - 1]
    monkeypatch.setattr(token_files, "BLOCK_IDS", 3)
    t = library("word_bpe_49k.json")
    assert [i.tolist() for p in listed for _, _, i in token_files.part_documents(folder, p)] == [ids(t, x) + [1] for x in ("none", "least", "zero " * 50, "most")]


def test_sequences_hold_the_ids(spark):
    t = library("byte_bpe_50k.json")
    packed = packing.pack(table(spark), with_ids=True)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids and crc(r.ids) == r.ids_crc32
    assert sorted(i for x in whole.values() for i in x) == sorted(i for x in ODD for i in ids(t, x) + [1])
