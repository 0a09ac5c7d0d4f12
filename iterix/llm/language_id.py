"""Language identification: word first, backing off to shorter character n-grams.

The model holds, for each language, log frequencies of words and of character n-grams
of 5 down to 1 characters (with word boundaries marked), from a bounded sample of
labelled documents. A word met in training scores by its log frequency in each
language; an unseen word is cut into n-grams of the longest order of which it has a
known one, and scores by their mean. A text goes to the language of the highest mean
score over all its words; `score` is that language's share under a softmax of the
total evidence, damped to a fixed number of words. As a share it says nothing of texts
that are in none of the languages, so `accepted` also wants words that the chosen
language is known to have: half the share usual in the language's own texts, measured
on words that another text of the sample holds.

Bounds, parameters: `sample_docs` training documents for each language, those of the lowest
hash of id and text. Their words are counted on the executors; words and n-grams seen
`least_seen` times or more are in the model, the rest only through their n-grams, so the model
follows the sample's vocabulary and no size is set. Up to `few_languages` the languages' sizes
are broadcast; more are joined by salted keys. Every text is predicted whole, in one
pass without a shuffle.

Words are runs of letters (Unicode category L), lower-cased, so digits, numerals such as
one half, punctuation and symbols do not vote.
Defined cases: null texts and texts without a letter are `und` with score 0; ties go to
the first language by name; a very long text is one row like others; without any labelled
row all rows are `und`; rows that repeat an id and a text are one document of the sample,
and repeat in the result; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import weakref
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iterix.llm import _bpe
from iterix.llm._links import kept_rows, stored
from iterix.session import ship

#: Letters, and numerals that are no digits, such as one half.
_RUN = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, lower-cased."""
    found = _RUN.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


@dataclass(frozen=True)
class LanguageConfig:
    sample_docs: int = 600
    least_seen: int = 2
    orders: tuple[int, ...] = (5, 4, 3, 2, 1)
    smoothing: float = 0.5
    evidence_words: int = 12
    seed: int = 5
    least_familiar: float = 0.5  # of the median of a language's own texts
    doubt_words: int = 5
    few_languages: int = 4096  # up to so many, their sizes are broadcast
    salts: int = 64


#: Words outside the model whose scores a worker holds, and words cut into n-grams at once.
_SEEN_LIMIT, _CUT_AT_ONCE = 200_000, 2_000


class Shares(Mapping):
    """Log shares in each language by key. Keys number the rows of one array, which takes half the memory of a tuple for each."""

    def __init__(self, keys: Iterable[str] = (), rows: np.ndarray = np.zeros((0, 0))):
        self.at, self.rows = {k: n for n, k in enumerate(keys)}, rows

    def __getitem__(self, key: str) -> tuple[float, ...]:
        return tuple(self.rows[self.at[key]].tolist())

    def __iter__(self) -> Iterator[str]:
        return iter(self.at)

    def __len__(self) -> int:
        return len(self.at)


class _Rows(dict):
    """The row of each word in a table of scores: first the model's own, then others, scored as they come."""

    def __init__(self, model: LanguageModel):
        super().__init__(model.words.at)
        spare = np.zeros((1024, len(model.languages)))
        self.score = weakref.WeakMethod(model.word_scores)  # no cycle, so a worker is rid of a model as soon as its task is
        self.table, self.known_in = np.concatenate([model.words.rows, spare]), model.known
        self.known = np.zeros(self.table.shape, bool)
        for k, words in enumerate(model.known):
            self.known[: len(self), k] = np.fromiter(map(words.__contains__, self), bool, len(self))

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        self.table[n] = self.score()(word)
        for k, words in enumerate(self.known_in):
            self.known[n, k] = word in words
        self[word] = n
        return n


@dataclass
class LanguageModel:
    languages: list[str]
    words: Shares = field(default_factory=Shares)
    grams: dict[int, Shares] = field(default_factory=dict)
    orders: tuple[int, ...] = (5, 4, 3, 2, 1)
    evidence_words: int = 12
    known: list[frozenset[str]] = field(default_factory=list)  # the words of each language
    usual: tuple[float, ...] = ()  # the median share of known words in texts of each language
    least_familiar: float = 0.5
    doubt_words: int = 5
    _rows: _Rows | None = None

    def __getstate__(self):
        return self.__dict__ | {"_rows": None}

    def word_scores(self, word: str) -> tuple[float, ...]:
        if word in self.words.at:
            return self.words[word]
        marked = f"<{word}>"
        for order in self.orders:
            table = self.grams[order]
            found = [n for k in range(len(marked) - order + 1) if (n := table.at.get(marked[k : k + order])) is not None]
            if found:
                return tuple(sum(x) / len(found) for x in zip(*table.rows[found].tolist()))
        return (0.0,) * len(self.languages)

    def _judged(self, texts: list[str | None]) -> Iterator[tuple[int, float, np.ndarray | None]]:
        """Place of the language, score and rows of the words of each text; no words, no rows."""
        for text in texts:
            words = words_of(text) if text and self.languages else []
            if not words:
                yield 0, 0.0, None
                continue
            if self._rows is None or len(self._rows) > len(self.words) + _SEEN_LIMIT:
                self._rows = _Rows(self)
            at = np.fromiter(map(self._rows.__getitem__, words), np.int64, len(words))
            evidence = self._rows.table[at].mean(axis=0) * min(len(words), self.evidence_words)
            share = np.exp(evidence - evidence.max())
            best = int(np.argmax(share))
            yield best, float(share[best] / share.sum()), at

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        return [(UNKNOWN, 0.0) if at is None else (self.languages[k], score) for k, score, at in self._judged(texts)]

    def accepts(self, texts: list[str | None], least: float) -> list[bool]:
        """Whether each text has a language of at least that score, and enough words of it.

        Enough is `least_familiar` of the share usual in that language's own texts, where
        `doubt_words` more words of the usual share are added, so a few unknown words alone
        reject nothing."""
        out = []
        for k, score, at in self._judged(texts):
            ok = at is not None and score >= least
            if ok and self.usual:
                share = (self._rows.known[at, k].sum() + self.doubt_words * self.usual[k]) / (len(at) + self.doubt_words)
                ok = bool(share >= self.least_familiar * self.usual[k])
            out.append(ok)
        return out


def _log_shares(by_language: list[Counter], totals: list[int], smoothing: float) -> Shares:
    kept = list(set().union(*by_language))
    wholes = [n + smoothing * (len(kept) + 1) for n in totals]
    rows = np.zeros((len(kept), len(totals)))
    for n, k in enumerate(kept):
        row = np.array([math.log((c[k] + smoothing) / whole) for c, whole in zip(by_language, wholes)])
        rows[n] = row - row.mean()  # only differences between languages matter; a gram of another length then weighs alike
    return Shares(kept, rows)


def _marked_grams(word: str, order: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[k : k + order] for k in range(len(marked) - order + 1)]


def _model(languages: list[str], words: list[Counter], totals: list[int], grams: dict[int, list[Counter]], gram_totals: dict[int, list[int]], usual: list[float], cfg: LanguageConfig) -> LanguageModel:
    model = LanguageModel(languages, orders=cfg.orders, evidence_words=cfg.evidence_words, least_familiar=cfg.least_familiar, doubt_words=cfg.doubt_words)
    model.words = _log_shares(words, totals, cfg.smoothing)
    model.known = [frozenset(c) for c in words]
    model.usual = tuple(usual)
    model.grams = {order: _log_shares(grams[order], gram_totals[order], cfg.smoothing) for order in cfg.orders}
    return model


def _sample(labelled: DataFrame, cfg: LanguageConfig) -> DataFrame:
    """lang, text, h, tie of the sample_docs documents of each language with the lowest hashes."""
    from pyspark.sql import Window

    rows = labelled.where("text is not null and lang is not null").select("lang", "text", F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(cfg.seed)).alias("h"), F.xxhash64("text").alias("tie"))
    size = rows.groupBy("lang").agg(F.count("*").alias("size"))
    few = size.limit(cfg.few_languages + 1).collect()
    # a threshold first, so that few texts move; then a top-k that starts in every task, so no language lands in one
    if len(few) <= cfg.few_languages:
        sized = rows.join(F.broadcast(labelled.sparkSession.createDataFrame(few, size.schema)), "lang")
    else:
        salts = F.sequence(F.lit(0), F.lit(cfg.salts - 1))
        sized = rows.withColumn("salt", F.pmod("h", F.lit(cfg.salts)).cast("int")).join(size.withColumn("salt", F.explode(salts)), ["lang", "salt"])
    near = sized.where((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("size") <= 2.0 * cfg.sample_docs + 100)
    order = Window.partitionBy("lang").orderBy("h", "tie")
    return near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= cfg.sample_docs).select("lang", "text", "h", "tie")


def fit(labelled: DataFrame, cfg: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """A model from a sample of labelled (doc_id, text, lang). Only counts come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "h", "tie", "word", "n"]
        for batch in batches:
            for lang, text, h, tie in zip(*(c.to_pylist() for c in batch.columns)):
                found = Counter(words_of(text))
                if found:
                    columns = [[lang] * len(found), [h] * len(found), [tie] * len(found), list(found), list(found.values())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "len", "gram", "n"]
        for part in (batch.slice(k, _CUT_AT_ONCE) for batch in batches for k in range(0, batch.num_rows, _CUT_AT_ONCE)):
            found: Counter = Counter()
            for lang, word, n in zip(*(c.to_pylist() for c in part.columns)):
                found[lang, 0, word] += n
                for order in cfg.orders:
                    for g in _marked_grams(word, order):
                        found[lang, order, g] += n
            if found:
                columns = [*zip(*found), list(found.values())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()))], names)

    from pyspark.sql import Window

    held = stored(_sample(labelled, cfg).mapInArrow(count, "lang string, h long, tie long, word string, n long").distinct())
    words = held.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    grams = stored(words.mapInArrow(cut, "lang string, len int, gram string, n long").groupBy("lang", "len", "gram").agg(F.sum("n").alias("n")))  # words have len 0
    totals = {(r["lang"], r["len"]): r["n"] for r in grams.groupBy("lang", "len").agg(F.sum("n").alias("n")).collect()}  # a row a language and length
    languages = sorted({lang for lang, _ in totals})
    if not languages:
        return LanguageModel([])
    often = grams.groupBy("len", "gram").agg(F.collect_list("lang").alias("langs"), F.collect_list("n").alias("ns"), F.sum("n").alias("whole")).where(F.col("whole") >= cfg.least_seen)
    by_gram = {order: {lang: Counter() for lang in languages} for order in (0, *cfg.orders)}
    for order, g, langs, ns in zip(*(c.to_pylist() for c in often.select("len", "gram", "langs", "ns").toArrow().columns)):
        for lang, n in zip(langs, ns):
            by_gram[order][lang][g] = n
    # the share of a text's words that another text of the language has: its median
    known = F.when(F.count(F.lit(1)).over(Window.partitionBy("lang", "word")) > 1, F.col("n")).otherwise(0)
    share = held.withColumn("known", known).groupBy("lang", "h", "tie").agg((F.sum("known") / F.sum("n")).alias("share"))
    usual = {r["lang"]: r["usual"] for r in share.groupBy("lang").agg(F.percentile("share", 0.5).alias("usual")).collect()}
    return _model(
        languages, [by_gram[0][x] for x in languages], [totals[x, 0] for x in languages],
        {o: [by_gram[o][x] for x in languages] for o in cfg.orders}, {o: [totals.get((x, o), 0) for x in languages] for o in cfg.orders},
        [usual[x] for x in languages], cfg,
    )


def fit_rows(rows: list[tuple[str, str]], cfg: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """As fit, from a list of (language, text), all of which are used; written out plainly."""
    languages = sorted({lang for lang, _ in rows})
    texts = {x: [c for lang, text in rows if lang == x and (c := Counter(words_of(text)))] for x in languages}
    words = [sum(texts[x], Counter()) for x in languages]
    grams = {order: [Counter() for _ in languages] for order in cfg.orders}
    for order in cfg.orders:
        for c, of in zip(words, grams[order]):
            for w, n in c.items():
                for g in _marked_grams(w, order):
                    of[g] += n

    def often(by_language: list[Counter]) -> list[Counter]:
        whole = sum(by_language, Counter())
        return [Counter({k: n for k, n in c.items() if whole[k] >= cfg.least_seen}) for c in by_language]

    usual = []
    for x in languages:
        held = Counter(w for c in texts[x] for w in c)
        shares = [sum(n for w, n in c.items() if held[w] > 1) / sum(c.values()) for c in texts[x]]
        usual.append(float(np.median(shares)) if shares else 0.0)
    return _model(languages, often(words), [sum(c.values()) for c in words], {o: often(grams[o]) for o in cfg.orders}, {o: [sum(c.values()) for c in grams[o]] for o in cfg.orders}, usual, cfg)


def held_out(modulus: int, remainder: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for first, run in _bpe.runs(batch.column(2)):
                found = m.predict(run.to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, len(run)) for k in (0, 1)), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows of docs (text, ...) with a language of at least that score, and words of it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return kept_rows(docs, lambda texts: shared.value.accepts(texts.to_pylist(), least))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs.where(~held_out(4, 2))))
