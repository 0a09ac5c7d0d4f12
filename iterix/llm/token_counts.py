"""Token counts with a whole-token shortcut.

Proof, made once in each worker from the vocabulary file alone: every vocabulary
string is decoded to text and kept if the library encodes that text, by itself, as
exactly one token and the pre-token rule leaves it in one piece. A pre-token of a
text that is in this set counts 1; only the others are merged (see `_bpe`, also for the
characters outside Latin-1, which send the word around them to the library). Counts of
words and of merged pre-tokens are kept in bounded caches.

Whole texts are counted, in runs of bounded size; a longer text is a run of its own.
Defined cases: null and empty texts have 0 bytes and 0 tokens; nothing is
truncated; each row is counted by itself, so repeated rows repeat; an empty table gives
no row; other columns are ignored. No shuffle: one pass over the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iterix.llm import _bpe
from iterix.session import ship

def proven_whole(enc: _bpe.Encoder) -> frozenset[str]:
    """Vocabulary strings that encode alone as one token."""
    size = enc.tokenizer.get_vocab_size(with_added_tokens=True)
    texts = enc.tokenizer.decode_batch([[i] for i in range(size)], skip_special_tokens=False)
    texts = [t for t in dict.fromkeys(texts) if t and "�" not in t and t not in enc.special]
    one = [len(x.ids) == 1 for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    return frozenset(t for t, ok in zip(texts, one) if ok and enc.pre_tokens((t,)) == [t])


class Counter:
    def __init__(self, name: str):
        self.encoder = _bpe.encoder(name, "byte")
        self.whole = proven_whole(self.encoder)
        self.table, self.parts = _bpe.Table(self._units), _bpe.Table(lambda tokens: (np.zeros(0, np.uint32), self.encoder.merged(tokens)[1]))

    def _units(self, units: list) -> tuple[np.ndarray, np.ndarray]:
        """(no ids, the number of tokens of each distinct unit)."""
        n, rest, of = np.zeros(len(units), np.int64), [], []
        for k, unit in enumerate(units):
            for token in self.encoder.pre_tokens(unit):
                if token in self.whole:
                    n[k] += 1
                else:
                    rest.append(token)
                    of.append(k)
        if rest:
            slots = self.parts.slots(rest)
            n += np.bincount(of, weights=self.parts.length[slots], minlength=len(units)).astype(np.int64)
        return np.zeros(0, np.uint32), n

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        units: list = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            at = len(units)
            units += self.encoder.units(text)
            counts[k] = len(units) - at
        slots = self.table.slots(units)
        ends = np.concatenate([[0], np.cumsum(self.table.length[slots])])
        return np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])


_counters: dict[str, Counter] = {}


def counter(name: str) -> Counter:
    if name not in _counters:
        _counters[name] = Counter(name)
    return _counters[name]


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(tokenizer)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for first, run in _bpe.runs(texts):
                n = of.count(run.to_pylist())
                columns = [batch.column(0).slice(first, len(run)), pc.binary_length(run).cast(pa.int64()), pa.array(n), pa.array(n > limit)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(ship(spark).read.parquet(f"{sf_dir}/documents.parquet"))
