"""Packing token documents into fixed-length sequences by first-fit decreasing.

A document (its ids, then the end id) is cut into full sequences and a rest. Pieces
are dealt at random into groups of about `group_pieces`, and each group is packed by
first-fit decreasing: a tournament tree over bin capacities finds the first bin that
fits in logarithmic time. The number of groups follows the number of pieces, so the
work of a task stays the same at every size. Pieces are stored in the shared folder
before they are counted, and dealt by a hash of their place in that stored table: so no
group is larger for a key or a row that repeats, and a lost executor cannot change one.

Only lengths and digests are shuffled, never texts; ids are, where the sequences
themselves are asked for (`with_ids`, then `sequences`).

Defined cases: null and empty texts are one piece of one id; rows that repeat a
doc_id are packed each, also if they are equal; a null doc_id is packed too; pieces of
equal length go in the order of (doc_id, start, digest), and which of several equal rows
comes first shows in no column; a very long text is encoded in a run of its own; an empty
table gives no row; other columns are ignored. `start` is the number of ids of the
document before the piece, `offset` its place in the sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iterix.llm import _bpe
from iterix.llm._links import stored
from iterix.session import ship

PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


class Bins:
    """Capacities under a tournament tree: each inner node holds the largest capacity below it."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves, self.used = capacity, 1, 0
        self.tree = [capacity, capacity]

    def _grow(self) -> None:
        old = self.tree[self.leaves : 2 * self.leaves]
        self.leaves *= 2
        self.tree = [self.capacity] * (2 * self.leaves)
        self.tree[self.leaves : self.leaves + len(old)] = old
        for k in range(self.leaves - 1, 0, -1):
            self.tree[k] = max(self.tree[2 * k], self.tree[2 * k + 1])

    def place(self, size: int) -> tuple[int, int]:
        """Put an item in the first bin with room; (bin, offset in it)."""
        if self.tree[1] < size:
            self._grow()
        tree, k = self.tree, 1
        while k < self.leaves:
            k *= 2
            if tree[k] < size:
                k += 1
        at, offset = k - self.leaves, self.capacity - tree[k]
        tree[k] -= size
        while k > 1:
            k //= 2
            new = max(tree[2 * k], tree[2 * k + 1])
            if new == tree[k]:
                break
            tree[k] = new
        self.used = max(self.used, at + 1)
        return at, offset


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item; sizes need not be sorted."""
    bins, out = Bins(capacity), [(0, 0)] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        out[k] = bins.place(sizes[k])
    return out


def pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, and its ids if asked for."""
    names, schema = PIECE, ", ".join(f"{n} long" for n in PIECE)
    if with_ids:
        names, schema = [*names, "ids"], schema + ", ids array<int>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _bpe.encoder(tokenizer, "byte")
        for batch in batches:
            for first, run in _bpe.runs(batch.column(1).fill_null("")):
                ids, n = enc.encode(run, end_id)
                m = -(-n // capacity)
                of = np.repeat(np.arange(len(n)), m)
                start = (np.arange(len(of)) - (np.cumsum(m) - m)[of]) * capacity
                length = np.minimum(capacity, n[of] - start)
                ends = np.cumsum(length)
                raw, at = memoryview(ids.astype("<u4")).cast("B"), [0, *(4 * ends).tolist()]
                crc = [zlib.crc32(raw[i:j]) for i, j in zip(at, at[1:])]
                columns = [batch.column(0).slice(first, len(run)).take(pa.array(of)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[of])]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, group_pieces: int = 8192, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids: also the piece's ids."""
    cut = stored(pieces(docs, capacity, tokenizer, end_id, with_ids))
    groups = max(1, -(-cut.count() // group_pieces))
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([(n, "ascending") for n in PIECE])
        placed = first_fit_decreasing(group["length"].to_pylist(), capacity)
        of = group["pack_group"][0].as_py() << 24
        return group.drop_columns(["pack_group"]).append_column("sequence_id", pa.array([of + b for b, _ in placed], pa.int64())).append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit("pack")), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInArrow(fill, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids array<int>: the training sequences of pack(..., with_ids=True), without padding."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # at most `capacity` pieces
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(ship(spark).read.parquet(f"{sf_dir}/documents.parquet"))
