"""Token ids as flat binary files with 64-bit document offsets.

A data set is a folder. Each part has four files: `.ids` (little-endian unsigned
integers, 16 bits wide if the vocabulary has at most 65,536 ids, else 32), `.off`
(little-endian int64, n_docs + 1 offsets in ids, from 0), `.doc` (int64 document
ids) and `.has` (a byte for each document: 0 where its id is null). Parts follow each
other in ascending document order; `parts`, returned by write(), lists them with the base
of each, a prefix sum of the parts' totals.

write() deals texts out by ranges of (doc_id, hash of the text, place in the table) and
encodes each range as it writes it, so no ids are stored or shuffled besides the files. So
neither a long document list nor one row repeated any number of times lands in one task;
the number of parts follows the bytes of the texts. Places are those of a table as it is
read, which are the same when a lost executor's task runs again: docs must be read from
files or a checkpoint, else where equal rows go could change between attempts. A task writes under a name of its
own attempt; the list of parts, stored in the shared folder, names the files of the attempt
that counted, so lost or doubled tasks leave no trace in the result. read() memory-maps
each part where the file system is local or mounted, reads it by ranges elsewhere, and
yields rows a block at a time.

Defined cases: null and empty texts give only the end id; a null doc_id sorts first;
rows that repeat a doc_id follow each other, by the hash of their texts; a very long text
is encoded in a run of its own and lies in one part; an empty table has no parts and gives
no row; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iterix.llm import _bpe
from iterix.llm._links import stored, table_path
from iterix.session import ship

PART_BYTES = 1 << 28
BLOCK_IDS = 1 << 21


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", kind: str = "word", end_id: int = 1) -> list[dict]:
    """Write docs (doc_id, text); the list of parts, in order: stem, base, n_docs, n_ids, width."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = _bpe.encoder(tokenizer, kind)
        kind_of = np.dtype("<u4" if enc.tokenizer.get_vocab_size() > 1 << 16 else "<u2")
        part = TaskContext.get().partitionId()
        files, n_docs, n_ids = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                system, path = _filesystem(folder)
                system.create_dir(path, recursive=True)
                stem = f"part-{part:06d}-{uuid.uuid4().hex}"
                files = [system.open_output_stream(f"{path}/{stem}.{x}") for x in ("ids", "off", "doc", "has")]
                files[1].write(np.zeros(1, "<i8").tobytes())
            for _, run in _bpe.runs(batch.column(1)):
                ids, n = enc.encode(run, end_id)
                files[0].write(ids.astype(kind_of).tobytes())
                files[1].write((n_ids + np.cumsum(n)).astype("<i8").tobytes())
                n_ids += int(len(ids))
            names = batch.column(0)
            files[2].write(np.asarray(names.fill_null(0)).astype("<i8").tobytes())
            files[3].write(np.asarray(names.is_valid()).astype(np.uint8).tobytes())
            n_docs += batch.num_rows
        if files:
            for f in files:
                f.close()
            values = (part, stem, n_docs, n_ids, kind_of.itemsize)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["part", "stem", "n_docs", "n_ids", "width"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-whole // PART_BYTES))
    keys = ["doc_id", "tie", "place"]
    ordered = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    parts = stored(ordered.mapInArrow(save, "part long, stem string, n_docs long, n_ids long, width long"))
    listed, base = [], 0
    for row in sorted(parts.collect(), key=lambda r: r["part"]):  # one row a part
        listed.append(row.asDict() | {"base": base})
        base += row["n_ids"]
    return listed


class _File:
    """Ranges of a file of numbers: from a memory map where it is local, else read as asked for."""

    def __init__(self, folder: str, name: str, kind: str):
        system, path = _filesystem(folder)
        self.kind, self.map, self.file = np.dtype(kind), None, None
        if system.type_name == "local":
            import os

            whole = f"{path}/{name}"
            self.map = np.memmap(whole, dtype=self.kind, mode="r") if os.path.getsize(whole) else np.zeros(0, self.kind)
        else:
            self.file = system.open_input_file(f"{path}/{name}")

    def __getitem__(self, at: slice) -> np.ndarray:
        if self.map is not None:
            return self.map[at]
        w = self.kind.itemsize
        return np.frombuffer(self.file.read_at((at.stop - at.start) * w, at.start * w), self.kind)


def part_blocks(folder: str, part: dict) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc ids, n + 1 offsets in the data set, ids) of runs of documents of a part, of about BLOCK_IDS ids; one longer document comes alone."""
    ids, off = _File(folder, part["stem"] + ".ids", "<u2" if part["width"] == 2 else "<u4"), _File(folder, part["stem"] + ".off", "<i8")
    doc, has = _File(folder, part["stem"] + ".doc", "<i8"), _File(folder, part["stem"] + ".has", "u1")
    for lo in range(0, part["n_docs"], 1 << 16):
        hi = min(part["n_docs"], lo + (1 << 16))
        ends = np.asarray(off[lo : hi + 1])
        names = pa.array(np.asarray(doc[lo:hi]), pa.int64(), mask=np.asarray(has[lo:hi]) == 0)
        i = 0
        while i < hi - lo:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK_IDS, "right")) - 1)
            yield names.slice(i, j - i), part["base"] + ends[i : j + 1], ids[int(ends[i]) : int(ends[j])]
            i = j


def part_documents(folder: str, part: dict) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids before it in the data set, its ids) for each document of a part."""
    for names, ends, ids in part_blocks(folder, part):
        for k, name in enumerate(names.to_pylist()):
            yield name, int(ends[k]), ids[ends[k] - ends[0] : ends[k + 1] - ends[0]]


def read(spark: SparkSession, folder: str, parts: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers) from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                for names, ends, ids in part_blocks(folder, part):
                    raw, cut = memoryview(ids.astype("<u4")).cast("B"), (4 * (ends - ends[0])).tolist()
                    crc = [zlib.crc32(raw[i:j]) for i, j in zip(cut, cut[1:])]
                    yield pa.RecordBatch.from_arrays([names, pa.array(ends[:-1]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    if not parts:
        return spark.createDataFrame([], schema)
    given = spark.createDataFrame([tuple(p[k] for k in ("part", "stem", "n_docs", "n_ids", "width", "base")) for p in parts], "part long, stem string, n_docs long, n_ids long, width long, base long")
    return given.repartitionByRange(len(parts), "part").mapInArrow(digest, schema)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    folder = table_path(spark, "token-files")
    return read(spark, folder, write(docs, folder))
