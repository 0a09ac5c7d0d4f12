"""Near-duplicate classes by consistent weighted sampling.

Documents are weighted sets of five-word shingles, tf x idf. Improved consistent
weighted sampling (Ioffe 2010) draws bands x rows samples; documents that agree
on all samples of a band meet in a bucket, where every pair's weighted Jaccard
similarity is computed exactly, and links of 0.8 or more are closed into classes.

* idf: df comes from one pass over all documents into a sketch of fixed size,
  relative to the number of documents, so it behaves alike at every size. The
  factor is 1 + min(1, ln((N + 1) / (df + 1)) / ln 64) / 2: between 1 for a shingle
  that all documents hold and 1.5 for one in less than 1/64 of them. It is kept that
  narrow since in a large group of near copies the shared shingles are common and
  the edits are rare: a raw idf would pull true copies apart.
* Equal texts meet by digest first; one of them stands for all, so a group of
  exact copies costs one row.
* A bucket is verified with an inverted index, never as emitted pairs, and returns a
  spanning forest. Texts are first compared with a few leaders; pairs that those join are not
  met again, so a large group of near copies costs work in proportion to it.
* A bucket over a stated size is first dealt out in slices that are each compared with the
  bucket's leader, its smallest node. Then slices meet in pairs, where only pairs of different
  classes are verified and no two slices of the largest class meet.

Defined cases: a null or wordless text is alone in its class; a text of one to
four words is one shingle; a very long text is shingled in pieces and is one row of its
unit; rows that share a doc_id are one document; a null doc_id is kept with a null class;
an empty table gives no row. Other columns are ignored. `one_of_each` judges by row: each row
is its own text's, with or without an id, and of each class one row stays, that of the
smallest doc_id (null last; ties by digest; of equal rows any); rows without a word all stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iterix.llm import _text
from iterix.llm._links import components, stored, unused
from iterix.session import ship


IDF_SPAN = 0.5


@dataclass(frozen=True)
class NearDupConfig:
    width: int = 5
    threshold: float = 0.8
    bands: int = 9  # 1 - (1 - 0.8 ** 3) ** 9 = 0.998 of pairs at the threshold
    rows: int = 3
    df_buckets: int = 1 << 16
    slice_docs: int = 2048
    slice_elements: int = 2_000_000
    seed: int = 11


def document_frequencies(docs: DataFrame, cfg: NearDupConfig) -> tuple[np.ndarray, int]:
    """Counts of a fixed-size sketch over all documents, and their number."""
    parts = 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(cfg.df_buckets, np.int64), 0
        for batch in batches:
            raw, off = _text.utf8(batch.column(0))
            for _, _, r, o in _text.chunks(raw, off):
                e, _ = _text.elements(r, o, cfg.width)
                total += np.bincount(e & np.uint32(cfg.df_buckets - 1), minlength=cfg.df_buckets)
            n += batch.num_rows
        if n:
            rows = total.reshape(parts, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([n] * parts, pa.int64()), pa.array([x.tobytes() for x in rows], pa.binary())], ["part", "n", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        ns: dict[int, int] = {}
        for batch in batches:
            for part, n, counts in zip(*(c.to_pylist() for c in batch.columns)):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.int64)
                ns[part] = ns.get(part, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(ns.values()), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "n", "counts"])

    schema = "part int, n long, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition(parts, "part").mapInArrow(add, schema).collect()
    if not rows:
        return np.zeros(cfg.df_buckets, np.int64), 0
    return np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(rows, key=lambda r: r["part"])]), rows[0]["n"]


def weights(counts: np.ndarray, n_docs: int) -> np.ndarray:
    """The idf factor of each bucket, less the average load of its other shingles."""
    df = np.maximum(0.0, counts - counts.mean())
    return (1 + IDF_SPAN * np.clip(np.log((n_docs + 1) / (df + 1)) / np.log(64), 0, 1)).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling; the randomness of an element is looked up in fixed tables by bits of its hash."""

    def __init__(self, cfg: NearDupConfig):
        g, size = np.random.default_rng(cfg.seed), 1 << 14
        self.r = g.gamma(2.0, 1.0, size).astype(np.float32)
        self.log_c = np.log(g.gamma(2.0, 1.0, size)).astype(np.float32)
        self.beta = g.random(size).astype(np.float32)
        self.keys = g.integers(1, 2**63, cfg.bands * cfg.rows, dtype=np.uint64) | np.uint64(1)
        self.cfg = cfg

    def bands(self, e: np.ndarray, log_w: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Band keys of each document; start: where its elements begin (none is empty)."""
        cfg, low = self.cfg, np.uint64((1 << 14) - 1)
        wide = _text.mix(e.astype(np.uint64) + np.uint64(0x51ED27))
        lengths = np.diff(start, append=len(e))
        out = np.zeros((len(start), cfg.bands), np.uint64)
        for k, key in enumerate(self.keys):
            h = wide * key
            h ^= h >> np.uint64(32)
            r = self.r[(h & low).astype(np.int32)]
            t = np.floor(log_w / r + self.beta[((h >> np.uint64(14)) & low).astype(np.int32)])
            log_y = r * (t - self.beta[((h >> np.uint64(14)) & low).astype(np.int32)])
            log_a = self.log_c[((h >> np.uint64(28)) & low).astype(np.int32)] - log_y - r
            least = np.minimum.reduceat(log_a, start)
            at = log_a == np.repeat(least, lengths)
            # table ties go to the smallest hash
            cand = np.where(at, wide ^ key, np.uint64(2**64 - 1))
            best = np.minimum.reduceat(cand, start)
            level = np.where(cand == np.repeat(best, lengths), t.astype(np.int64).view(np.uint64), np.uint64(2**64 - 1))
            sample = _text.mix(best + _text.mix(np.minimum.reduceat(level, start)))
            out[:, k // cfg.rows] = _text.mix(out[:, k // cfg.rows] * np.uint64(31) + sample + np.uint64(k))
        return out.view(np.int64)


def signatures(docs: DataFrame, factor: np.ndarray, cfg: NearDupConfig) -> DataFrame:
    """doc_id, digest, bands, n of every row of docs (doc_id, digest, text) with a word."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, log_f = Sampler(cfg), np.log(factor)
        for batch in batches:
            raw, off = _text.utf8(batch.column(2))
            for i, _, r, o in _text.chunks(raw, off):
                e, doc = _text.elements(r, o, cfg.width)
                if not len(e):
                    continue
                has, start, n = np.unique(doc, return_index=True, return_counts=True)
                keys = sampler.bands(e, log_f[e & np.uint32(cfg.df_buckets - 1)], start)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1) * cfg.bands, pa.int32()), pa.array(keys.ravel()))
                at = pa.array(has + i)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), flat, pa.array(n, pa.int64())], ["doc_id", "digest", "bands", "n"])

    return docs.select("doc_id", "digest", "text").mapInArrow(sign, "doc_id long, digest binary, bands array<long>, n long")


def element_sets(docs: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """digest, elements (sorted) of every text with a word of docs (digest, text), once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = _text.utf8(batch.column(1))
            for i, _, r, o in _text.chunks(raw, off):
                e, doc = _text.elements(r, o, cfg.width)
                if not len(e):
                    continue
                has, start = np.unique(doc, return_index=True)
                e = e[np.lexsort((e, doc))]
                ends = pa.py_buffer((4 * np.append(start, len(e))).astype("<i8"))
                sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(has), [None, ends, pa.py_buffer(e.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(has + i)), sets.cast(pa.binary())], ["digest", "elements"])

    return docs.select("digest", "text").mapInArrow(rows, "digest binary, elements binary").groupBy("digest").agg(F.first("elements").alias("elements"))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def verified(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, factor: np.ndarray, threshold: float, groups: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of different groups; with two sides, of those across them only."""
    m, mask = len(sets), np.uint32(len(factor) - 1)
    lengths = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), lengths)
    w = factor[flat & mask].astype(np.float64)
    total = np.bincount(owner, weights=w, minlength=m)
    parent = list(range(m))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    groups = np.arange(m) if groups is None else groups
    across, out = bool(side.any() and not side.all()), []
    group = np.unique(groups, return_inverse=True)[1]
    for i in range(0, m, max(1, m // 8)) if m > 64 else ():  # a few leaders, as long as they join many
        near = np.flatnonzero(_like_leader(sets[i], flat, owner, total, factor, threshold) & (group != group[i]))
        fresh = near[np.unique(group[near], return_index=True)[1]]  # one of each group
        out += [(int(nodes[i]), int(nodes[j])) for j in fresh.tolist()]
        group[np.isin(group, group[fresh])] = group[i]
        if 8 * len(fresh) < m:
            break
    _, group, members = np.unique(group, return_inverse=True, return_counts=True)
    if len(members) == 1:
        return out
    heads: dict[int, int] = {}
    parent = [heads.setdefault(g, k) for k, g in enumerate(group.tolist())]
    asks = np.flatnonzero(group != int(np.argmax(members)))  # pairs within the largest group are linked already
    values, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(inverse, kind="stable")
    posting, begin = owner[order], np.concatenate([[0], np.cumsum(count)[:-1]])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for i in asks.tolist():
        own = inverse[first[i] : first[i] + lengths[i]]
        own = own[count[own] > 1]
        if not len(own):
            continue
        c = count[own]
        at = np.repeat(begin[own] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())
        common = np.bincount(posting[at], weights=np.repeat(factor[values[own] & mask].astype(np.float64), c), minlength=m)
        similar = common >= threshold * (total[i] + total - common) - 1e-9
        similar &= group != group[i]
        if across:
            similar &= side != side[i]
        for j in np.flatnonzero(similar).tolist():
            a, b = find(i), find(j)
            if a != b:
                parent[a] = b
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def _like_leader(leader: np.ndarray, flat: np.ndarray, owner: np.ndarray, total: np.ndarray, factor: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the sets, joined in flat, are similar to the leader's; total: their weights."""
    mask = np.uint32(len(factor) - 1)
    at = np.minimum(np.searchsorted(leader, flat), len(leader) - 1)
    hit = np.flatnonzero(leader[at] == flat)
    common = np.bincount(owner[hit], weights=factor[flat[hit] & mask].astype(np.float64), minlength=len(total))
    return common >= threshold * (factor[leader & mask].astype(np.float64).sum() + total - common) - 1e-9


def _pairs_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def leader_links(reps: DataFrame, sets: DataFrame, factor: np.ndarray, cfg: NearDupConfig) -> DataFrame:
    """(a, b): texts of buckets over the stated size that are similar to their bucket's leader, and that leader."""
    rows = reps.select("node", "digest", "n", F.explode("bands").alias("bucket"))
    size = rows.groupBy("bucket").agg(F.min(F.struct("node", "digest")).alias("leader"), F.count("*").alias("docs"), F.sum("n").alias("total"))
    hot = size.where((F.col("docs") > cfg.slice_docs) | (F.col("total") > cfg.slice_elements) & (F.col("docs") > 1)).select("bucket", F.col("leader.node").alias("leader"), F.col("leader.digest").alias("lead_digest"))
    pairs = rows.join(hot, "bucket").where("node <> leader").select("node", "digest", "leader", "lead_digest").distinct()
    size = pairs.groupBy("leader", "lead_digest").agg(F.ceil(F.count("*") / cfg.slice_docs).cast("int").alias("slices"))
    asks = pairs.join(size.select("leader", "slices"), "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int").alias("slice"), "node", "digest")
    leads = size.select("leader", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("leader").alias("node"), F.col("lead_digest").alias("digest"))
    placed = asks.union(leads).join(sets, "digest").select("leader", "slice", (F.col("node") != F.col("leader")).alias("asks"), "node", "elements")
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(n, "leader", "slice").sortWithinPartitions("leader", "slice", "asks")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lead, mask = None, np.zeros(0, np.uint32), np.uint32(len(factor) - 1)

        def close(held: list) -> list[tuple[int, int]]:
            if not held:
                return []
            each = [np.frombuffer(e, np.uint32) for _, e in held]
            flat, owner = np.concatenate(each), np.repeat(np.arange(len(each)), [len(e) for e in each])
            total = np.bincount(owner, weights=factor[flat & mask].astype(np.float64), minlength=len(each))
            return [(held[k][0], key[0]) for k in np.flatnonzero(_like_leader(lead, flat, owner, total, factor, cfg.threshold)).tolist()]

        for batch in batches:
            found, held, size = [], [], 0
            for leader, part, asks, node, e in zip(*(c.to_pylist() for c in batch.columns)):
                if (leader, part) != key or size > cfg.slice_elements:
                    found += close(held)
                    key, held, size = (leader, part), [], 0
                if asks:
                    held.append((node, e))
                    size += len(e) // 4
                else:
                    lead = np.frombuffer(e, np.uint32)
            yield _pairs_batch(found + close(held))

    return placed.mapInArrow(verify, "a long, b long")


def class_links(reps: DataFrame, sets: DataFrame, factor: np.ndarray, cfg: NearDupConfig) -> DataFrame:
    """(a, b): enough links to connect all classes (column own of reps) that are linked within a bucket."""
    rows = reps.select("node", "digest", "own", "n", F.explode("bands").alias("bucket"))
    by_class = rows.groupBy("bucket", "own").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
    most = F.max(F.struct("docs", "own"))
    size = by_class.groupBy("bucket").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.sum("docs").alias("docs"), F.sum("total").alias("total"), most["own"].alias("major"), most["docs"].alias("major_docs"))
    size = size.where("low < high").select("bucket", "docs", "total", "major", "major_docs")
    # small buckets are one unit; in others, slices of the texts outside the largest class come first, and every unit has one of them
    whole = (F.col("docs") <= cfg.slice_docs) & (F.col("total") <= cfg.slice_elements)
    per = F.greatest(F.lit(1), F.floor(F.least(F.lit(cfg.slice_docs), F.lit(cfg.slice_elements) * F.col("docs") / F.col("total"))))
    size = size.withColumn("others", F.when(whole, 1).otherwise(F.ceil((F.col("docs") - F.col("major_docs")) / per)).cast("int")).withColumn("majors", F.when(whole, 0).otherwise(F.ceil(F.col("major_docs") / per)).cast("int"))
    met = rows.select("node", "digest", "own", "bucket").join(size, "bucket")
    minor = (F.col("majors") == 0) | (F.col("own") != F.col("major"))
    hashed = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    met = met.withColumn("at", F.when(minor, hashed("others")).otherwise(F.col("others") + hashed("majors"))).withColumn("last", F.when(minor, F.col("others") + F.col("majors")).otherwise(F.col("others")) - 1)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    units = met.select("node", "digest", "own", "bucket", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"), (F.col("at") > F.col("other")).alias("side"))
    placed = units.join(sets, "digest").select("bucket", "lo", "hi", "side", "node", "own", "elements")
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(n, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(unit: list) -> list[tuple[int, int]]:
            side = np.array([u[0] for u in unit])
            if len(unit) < 2 or key[1] != key[2] and side.all() == side.any():
                return []
            return verified(np.array([u[1] for u in unit]), [np.frombuffer(u[3], np.uint32) for u in unit], side, factor, cfg.threshold, np.array([u[2] for u in unit]))

        key, unit, found = None, [], []
        for batch in batches:
            for bucket, lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, lo, hi) != key:
                    found += close(unit) if unit else []
                    key, unit = (bucket, lo, hi), []
                unit.append(row)
            if len(found) > 10_000:
                yield _pairs_batch(found)
                found = []
        found += close(unit) if unit else []
        yield _pairs_batch(found)

    return placed.mapInArrow(verify, "a long, b long")


def classes(docs: DataFrame, reps: DataFrame, same: DataFrame | None, factor: np.ndarray, cfg: NearDupConfig) -> DataFrame:
    """(node, root) of every node of reps (node, digest, bands, n): root is the smallest node of its class. docs: digest, text; same: links (a, b) known beforehand."""
    sets = element_sets(docs, cfg)
    links = leader_links(reps, sets, factor, cfg)
    near = components(links if same is None else links.union(same)).select(F.col("node").alias("linked"), F.col("root").alias("first"))
    placed = stored(reps.join(near, F.col("node") == F.col("linked"), "left").withColumn("own", F.coalesce("first", "node")).select("node", "digest", "own", "bands", "n"))
    of = placed.select("node", "own")
    found = class_links(placed, sets, factor, cfg)
    across = found.join(of.toDF("a", "own_a"), "a").join(of.toDF("b", "own_b"), "b").select(F.col("own_a").alias("a"), F.col("own_b").alias("b"))
    more = components(across).select(F.col("node").alias("linked"), F.col("root").alias("second"))
    return of.join(more, F.col("own") == F.col("linked"), "left").select("node", F.coalesce("second", "own").alias("root"))


def near_duplicates(docs: DataFrame, cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), kept (it is that one), for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    factor = weights(*document_frequencies(docs, cfg))
    known = docs.where("doc_id is not null").withColumn("digest", _digest(F.col("text")))
    signed = stored(signatures(known, factor, cfg))
    held = signed.select("doc_id", "digest")
    reps = stored(signed.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("n").alias("n")))
    texts = reps.select("digest", "node")
    # ids with several texts tie the texts' classes; other copies follow their text
    several = held.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
    same = held.join(several, "doc_id").join(texts, "digest").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    root = classes(known, reps, same, factor, cfg)
    of = held.join(texts.join(root, "node").select("digest", "root"), "digest").groupBy("doc_id").agg(F.min("root").alias("root"))
    ids = docs.select("doc_id")
    return ids.join(of, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce(F.col("doc_id") == F.coalesce("root", "doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that stay when each class keeps one row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    factor = weights(*document_frequencies(texts, cfg))
    texts = texts.withColumn("digest", _digest(F.col("text")))
    signed = signatures(texts, factor, cfg)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    node = stored(signed.groupBy("digest").agg(least.alias("least"), F.count("*").alias("rows"), F.first("bands").alias("bands"), F.first("n").alias("n")))
    node = node.withColumn("node", F.monotonically_increasing_id())  # over a stored table
    root = classes(texts, node.select("node", "digest", "bands", "n"), None, factor, cfg)
    ranked = stored(node.join(root, "node").select("root", "least", "digest", "rows"))
    first = ranked.groupBy("root").agg(F.min(F.struct("least", "digest", "rows")).alias("x")).select("x.least.doc_id", "x.digest", "x.rows")
    # of the text that stays, one row; most texts have one row alone
    key, name = unused(docs, "digest"), unused(docs, "stays")
    keyed = docs.withColumn(key, _digest(F.col("text").cast("string")))
    with_words = F.coalesce(F.col("text").cast("string").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    stays = first.select(F.col("digest").alias(name), F.col("doc_id").alias(name + "_id"), F.col("rows").alias(name + "_rows"))
    same = (F.col(key) == F.col(name)) & F.col("doc_id").cast("long").eqNullSafe(F.col(name + "_id"))
    picked = keyed.join(stays, same)
    single = picked.where(F.col(name + "_rows") == 1)
    several = picked.where(F.col(name + "_rows") > 1).dropDuplicates([key])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return single.select(*columns).union(several.select(*columns)).union(docs.where(~with_words).select(*columns))


def op5_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(ship(spark).read.parquet(f"{sf_dir}/documents.parquet"))
