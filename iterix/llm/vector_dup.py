"""Near-duplicate vectors by randomised-rotation binary codes.

A vector, scaled to length 1, is turned by random rotations; the signs of the result are
its code (Gao and Long 2024), and the inner product of the code with the turned vector
is the correction factor that is stored with it.

* Candidates: the code is cut into bands; vectors that agree in a band meet there. At a
  cosine of 0.95 two signs agree with probability p = 1 - acos(0.95) / pi = 0.899. A band has as
  many bits as the table needs for a vector to meet about one other by chance, and there are
  as many bands as leave a share of `miss` of the pairs at the threshold apart: so recall is
  the same at every size, and random meetings grow with the table, not with its square.
* Estimates: only codes meet: signs, factor, and the first turned vector in 8 bits. Code times
  turned vector over the correction factor estimates every inner product without bias, with an
  error of about sqrt((1 - f^2) / f^2 / (d - 1)), and of at most what the 8 bits leave. Only pairs
  whose upper confidence bound reaches the threshold get their vectors, and are computed
  exactly, in double precision; nothing below the threshold is linked.
* A pair that meets in several bands counts in the first of them only.
* Where so many pairs of a bucket are left that they outweigh its vectors, no pair is emitted:
  the vectors come to the bucket, which returns numbers of links and a spanning forest.

Equal vectors are one node with a count, so copies cost one row. A bucket over a stated size
is dealt out as pairs of slices, which cover all its pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing; vectors of different lengths do not link; rows that share a vec_id and
a vector are one vector, given each; rows that share a vec_id share a component, and each
has the links of its own vector; a null vec_id links with nothing, has a null component and
is kept; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iterix.llm._links import components, stored
from iterix.llm._text import mix
from iterix.session import ship


@dataclass(frozen=True)
class VectorDupConfig:
    threshold: float = 0.95
    miss: float = 0.007
    least_bits: int = 16
    confidence: float = 3.0  # standard errors
    slice_vectors: int = 2048
    dense: int = 8  # pairs for each vector of a bucket from which on vectors come to it
    seed: int = 23


@dataclass(frozen=True)
class Shape:
    """Bits of a band, and bands."""

    bits: int
    bands: int


def shape(n: int, cfg: VectorDupConfig) -> Shape:
    bits = min(60, max(cfg.least_bits, math.ceil(math.log2(max(n, 1))) + 1))
    meet = (1 - math.acos(cfg.threshold) / math.pi) ** bits
    return Shape(bits, math.ceil(math.log(cfg.miss) / math.log1p(-meet)))


_rotations: dict[tuple, np.ndarray] = {}


def rotations(d: int, signs: int, seed: int) -> np.ndarray:
    """As many d x d rotations, side by side, as that number of signs needs."""
    key = (d, signs, seed)
    if key not in _rotations:
        g = np.random.default_rng([seed, d])
        _rotations[key] = np.concatenate([np.linalg.qr(g.standard_normal((d, d)))[0] for _ in range(-(-signs // d))], axis=1)
    return _rotations[key]


def _usable(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of the usable vectors of a column, by length. Arithmetic starts from the components as they are stored."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.asarray(column.value_lengths().fill_null(0))
    whole = column.fill_null([])
    flat = whole.flatten()
    values = np.asarray(flat.fill_null(np.nan), dtype=np.float64)
    start = np.cumsum(lengths) - lengths
    for d in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == d)
        x = values[start[at][:, None] + np.arange(d)]
        with np.errstate(over="ignore", invalid="ignore"):
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
        yield at[ok], x[ok]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def band_keys(signs: np.ndarray, of: Shape) -> np.ndarray:
    """The band keys of rows of packed signs."""
    bits = np.unpackbits(signs, axis=1, count=of.bits * of.bands).reshape(len(signs), of.bands, of.bits)
    return bits @ (np.int64(1) << np.arange(of.bits, dtype=np.int64))


def encode(x: np.ndarray, of: Shape, cfg: VectorDupConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, correction factors, the first turned vectors in 8 bits, their scales) of unit vectors. One vector at a time gives the same bits as many."""
    d = x.shape[1]
    turned = np.einsum("nd,dk->nk", x, rotations(d, max(d, of.bits * of.bands), cfg.seed))
    own = turned[:, :d]
    factor = np.abs(own).sum(1) / np.sqrt(d)
    scale = np.maximum(np.abs(own).max(1), 1e-30) / 127
    return np.packbits(turned > 0, axis=1), factor.astype(np.float32), np.rint(own / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def codes(vectors: DataFrame, of: Shape, cfg: VectorDupConfig) -> DataFrame:
    """vec_id, digest, dim, vector, buckets, signs, factor, turned and scale of every row; all but the first null where a row links with nothing."""
    names = ["vec_id", "digest", "dim", "vector", "buckets", "signs", "factor", "turned", "scale"]
    kinds = [pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.float32(), pa.binary(), pa.float32()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, other = batch.column(0), np.ones(batch.num_rows, bool)
            has_id = np.asarray(ids.is_valid())
            for at, x in _usable(batch.column(1)):
                at, x = at[has_id[at]], x[has_id[at]]
                if not len(at):
                    continue
                other[at] = False
                signs, factor, turned, scale = encode(unit(x), of, cfg)
                # one number for a band's key, the band and the length
                salt = mix(np.arange(of.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(x.shape[1]))
                buckets = mix(band_keys(signs, of).astype(np.uint64) + salt).view(np.int64)
                raw = [r.tobytes() for r in x + 0.0]
                digest = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
                columns = [digest, np.full(len(at), x.shape[1], np.int32), raw, list(buckets), [k.tobytes() for k in signs], factor, [k.tobytes() for k in turned], scale]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *map(pa.array, columns, kinds)], names)
            rest = ids.filter(pa.array(other))
            yield pa.RecordBatch.from_arrays([rest, *(pa.nulls(len(rest), k) for k in kinds)], names)

    return vectors.mapInArrow(rows, "vec_id long, digest binary, dim int, vector binary, buckets array<long>, signs binary, factor float, turned binary, scale float")


def hopeful(code: np.ndarray, factor: np.ndarray, turned: np.ndarray, scale: np.ndarray, start: np.ndarray, side: np.ndarray, two: np.ndarray, cfg: VectorDupConfig) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs within units whose upper bound reaches the threshold. Units follow each other from start on; in those with two slices only pairs across them.

    code: signs as 1 and -1; turned: in 8 bits."""
    n, d = code.shape
    own = turned.astype(np.float32) * scale[:, None]
    code = code / (np.sqrt(np.float32(d)) * factor[:, None])
    error = cfg.confidence * np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / max(1, d - 1))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ends = np.append(start[1:], n)
    unit_of = np.repeat(np.arange(len(start)), ends - start)
    small = ends - start <= 64
    # many small units: pair by pair
    after = np.where(small[unit_of], ends[unit_of] - np.arange(n) - 1, 0)
    cut = np.searchsorted(np.cumsum(after), np.arange(0, int(after.sum()) + (1 << 16), 1 << 16))
    for lo, hi in zip(cut, np.append(cut[1:], n)):
        k = np.arange(lo, hi)
        i = np.repeat(k, after[lo:hi])
        if len(i):
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after[lo:hi]) - after[lo:hi], after[lo:hi])
            bound = np.einsum("nd,nd->n", own[i], code[j]) + error[j] + np.sqrt(d) * scale[i] / 2 / factor[j]
            ok = np.flatnonzero(bound >= cfg.threshold)
            left.append(i[ok])
            right.append(j[ok])
    for u in np.flatnonzero(~small).tolist():  # large ones: by blocks
        for lo in range(start[u], ends[u], 512):
            hi = min(ends[u], lo + 512)
            bound = own[lo:hi] @ code[lo : ends[u]].T + error[lo : ends[u]] + np.sqrt(d) * scale[lo:hi, None] / 2 / factor[lo : ends[u]]
            i, j = np.nonzero(bound >= cfg.threshold)
            ok = j > i
            left.append(i[ok] + lo)
            right.append(j[ok] + lo)
    i, j = np.concatenate(left), np.concatenate(right)
    ok = ~two[unit_of[i]] | (side[i] != side[j])
    return i[ok], j[ok]


def linked(x: np.ndarray, keys: np.ndarray, i: np.ndarray, j: np.ndarray, copies: np.ndarray, band: int, cfg: VectorDupConfig) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(links of each vector, a spanning forest) of pairs of unit vectors of a bucket, less those that met in an earlier band."""
    links, forest = np.zeros(len(x), np.int64), []
    parent = list(range(len(x)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for lo in range(0, len(i), 65536):
        a, b = i[lo : lo + 65536], j[lo : lo + 65536]
        same = np.einsum("nd,nd->n", x[a], x[b]) >= cfg.threshold
        a, b = a[same], b[same]
        new = ~(keys[a, :band] == keys[b, :band]).any(1)
        a, b = a[new], b[new]
        links += np.bincount(a, weights=copies[b], minlength=len(x)).astype(np.int64) + np.bincount(b, weights=copies[a], minlength=len(x)).astype(np.int64)
        for p, q in zip(a.tolist(), b.tolist()):
            rp, rq = find(p), find(q)
            if rp != rq:
                parent[rp] = rq
                forest.append((p, q))
    return links, forest


def _fixed(column: pa.Array, kind) -> np.ndarray:
    """Rows of a binary column of equal sizes."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _units(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole units of one length with the places where they start; batches are sorted by keys, of which the first is the length."""
    held = None
    for batch in itertools.chain(batches, [None]):
        table = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if table is None or not table.num_rows:
            continue
        table = table.combine_chunks()
        columns = [np.asarray(table[k].chunk(0)) for k in keys]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        start = np.flatnonzero(new)
        end = table.num_rows if batch is None else int(start[-1])
        held = table.slice(end)
        start = start[start < end]
        if len(start):
            dim = columns[0][start]
            cuts = [0, *(np.flatnonzero(dim[1:] != dim[:-1]) + 1).tolist(), len(start)]
            for a, b in zip(cuts, cuts[1:]):
                lo, hi = int(start[a]), int(start[b]) if b < len(start) else end
                yield table.slice(lo, hi - lo).combine_chunks(), start[a:b] - lo


KEY = ["dim", "bucket", "lo", "hi"]


def candidates(placed: DataFrame, of: Shape, cfg: VectorDupConfig) -> DataFrame:
    """Of units of codes: pairs (a, b) to be computed, each in its first band; or, where there are too many, the unit (dim, bucket, lo, hi)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("dim", pa.int32()), ("bucket", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in _units(batches, KEY):
            get = lambda name: table[name].chunk(0)
            signs, d = _fixed(get("signs"), np.uint8), int(np.asarray(get("dim"))[0])
            code = np.unpackbits(signs, axis=1, count=d).astype(np.float32) * 2 - 1
            two, side, node = (np.asarray(get("lo")) != np.asarray(get("hi")))[start], np.asarray(get("side")), np.asarray(get("node"))
            i, j = hopeful(code, np.asarray(get("factor")), _fixed(get("turned"), np.int8), np.asarray(get("scale")), start, side, two, cfg)
            ends = np.append(start[1:], len(node))
            unit_of = np.searchsorted(start, i, "right") - 1
            dense = np.bincount(unit_of, minlength=len(start)) > cfg.dense * (ends - start)
            keys = np.asarray(get("band"))
            ok = ~dense[unit_of]
            i, j = i[ok], j[ok]
            a, b = band_keys(signs[i], of), band_keys(signs[j], of)
            met = (a == b) & (np.arange(of.bands) < keys[i][:, None])
            i, j = i[~met.any(1)], j[~met.any(1)]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j]), *(pa.nulls(len(i), f.type) for f in list(schema)[2:])], schema=schema)
            at = start[dense]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), *(get(k).take(pa.array(at)).cast(schema.field(k).type) for k in KEY)], schema=schema)

    return placed.mapInArrow(estimate, "a long, b long, dim int, bucket long, lo int, hi int")


_LINKS = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _links(node: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(a), pa.int64()), pa.nulls(len(node), pa.int64())]
    columns = [pa.concat_arrays([pa.array(x, pa.int64()), none[0]]) for x in (node, n)] + [pa.concat_arrays([none[1], pa.array(x, pa.int64())]) for x in (a, b)]
    return pa.RecordBatch.from_arrays(columns, schema=_LINKS)


def pair_links(pairs: DataFrame, nodes: DataFrame, cfg: VectorDupConfig) -> DataFrame:
    """(node, n): links of single pairs; (a, b): the pairs that are linked."""
    end = lambda k: nodes.select(F.col("node").alias(k), "dim", F.col("vector").alias("v" + k), F.col("copies").alias("c" + k))
    both = pairs.join(end("a"), "a").join(end("b").drop("dim"), "b").select("dim", "a", "b", "va", "vb", "ca", "cb")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = np.asarray(batch.column(0))
            for d in np.unique(dim).tolist():
                rows = batch.take(pa.array(np.flatnonzero(dim == d)))
                x, y = (unit(_fixed(rows.column(k), np.float64)) for k in (3, 4))
                ok = np.flatnonzero(np.einsum("nd,nd->n", x, y) >= cfg.threshold)
                a, b, ca, cb = (np.asarray(rows.column(k))[ok] for k in (1, 2, 5, 6))
                yield _links(np.concatenate([a, b]), np.concatenate([cb, ca]), a, b)

    return both.mapInArrow(exact, "node long, n long, a long, b long")


def unit_links(placed: DataFrame, of: Shape, cfg: VectorDupConfig) -> DataFrame:
    """As pair_links, of whole units with their vectors; (a, b) is a spanning forest."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in _units(batches, KEY):
            ends = np.append(start[1:], table.num_rows)
            for lo, hi in zip(start.tolist(), ends.tolist()):
                rows = table.slice(lo, hi - lo).combine_chunks()
                get = lambda name: rows[name].chunk(0)  # noqa: B023, E731
                signs, d, node = _fixed(get("signs"), np.uint8), get("dim")[0].as_py(), np.asarray(get("node"))
                two = np.array([get("lo")[0].as_py() != get("hi")[0].as_py()])
                code = np.unpackbits(signs, axis=1, count=d).astype(np.float32) * 2 - 1
                i, j = hopeful(code, np.asarray(get("factor")), _fixed(get("turned"), np.int8), np.asarray(get("scale")), np.zeros(1, np.int64), np.asarray(get("side")), two, cfg)
                links, forest = linked(unit(_fixed(get("vector"), np.float64)), band_keys(signs, of), i, j, np.asarray(get("copies")), get("band")[0].as_py(), cfg)
                full, tree = np.flatnonzero(links), np.array(forest, np.int64).reshape(-1, 2)
                yield _links(node[full], links[full], node[tree[:, 0]], node[tree[:, 1]])

    return placed.mapInArrow(verify, "node long, n long, a long, b long")


def near_vectors(vectors: DataFrame, cfg: VectorDupConfig = VectorDupConfig()) -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reachable by links), kept (vec_id is it) for every row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    of = shape(given.count(), cfg)
    coded = stored(codes(given, of, cfg))
    usable = coded.where("digest is not null")
    ids = usable.select("vec_id", "digest").distinct()
    count = ids.groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # a node stands for a vector; its number, not its id, since rows that share an id can hold several
    first = usable.select("digest", "dim", "vector", "buckets", "signs", "factor", "turned", "scale").dropDuplicates(["digest"]).join(count, "digest")
    nodes = stored(first).withColumn("node", F.monotonically_increasing_id())
    met = nodes.select("node", "dim", F.posexplode("buckets").alias("band", "bucket"))
    size = met.groupBy("dim", "bucket").agg(F.count("*").alias("members")).where("members > 1")
    met = met.join(size, ["dim", "bucket"]).withColumn("slices", F.ceil(F.col("members") / cfg.slice_vectors).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    units = stored(met.select("node", "dim", "bucket", "band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("side")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def placed(rows: DataFrame, *more: str) -> DataFrame:
        rows = rows.join(nodes.select("node", "signs", "factor", "turned", "scale", *more), "node")
        return rows.repartition(parts, *KEY).sortWithinPartitions(*KEY)

    found = stored(candidates(placed(units), of, cfg))
    pairs = pair_links(found.where("a is not null").select("a", "b"), nodes, cfg)
    dense = unit_links(placed(units.join(found.where("a is null").select(*KEY), KEY, "left_semi"), "vector", "copies"), of, cfg)
    links = stored(pairs.union(dense))
    counted = links.where("node is not null").groupBy("node").agg(F.sum("n").alias("n"))
    per_node = nodes.select("node", "digest", "least", "copies").join(counted, "node", "left").select("node", "digest", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    per_node = stored(per_node)
    name = per_node.select("node", "least")
    near = links.where("a is not null").select("a", "b").join(name.toDF("a", "id_a"), "a").join(name.toDF("b", "id_b"), "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    # ids with several vectors tie those; other copies follow their vector
    several = ids.groupBy("vec_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("vec_id")
    tied = ids.join(several, "vec_id").join(per_node.select("digest", "least"), "digest").where("vec_id <> least").select(F.col("vec_id").alias("a"), F.col("least").alias("b"))
    roots = components(near.union(tied)).select(F.col("node").alias("least"), "root")
    rows = coded.select("vec_id", "digest").join(per_node.drop("node"), "digest", "left").join(roots, "least", "left")
    component = F.coalesce("root", "least", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op9_vector_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs: for tables of some thousand vectors.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
c AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.c, e.vec_id) AS component_id, coalesce(e.vec_id = coalesce(c.c, e.vec_id), true) AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN c ON e.vec_id = c.a
"""
