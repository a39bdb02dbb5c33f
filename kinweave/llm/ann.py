"""Approximate nearest neighbours by cross-polytope hashing.

A vector is scaled to length one and turned by pseudo-rotations, each a Hadamard transform after random sign flips;
a hash is the nearest signed axis. A table joins the axes of ``HASHES`` rotations to a bucket; a query also probes the
buckets that its next best axes name, in order of what they lose. Candidates of all tables are ranked again by the exact
inner product of the original vectors in double precision.

Data rows are dealt by bucket; a bucket with more rows than ``BUCKET_ROWS`` is split into that many slots by a hash of
the id, and its queries go to every slot, so no task holds an unbounded bucket. Slots keep each query's best k rows only
(those of all slots hold the best k of the bucket), and partial lists are merged by query in two rounds, the first over
a share of the slots, so that no task gathers them all. Where fewer than k neighbours came back, that query is compared
with all rows, in blocks that tasks read from a stored table. :func:`sized` chooses hashes, tables and probes by the
number of rows: more hashes make smaller buckets for larger tables, and need more tables and probes for the same recall,
over nine in ten of the 20 nearest even where neighbours are hardly closer than other rows.

Null or zero vectors and vectors with null or non-finite components or of another length than most take no part. Rows
with one id all take part; a query's own id is left out. Ties go to the smaller id. Columns but id and vector are left
out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .files import reader

ROUNDS = 3
#: (rows up to, tables, hashes, probes). Buckets number (2 x length) ** hashes.
SIZES = ((1_000_000, 10, 1, 8), (300_000_000, 32, 2, 48), (None, 96, 3, 160))
BUCKET_ROWS = 4096
_ASKED, _ROWS, _PARTS = 64, 4096, 64


def sized(rows: int) -> tuple[int, int, int]:
    """Tables, hashes and probes for so many rows."""
    return next((t, h, p) for most, t, h, p in SIZES if most is None or rows <= most)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised Walsh-Hadamard transform of rows whose length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), -1, 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


class Tables:
    """Pseudo-rotations of all tables for vectors of one length."""

    def __init__(self, dim: int, tables: int, hashes: int, probes: int, seed: int = 7):
        self.dim, self.tables, self.hashes, self.probes = dim, tables, hashes, probes
        self.size = 1 << max(0, dim - 1).bit_length()
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, hashes, ROUNDS, self.size))

    def _turned(self, x: np.ndarray, table: int, h: int) -> np.ndarray:
        y = np.zeros((len(x), self.size))
        y[:, : self.dim] = x / np.linalg.norm(x, axis=1, keepdims=True)
        for r in range(ROUNDS):
            y = hadamard(y * self.signs[table, h, r])
        return y

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): the bucket of each vector."""
        out = np.zeros((len(x), self.tables), np.int64)
        for t in range(self.tables):
            for h in range(self.hashes):
                y = self._turned(x, t, h)
                axis = np.abs(y).argmax(axis=1)
                out[:, t] = out[:, t] * (2 * self.size) + 2 * axis + (y[np.arange(len(y)), axis] < 0)
        return out

    def probed(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, probes): the buckets to look into, own bucket first, others by what they lose."""
        out = np.zeros((len(x), self.tables, self.probes), np.int64)
        for t in range(self.tables):
            code, lost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
            for h in range(self.hashes):
                y = self._turned(x, t, h)
                both = np.concatenate([y, -y], axis=1)
                n = min(self.probes, both.shape[1])
                top = np.argsort(-both, axis=1, kind="stable")[:, :n]
                gain = np.take_along_axis(both, top, axis=1)
                axis = 2 * (top % self.size) + top // self.size
                # the axis in front of y is counted as positive, as in buckets()
                more_code = (code[:, :, None] * (2 * self.size) + axis[:, None, :]).reshape(len(x), -1)
                more_lost = (lost[:, :, None] + ((gain[:, :1] - gain) ** 2)[:, None, :]).reshape(len(x), -1)
                keep = np.argsort(more_lost, axis=1, kind="stable")[:, : self.probes]
                code, lost = np.take_along_axis(more_code, keep, axis=1), np.take_along_axis(more_lost, keep, axis=1)
            out[:, t] = np.pad(code, ((0, 0), (0, self.probes - code.shape[1])), mode="edge")
        return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(vid, vec) of the rows that take part, and the vectors' length: the most frequent one."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vid"), vec.alias("vec")).where("vid is not null and vec is not null")
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.where(sound)
    top = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = top["n"] if top else 1
    return rows.where(F.size("vec") == dim), dim


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to smaller ids."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the order of the components whatever the block."""
    out = np.zeros((len(q), len(x)))
    for a, b in zip(q.T, np.ascontiguousarray(x.T), strict=True):
        out += a[:, None] * b[None, :]
    return out


_FOUND = "qid long, vid long, score double, part int"


def _batch(rows: list[tuple[int, np.ndarray, np.ndarray]], part: int) -> pa.RecordBatch:
    q = np.concatenate([np.full(len(v), i) for i, v, _ in rows]) if rows else np.zeros(0, np.int64)
    v = np.concatenate([v for _, v, _ in rows]) if rows else np.zeros(0, np.int64)
    s = np.concatenate([s for _, _, s in rows]) if rows else np.zeros(0)
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64()), pa.array(np.full(len(q), part % _PARTS, np.int32))], ["qid", "vid", "score", "part"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """(qid, rank, vid, score) from (qid, vid, score, part): the best k of each query; of each part first, then of all."""
    top = lambda rows, by: rows.groupBy(*by).agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("down"), "vid"))), 1, k).alias("best"))
    some = top(found, ["qid", "part"]).select("qid", F.explode("best").alias("hit"))
    best = top(some.select("qid", "hit.vid", (-F.col("hit.down")).alias("score")), ["qid"])
    out = best.select("qid", F.posexplode("best").alias("at", "hit"))
    return out.select("qid", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vid").alias("vid"), (-F.col("hit.down")).alias("score"))


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", tables: int | None = None, hashes: int | None = None, probes: int | None = None) -> DataFrame:
    """(qid, rank, vid, score): up to k nearest rows of ``vectors`` for each row of ``queries``, never the query's own id."""
    spark = vectors.sparkSession
    rows, dim = usable(vectors, id_col, vec_col)
    asked = usable(queries, id_col, vec_col)[0].where(F.size("vec") == dim)
    given, chosen = (tables, hashes, probes), sized(rows.count() if None in (tables, hashes, probes) else 0)
    tables, hashes, probes = (c if g is None else g for g, c in zip(given, chosen, strict=True))
    shared = spark.sparkContext.broadcast(Tables(dim, tables, hashes, probes))
    n_parts = C.partitions(spark)

    def keys(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column(1), dim)
                if not len(x):
                    continue
                t = shared.value
                code = t.probed(x) if query else t.buckets(x)[:, :, None]
                code = (code * tables + np.arange(tables)[None, :, None]).reshape(len(x), -1)
                # a bucket is asked once, however many probes name it
                parts = [np.unique(c) for c in code] if query else list(code)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.list_(pa.int64())), b.column(1)], ["vid", "buckets", "vec"])

        return run

    kind = "vid long, buckets array<long>, vec array<double>"
    data = C.mapped(rows, keys(False), kind, _ROWS)
    probe = C.mapped(asked, keys(True), kind, _ROWS)
    sizes = data.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    slots = C.stored(sizes.select("bucket", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("slots")), "ann-buckets")
    asked_rows = probe.select("vid", "vec", F.explode("buckets").alias("bucket")).join(slots, "bucket")
    asked_rows = asked_rows.select("bucket", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(True).alias("query"), "vid", "vec")
    held = data.select("vid", "vec", F.explode("buckets").alias("bucket")).join(slots, "bucket")
    held = held.select("bucket", F.pmod(F.xxhash64("vid"), "slots").cast("int").alias("slot"), F.lit(False).alias("query"), "vid", "vec")
    # rows of a slot together, its data before its queries
    dealt = asked_rows.unionByName(held).repartition(n_parts, "bucket", "slot").sortWithinPartitions("bucket", "slot", "query", "vid")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, ids, mats, part = None, [], [], TaskContext.get().partitionId()
        for b in batches:
            bucket, s, query = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            vid, x = b.column(3).to_numpy(), _matrix(b.column(4), dim)
            cut = np.flatnonzero((bucket[1:] != bucket[:-1]) | (s[1:] != s[:-1]) | (query[1:] != query[:-1])) + 1
            out = []
            for a, z in zip([0, *cut], [*cut, len(vid)], strict=True):
                if a == z:
                    continue
                if slot != (bucket[a], s[a]):
                    slot, ids, mats = (bucket[a], s[a]), [], []
                if not query[a]:
                    ids.append(vid[a:z])
                    mats.append(x[a:z])
                elif ids:
                    if len(ids) > 1:
                        ids, mats = [np.concatenate(ids)], [np.concatenate(mats)]
                    for p in range(a, z, _ASKED):
                        scores = exact_scores(x[p : min(p + _ASKED, z)], mats[0])
                        for q, row in zip(vid[p:z], scores, strict=False):
                            row = np.where(ids[0] == q, -np.inf, row)
                            best = _best(row, ids[0], k)
                            best = best[row[best] > -np.inf]
                            out.append((q, ids[0][best], row[best]))
            yield _batch(out, part)

    found = C.mapped(dealt, meet, _FOUND, _ROWS)
    # partial lists of one query come from many slots: equal pairs are dropped, then the k best of each are kept
    ranked = C.stored(_ranked(found, k), "ann-found", rows=_ROWS)
    short = asked.join(ranked.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") >= k), F.col("vid") == F.col("qid"), "left_anti")
    short = C.stored(short.select("vid", "vec"), "ann-short")
    if short.isEmpty():
        return ranked
    return ranked.join(short.select(F.col("vid").alias("qid")).distinct(), "qid", "left_anti").unionByName(exact(rows, short, dim, k))


def exact(rows: DataFrame, asked: DataFrame, dim: int, k: int) -> DataFrame:
    """The k nearest by comparing each query with all rows, in one pass over these: each batch of rows meets the queries in
    blocks, read from their table (stored: its files are open to all tasks)."""
    files = asked.inputFiles()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for b in batches:
            vid, x = b.column(0).to_numpy(), _matrix(b.column(1), dim)
            for name in files:
                with reader(name) as f:
                    for block in pq.ParquetFile(f).iter_batches(_ASKED, columns=["vid", "vec"]):
                        out, q = [], block.column(0).to_numpy()
                        for i, row in zip(q, exact_scores(_matrix(block.column(1), dim), x), strict=True):
                            row = np.where(vid == i, -np.inf, row)
                            best = _best(row, vid, k)
                            best = best[row[best] > -np.inf]
                            out.append((i, vid[best], row[best]))
                        yield _batch(out, part)

    return _ranked(C.mapped(rows, run, _FOUND, _ROWS), k)


QUERY_EVERY, NEIGHBOURS = 20, 20


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = search(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0), NEIGHBOURS)
    return found.select(F.col("qid").alias("query_id"), "rank", F.col("vid").alias("vec_id"), "score")
