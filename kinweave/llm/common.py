"""Shared plumbing of the training-data operators.

Nothing here touches a machine-local folder on a cluster: scratch data lives
under ``spark.checkpoint.dir`` as the session names it.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a null document id inside the operators; sorts after every id.
NULL_ID = 2**63 - 1
#: Rows per Arrow batch: whole texts travel in it, so the batch stays small.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A temporary one is made only in local mode, where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='kinweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Scratch folders of this process that still stand.
_made: list[str] = []
_hooked: list[SparkSession] = []


def scratch(spark: SparkSession, label: str) -> str:
    if spark not in _hooked:
        _hooked.append(spark)
        atexit.register(release, spark)
    _made.append(f"{shared_dir(spark)}/kinweave-{label}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession, made: list[str] | None = None) -> None:
    """Delete scratch folders, all of this process by default; tables that were read from them are gone then."""
    context = spark.sparkContext
    if context._jsc is None:
        return
    for path in list(_made if made is None else made):
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
        if path in _made:
            _made.remove(path)


@contextmanager
def cleaned(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Delete the scratch folders that are made inside and that nothing reads afterwards: all but those of the labels to keep."""
    before = len(_made)
    yield
    release(spark, [p for p in _made[before:] if not any(f"/kinweave-{label}-" in p for label in keep)])


@contextmanager
def batch_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """For an action that runs inside: Arrow batches of at most ``rows`` rows, so that both sides of the pipe hold few
    texts at a time. The session's setting is put back afterwards; results that run later follow that."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own, now = spark.conf.getAll.get(key), int(spark.conf.get(key))
    spark.conf.set(key, str(min(rows, now) if now > 0 else rows))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, own)


def stored(df: DataFrame, label: str, codec: str = "snappy", rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    zstd takes less disk, but its native buffers add to an executor's memory outside the heap.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    with batch_rows(spark, rows):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches of at most ``rows`` rows, whatever the session's setting is."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
        # workers wait for other tasks: what this one took goes back to the system
        pa.default_memory_pool().release_unused()
        _trim()

    return df.mapInArrow(sliced, schema)


def _trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        return


#: A key with over one in HEAVY of all rows is hot: there are fewer than HEAVY of them, whatever the data.
HEAVY = 1000


def joined(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Join with ``right``, one row a key with the number of rows of ``left`` it meets. Both are stored tables.

    Hot keys, fewer than HEAVY by that number, meet their rows by broadcast, so these stay where they are; the others
    meet by shuffle, where none has more than one in HEAVY of the rows.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(right.where(F.col(weight) > total // HEAVY).drop(weight))
    cold = right.where(F.col(weight) <= total // HEAVY).drop(weight)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return left.join(hot, on).unionByName(rest.join(cold, on, how))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, text, rest): id with null mapped to NULL_ID, text with null mapped to empty, every input column in ``rest``.

    Input columns ride in one struct, so their names never clash with the operator's own.
    """
    did = F.coalesce(named(id_col).cast("long"), F.lit(NULL_ID))
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    rest = F.struct(*[named(c).alias(c) for c in docs.columns if c != text_col])
    return docs.select(did.alias("did"), text.alias("text"), rest.alias("rest"))


def fields(*pairs: tuple[str, str | T.DataType] | str) -> T.StructType:
    """A schema from (name, type) pairs and DDL strings; any column name is fine inside a type."""
    out = T.StructType()
    for p in pairs:
        if isinstance(p, str):
            out = T.StructType(out.fields + T.StructType.fromDDL(p).fields)
        else:
            out = out.add(p[0], T.StructType.fromDDL(f"x {p[1]}")["x"].dataType if isinstance(p[1], str) else p[1])
    return out


def named(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    return F.struct(*[named(c).alias(c) for c in df.columns])


def plain_id(did: str = "did") -> Column:
    return F.when(F.col(did) != NULL_ID, F.col(did))


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def texts_of(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """UTF-8 bytes of a string column without decoding it."""
    col = batch.column(batch.schema.get_field_index(name))
    col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    for x in col:
        yield x.as_py() or b""


# --- a bit filter of fixed size over 64-bit keys -------------------------------------------------

FILTER_BITS = 30
_SEGMENT = 20


_PROBES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [((keys * m) >> np.uint64(64 - bits)).astype(np.int64) for m in _PROBES]


def bit_filter(keys: DataFrame, column: str, max_bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap with four bits for each key: 32 to 64 bits a key, 2**max_bits (128 MB by default) at most.

    Tests against it may say yes wrongly, never no wrongly; users do an exact check afterwards, so a full bitmap costs
    work and nothing else. Keys are dealt by bitmap segment, each task builds its segments, and only the finished
    bitmap reaches the driver.
    """
    spark = keys.sparkSession
    with cleaned(spark):
        return _bitmap(spark, stored(keys.select(column), "filter-keys"), max_bits)


def _bitmap(spark: SparkSession, keys: DataFrame, max_bits: int) -> np.ndarray:
    bits = min(max_bits, max(16, (32 * keys.count()).bit_length()))
    seg_bits = min(_SEGMENT, bits)
    words = 2**seg_bits // 8

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(_places(b.column(0).to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> seg_bits), pa.array(at)], ["seg", "bit"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for b in batches:
            bit = b.column(0).to_numpy()
            for s in np.unique(bit >> seg_bits):
                maps.setdefault(int(s), np.zeros(words * 8, bool))[bit[bit >> seg_bits == s] & (2**seg_bits - 1)] = True
        for s, m in maps.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([np.packbits(m, bitorder="little").tobytes()], pa.binary())], ["seg", "bits"])

    dealt = keys.mapInArrow(places, "seg long, bit long").repartition(min(2 ** (bits - seg_bits), partitions(spark)), "seg")
    out = np.zeros(2**bits // 8, np.uint8)
    for row in dealt.select("bit").mapInArrow(build, "seg long, bits binary").toLocalIterator():
        at = row["seg"] * words
        out[at : at + words] |= np.frombuffer(row["bits"], np.uint8)
    return out


def in_filter(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for at in _places(keys.astype(np.uint64, copy=False), bitmap.size.bit_length() + 2):
        found &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return found


# --- 64-bit mixing -------------------------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def connected_components(nodes_edges: DataFrame, label: str) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps. Each step groups by node, keeps only a minimum and a row
    per neighbour (never a list), and is checkpointed, so no step grows lineage. A hub's minimum is pre-aggregated
    before the shuffle; minima are checkpointed by themselves, so the join with them deals both sides anew and adaptive
    execution can split a hub's rows.
    """
    shared_dir(nodes_edges.sparkSession)
    edges = nodes_edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct().checkpoint()
    before = None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("lo < hi").distinct().checkpoint()
        low = large.groupBy("hi").agg(F.min("lo").alias("m")).checkpoint()
        small = large.join(low, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.lo", "e.hi").where("lo < hi").distinct()
        edges = small.checkpoint()
        # a star forest: no centre is a leaf, and each leaf has one centre; two sums tell whether a round changed anything
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        before = now
