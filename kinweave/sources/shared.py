"""Tables that are written once to the folder all executors share and read there by tasks, a few row groups each."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group before compression, about: what a task reads at a time.
ROW_GROUP = 8 << 20
_made: list[str] = []
_hooked: list[SparkSession] = []


def _folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='kinweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found if "://" in found else f"file://{found}"


def release(spark: SparkSession) -> None:
    """Delete the tables of this process; what reads them is gone then."""
    context = spark.sparkContext
    while context._jsc is not None and _made:
        where = context._jvm.org.apache.hadoop.fs.Path(_made.pop())
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions inside send Python at most so many rows at a time: buffers of long rows stay small on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own, now = spark.conf.getAll.get(name), int(spark.conf.get(name))
    spark.conf.set(name, str(min(rows, now) if now > 0 else rows))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, own)


def stored(df: DataFrame, label: str, by: str | None = None) -> str:
    """Write ``df``, a folder a value of ``by``; the path. It stands until the process ends."""
    spark = df.sparkSession
    if spark not in _hooked:
        _hooked.append(spark)
        atexit.register(release, spark)
    _made.append(f"{_folder(spark)}/kinweave-{label}-{uuid.uuid4().hex}")
    writer = df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP)
    (writer.partitionBy(by) if by else writer).parquet(_made[-1])
    return _made[-1]


def row_groups(path: str) -> dict[str, list[tuple[str, int, int]]]:
    """Folder name -> (file, row group, its rows), for each file under ``path``."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, top = pafs.FileSystem.from_uri(path)
    out: dict[str, list[tuple[str, int, int]]] = {}
    for f in sorted(fs.get_file_info(pafs.FileSelector(top, recursive=True)), key=lambda f: f.path):
        if f.is_file and f.path.endswith(".parquet"):
            with fs.open_input_file(f.path) as file:
                meta = pq.ParquetFile(file).metadata
            out.setdefault(f.path.split("/")[-2].rpartition("=")[2], []).extend((f.path, g, meta.row_group(g).num_rows) for g in range(meta.num_row_groups))
    return out


def dealt(groups: list[tuple[str, int, int]], share: int, shares: int) -> list[tuple[str, int, int, int]]:
    """(file, row group, first row, end) of one of so many shares; row groups are cut where they are fewer than shares."""
    cuts = -(-shares // max(1, len(groups)))
    pieces = [(f, g, n * c // cuts, n * (c + 1) // cuts) for f, g, n in groups for c in range(cuts)]
    return [p for p in pieces[share::shares] if p[2] < p[3]]


def read(path: str, pieces: list[tuple[str, int, int, int]], columns: list[str]) -> Iterator[pa.RecordBatch]:
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, _ = pafs.FileSystem.from_uri(path)
    for f, g, a, z in pieces:
        with fs.open_input_file(f) as file:
            rows = pq.ParquetFile(file).read_row_group(g, columns=columns, use_threads=False).slice(a, z - a)
        yield from rows.combine_chunks().to_batches()
