"""Persisted stages: Parquet under a folder named by the configuration and the inputs, so results of other knobs or other data are never taken up."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..config import Config


def fingerprint(*inputs: DataFrame) -> str:
    """Names what the inputs hold: paths, sizes and times of the files they read, the plan of inputs without files."""
    said = []
    for df in inputs:
        context = df.sparkSession.sparkContext
        for f in sorted(df.inputFiles()):
            path = context._jvm.org.apache.hadoop.fs.Path(f)
            status = path.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(path)
            said.append(f"{f} {status.getLen()} {status.getModificationTime()}")
        if not df.inputFiles():
            said.append(str(df.semanticHash()))
        said.append(",".join(df.columns))
    return hashlib.sha256("\n".join(said).encode()).hexdigest()[:12]


def stage(spark: SparkSession, base: str, cfg: Config, name: str, make: Callable[[], DataFrame], force: bool = False, inputs: str = "") -> DataFrame:
    """The stage's rows, made and written unless they are there already or ``force`` is set. ``inputs``: their fingerprint."""
    path = f"{_folder(base, cfg, inputs)}/{name}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if force or not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _folder(base: str, cfg: Config, inputs: str) -> str:
    return f"{base}/{cfg.key()}{'-' + inputs if inputs else ''}"


def drop_stage(spark: SparkSession, base: str, cfg: Config, name: str, inputs: str = "") -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{_folder(base, cfg, inputs)}/{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def save_report(spark: SparkSession, path: str, report: dict) -> None:
    spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_report(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r["value"] for r in spark.read.text(path).collect()))
