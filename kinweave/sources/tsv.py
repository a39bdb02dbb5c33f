"""Unquoted TSV files of records, id lists and maps, as text lines: tabs split, nothing is ever a quote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

COLUMNS = ["entity_id", "business_name", "business_address", "country"]
GROUND_TRUTH_HEADER = "source1_entity_id\tmatched_entity_ids"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, value): lines in file order without BOM and line ends. Row numbers ascend with place in the file."""
    text = spark.read.text(path).select(F.monotonically_increasing_id().alias("row_no"), F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r+$", "").alias("value"))
    return text


def _header(rows: DataFrame) -> list[str]:
    first = rows.orderBy("row_no").first()
    return [h.strip().lower() for h in first["value"].split("\t")] if first else []


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, COLUMNS): a record a line, repaired as needed.

    With the usual four columns a line with more fields has its middle ones joined into the address; short lines are
    filled up with blanks; lines without an id go, and of one id the first line stays.
    """
    return parse_records(lines(spark, path))


def parse_records(rows: DataFrame) -> DataFrame:
    head = _header(rows)
    if "entity_id" not in head:
        raise ValueError(f"header {head} has no entity_id column")
    n = len(head)
    first = rows.agg(F.min("row_no").alias("m")).first()["m"]
    body = rows.where((F.col("row_no") > first) & (F.trim("value") != "")).withColumn("f", F.split("value", "\t", -1))
    if head == COLUMNS:
        long = F.concat(F.slice("f", 1, 2), F.array(F.array_join(F.slice("f", 3, F.size("f") - 3), " ")), F.slice("f", -1, 1))
        body = body.withColumn("f", F.when(F.size("f") > n, long).otherwise(F.col("f")))
    # F.get gives null past the end, which is the blank of a short line
    field = lambda c: F.trim(F.coalesce(F.get("f", F.lit(head.index(c))), F.lit(""))) if c in head else F.lit("")
    out = body.select("row_no", *[field(c).alias(c) for c in COLUMNS]).where("entity_id <> ''")
    w = W.partitionBy("entity_id").orderBy("row_no")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def read_id_map(spark: SparkSession, path: str, restrict: DataFrame | None = None, sample_mod: int = 1, header: str = "source1_entity_id") -> DataFrame:
    """(row_no, s1_id, ids): lists of ids by the first column; of one id the last line counts."""
    rows = parse_id_map(lines(spark, path), header)
    if restrict is not None:
        rows = rows.join(restrict.select("s1_id"), "s1_id", "left_semi")
    return rows.where(F.pmod(F.xxhash64("s1_id"), F.lit(sample_mod)) == 0) if sample_mod > 1 else rows


def parse_id_map(rows: DataFrame, header: str = "source1_entity_id") -> DataFrame:
    first = rows.agg(F.min("row_no")).first()[0]
    body = rows.where((F.col("value") != "") & ~((F.col("row_no") == F.lit(first)) & F.startswith("value", F.lit(header))))
    parts = F.split("value", "\t", 2)
    ids = F.filter(F.transform(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    out = body.select("row_no", F.get(parts, F.lit(0)).alias("s1_id"), ids.alias("ids"))
    w = W.partitionBy("s1_id").orderBy(F.desc("row_no"))
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def read_countries(spark: SparkSession, path: str, restrict: DataFrame | None = None) -> DataFrame:
    """(entity_id, country) of lines with four fields or more."""
    out = parse_countries(lines(spark, path))
    return out if restrict is None else out.join(restrict.select("entity_id"), "entity_id", "left_semi")


def parse_countries(rows: DataFrame) -> DataFrame:
    f = F.split("value", "\t", -1)
    first = rows.agg(F.min("row_no")).first()[0]
    return rows.where((F.col("row_no") > F.lit(first)) & (F.size(f) >= 4)).select(F.get(f, F.lit(0)).alias("entity_id"), F.get(f, F.lit(3)).alias("country"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return parse_ids(lines(spark, path))


def parse_ids(rows: DataFrame) -> DataFrame:
    return rows.where("value <> ''").select(F.get(F.split("value", "\t"), F.lit(0)).alias("id")).distinct()


def index_union(s2: DataFrame, s3: DataFrame) -> DataFrame:
    """Both index sources with ``src``; ids of the third that the second has too are dropped."""
    return s2.withColumn("src", F.lit(2)).unionByName(s3.join(s2.select("entity_id"), "entity_id", "left_anti").withColumn("src", F.lit(3)))


def explode_truth(id_map: DataFrame) -> DataFrame:
    return id_map.select(F.col("s1_id").alias("q_id"), F.explode("ids").alias("i_id"))


def resolve_truth(truth: DataFrame, q: DataFrame, idx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs whose ids are both known, and those that are not."""
    known = truth.join(q.select("q_id"), "q_id", "left_semi").join(idx.select("i_id"), "i_id", "left_semi")
    return known, truth.join(known, ["q_id", "i_id"], "left_anti")


def write_id_lists(lists: DataFrame, path: str, header: str, order: str = "row_no", files: int = 1) -> None:
    """Text in order of ``order``, header first, cut into so many files, each written by one task; read by name they are one list."""
    head = lists.sparkSession.createDataFrame([(-1, header)], "o long, value string")
    body = lists.select(F.col(order).cast("long").alias("o"), F.concat_ws("\t", "source1_entity_id", "ids").alias("value"))
    head.unionByName(body).repartitionByRange(files, "o").sortWithinPartitions("o").select("value").write.mode("overwrite").text(path)


def write_rows(rows: DataFrame, path: str) -> None:
    """A TSV of any rows, as example lists are kept."""
    rows.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]).alias("value")).write.mode("overwrite").text(path)


def read_group_sample(spark: SparkSession, path: str) -> DataFrame:
    """(s1_id, id, first record, record) of a JSON of groups and records."""
    doc = spark.read.schema("groups array<array<string>>, rec map<string, array<string>>").option("multiLine", True).json(path)
    group = doc.select("rec", F.explode("groups").alias("g"))
    ids = F.from_json(F.get("g", F.lit(1)), "array<string>")
    pairs = group.select("rec", F.get("g", F.lit(0)).alias("s1_id"), F.explode(ids).alias("id"))
    return pairs.select("s1_id", "id", F.try_element_at("rec", F.col("s1_id")).alias("rec1"), F.try_element_at("rec", F.col("id")).alias("rec2"))
