"""Checks of result files as rows of (rule, severity, s1_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_lists(entities: DataFrame, pairs: DataFrame, score: str, order: str = "row_no") -> DataFrame:
    """(source1_entity_id, ids, row_no): one row an entity, ids by falling score without repeats, index ids only."""
    ok = pairs.where(F.col("i_id").rlike("^S[23]-")).groupBy("q_id", "i_id").agg(F.max(score).alias("_s"))
    lists = ok.groupBy("q_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_s")).alias("n"), "i_id"))), lambda t: t["i_id"]), ",").alias("ids"))
    return entities.join(lists, "q_id", "left").select(F.col("q_id").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("ids"), order)


def check_list_file(lines: DataFrame, header: str, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rule, severity, s1_id) from (row_no, value): header, tabs, repeated rows and ids, prefixes, unknown, missing and extra ids."""
    head, body = lines.where("row_no = 0"), lines.where("row_no > 0 and value <> ''")
    parts = F.split("value", "\t", 2)
    rows = body.select("row_no", F.contains("value", F.lit("\t")).alias("tab"), F.get(parts, F.lit(0)).alias("s1_id"), F.filter(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ","), lambda x: x != "").alias("ids"))
    error = lambda df, rule: df.select(F.lit(rule).alias("rule"), F.lit("error").alias("severity"), "s1_id")
    found = [
        error(head.where(F.col("value") != header).select(F.col("value").alias("s1_id")), "header"),
        error(rows.where("not tab"), "no_tab"),
        error(rows.groupBy("s1_id").count().where("count > 1"), "duplicate_row"),
        error(rows.where(F.size("ids") > F.size(F.array_distinct("ids"))), "duplicate_id"),
        error(rows.where(F.exists("ids", lambda x: x.startswith("S1-"))), "self_match"),
        error(rows.where(F.exists("ids", lambda x: ~x.rlike("^S[123]-"))), "bad_prefix"),
        error(required.select("s1_id").join(rows, "s1_id", "left_anti"), "missing_s1"),
        error(rows.select("s1_id").distinct().join(required.select("s1_id"), "s1_id", "left_anti"), "extra_s1"),
    ]
    if known is not None:
        found.append(error(rows.select("s1_id", F.explode("ids").alias("id")).join(known.select("id"), "id", "left_anti").select("s1_id").distinct(), "unknown_id"))
    return reduce(DataFrame.unionByName, found)


def check_subset(matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """Warnings for entities whose matches are not all among their candidates; both (s1_id, ids array)."""
    both = matched.join(candidates.select("s1_id", F.col("ids").alias("cand")), "s1_id", "left")
    outside = F.size(F.array_except("ids", F.coalesce("cand", F.array().cast("array<string>")))) > 0
    return both.where(outside).select(F.lit("not_in_candidates").alias("rule"), F.lit("warning").alias("severity"), "s1_id")
