"""Incremental linkage, an extension: a stream of new index records against a table of query keys.

Keys and weights of the query side are a static table; each micro-batch of index records makes its keys with JVM
expressions, joins, and keeps its best queries. A record's candidates come from its own keys, so no state is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def name_pair_keys(recs: DataFrame, ident: str, name: str) -> DataFrame:
    """(ckey, ident, key): pairs of distinct name words, in order."""
    words = F.sort_array(F.array_distinct(F.filter(F.split(F.col(name), " "), lambda t: t != "")))
    rows = recs.select("ckey", F.col(ident), words.alias("_w"))
    pairs = F.flatten(F.transform("_w", lambda t, k: F.transform(F.slice("_w", k + 2, F.greatest(F.size("_w") - k - 1, F.lit(0))), lambda u: F.concat_ws(" ", t, u))))
    return rows.select("ckey", ident, F.explode(pairs).alias("key"))


def link_stream(stream: DataFrame, query_keys: DataFrame, ident: str = "i_id", name: str = "n_core") -> DataFrame:
    """Streaming (ckey, i_id, q_id, w): pairs that share a key; query_keys is (ckey, key, q_id, w)."""
    return name_pair_keys(stream, ident, name).join(query_keys, ["ckey", "key"]).select("ckey", ident, "q_id", "w")


def best_of_batch(pairs: DataFrame, k: int = 5, ident: str = "i_id") -> DataFrame:
    """For foreachBatch: the k best queries of each record of the batch."""
    from pyspark.sql import Window as W

    scored = pairs.groupBy("ckey", ident, "q_id").agg(F.sum("w").alias("score"))
    w = W.partitionBy("ckey", ident).orderBy(F.desc("score"), "q_id")
    return scored.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
