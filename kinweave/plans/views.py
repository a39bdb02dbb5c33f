"""Linkage records made from the driver's tables, in Spark and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import blocking as B

CFG = Config()
FAMILIES = (B.NT, B.NP, B.NC)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as records: the first four tokens are the name, all others the address; every third one asks."""
    toks = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec_id"), F.col("lang").alias("ckey"), F.md5("text").alias("h"), toks.alias("toks"))
    d = d.select("rec_id", "ckey", "h", (1 + F.col("rec_id") % 3).alias("src"), F.when(F.col("rec_id") % 3 == 0, "q").otherwise("i").alias("side"), F.slice("toks", 1, 4).alias("name"), F.slice("toks", F.lit(5), F.greatest(F.size("toks") - 4, F.lit(0))).alias("addr"))
    alpha = F.array_distinct(F.filter("addr", lambda x: x.rlike("^[a-z]{3,}$")))
    nums = F.filter("addr", lambda x: x.rlike("^[0-9]+$"))
    d = d.withColumn("n_core", F.array_join("name", " ")).withColumn("n_concat", F.array_join("name", "")).withColumn("a_full", F.array_join("addr", " "))
    return d.withColumn("a_alpha", F.array_join(alpha, " ")).withColumn("a_nums", F.array_join(nums, " "))


def truth(recs: DataFrame) -> DataFrame:
    """(q_id, i_id, src): records of either side with the same text, the smallest query owning them."""
    own = recs.where("side = 'q'").groupBy("ckey", "h").agg(F.min("rec_id").alias("q_id"))
    return recs.where("side = 'i'").join(own, ["ckey", "h"]).select("q_id", F.col("rec_id").alias("i_id"), "src")


def entities(recs: DataFrame) -> DataFrame:
    return recs.where("side = 'q'").select(F.col("rec_id").alias("q_id"), F.col("ckey").alias("country"))


def scored(recs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Key candidates with a probability made from their score; ``asked`` as in key_candidates."""
    return B.key_candidates(recs, CFG, FAMILIES, asked).withColumn("p", F.round(F.col("bscore") / (F.col("bscore") + 12), 5))


REC = """
tk AS (SELECT doc_id, lang AS ckey, md5(text) AS h, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks FROM documents),
rec AS (SELECT doc_id AS rec_id, ckey, h, 1 + doc_id % 3 AS src, CASE WHEN doc_id % 3 = 0 THEN 'q' ELSE 'i' END AS side, toks[1:4] AS name, toks[5:] AS addr FROM tk),
ntok AS (SELECT DISTINCT ckey, side, rec_id, unnest(name) AS tok FROM rec),
atok AS (SELECT DISTINCT ckey, side, rec_id, tok FROM (SELECT ckey, side, rec_id, unnest(addr) AS tok FROM rec) WHERE regexp_full_match(tok, '[a-z]{3,}')),
utok AS (SELECT DISTINCT ckey, side, rec_id, unnest(list_filter(addr, lambda x: regexp_full_match(x, '[0-9]+'))[1:2]) AS tok FROM rec)"""


def rare_sql(source: str, k: int) -> str:
    return f"""SELECT ckey, side, rec_id, tok FROM (
    SELECT x.*, row_number() OVER (PARTITION BY ckey, side, rec_id ORDER BY df, tok) AS r
    FROM {source} x JOIN (SELECT ckey, tok, count(*) AS df FROM {source} GROUP BY ALL HAVING count(*) >= 2) USING (ckey, tok)) WHERE r <= {k}"""


def cross_sql(a: str, b: str, ktype: int) -> str:
    return f"SELECT x.ckey, x.side, x.rec_id, {ktype} AS ktype, x.tok AS a, y.tok AS b FROM ({a}) x JOIN ({b}) y ON x.ckey = y.ckey AND x.side = y.side AND x.rec_id = y.rec_id"


NP_SQL = f"SELECT x.ckey, x.side, x.rec_id, {B.NP} AS ktype, x.tok AS a, y.tok AS b FROM ({rare_sql('ntok', CFG.name_topk + 1)}) x JOIN ({rare_sql('ntok', CFG.name_topk + 1)}) y ON x.ckey = y.ckey AND x.side = y.side AND x.rec_id = y.rec_id AND x.tok < y.tok"
NC_SQL = f"SELECT ckey, side, rec_id, {B.NC} AS ktype, array_to_string(name, '') AS a, '' AS b FROM rec WHERE array_to_string(name, '') <> ''"
NT_SQL = cross_sql(rare_sql("ntok", CFG.name_topk), rare_sql("atok", CFG.addr_topk), B.NT)
AN_SQL = cross_sql("SELECT * FROM utok", rare_sql("atok", CFG.addr_topk - 1), B.AN)
NH_SQL = cross_sql(rare_sql("ntok", CFG.name_topk), "SELECT * FROM utok", B.NH)

PAIRS = f"""{REC},
keys AS ({NT_SQL} UNION ALL {NP_SQL} UNION ALL {NC_SQL}),
kdf AS (SELECT ckey, ktype, a, b, count(*) FILTER (WHERE side = 'q') AS df_q, count(*) FILTER (WHERE side = 'i') AS df_i FROM keys GROUP BY ALL),
sizes AS (SELECT ckey, count(*) AS n_i FROM rec WHERE side = 'i' GROUP BY ckey),
kok AS (SELECT ckey, ktype, a, b, ln(1 + n_i / df_i) AS w FROM kdf JOIN sizes USING (ckey)
  WHERE df_q > 0 AND df_i > 0 AND df_i <= CASE WHEN ktype IN ({B.NP}, {B.NC}) THEN {CFG.max_df_name} ELSE {CFG.max_df_pair} END AND df_q * df_i <= {CFG.max_pairs_per_key}),
hit AS (SELECT q.ckey, q.rec_id AS q_id, i.rec_id AS i_id, sum(w) AS bscore, bit_or((1 << ktype)::INTEGER) AS bits
  FROM kok JOIN keys q USING (ckey, ktype, a, b) JOIN keys i USING (ckey, ktype, a, b) WHERE q.side = 'q' AND i.side = 'i' GROUP BY ALL),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ckey, q_id ORDER BY round(bscore, 9) DESC, bit_count(bits) DESC, i_id) - 1 AS brank FROM hit) WHERE brank < {CFG.k_key}),
pr AS (SELECT *, round(bscore / (bscore + 12), 5) AS p FROM cand),
own AS (SELECT ckey, h, min(rec_id) AS q_id FROM rec WHERE side = 'q' GROUP BY ALL),
truth AS (SELECT o.q_id, r.rec_id AS i_id, r.src FROM rec r JOIN own o ON r.ckey = o.ckey AND r.h = o.h WHERE r.side = 'i'),
ent AS (SELECT rec_id AS q_id, ckey AS country FROM rec WHERE side = 'q'),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i_id ORDER BY p DESC, q_id) AS r FROM pr) WHERE r = 1)"""

F05 = "CASE WHEN G = 0 AND P = 0 THEN 1.0 WHEN G = 0 OR P = 0 OR TP = 0 THEN 0.0 ELSE 1.25 * TP / (0.25 * G + P) END"


def f05_sql(g: str, p: str, tp: str) -> str:
    return f"CASE WHEN {g} = 0 AND {p} = 0 THEN 1.0 WHEN {g} = 0 OR {p} = 0 OR {tp} = 0 THEN 0.0 ELSE 1.25 * {tp} / (0.25 * {g} + {p}) END"
