"""Candidate generation by keys: families, document frequencies, key join, ranking.

Records come as ``ckey`` (partition key), ``rec_id``, ``side`` ('q' or 'i') and the normalised strings. Everything is
an equi-join or a group on (ckey, ..), so Spark splits it by key; document-frequency caps come before the pair join,
so no key can make more than ``max_pairs_per_key`` pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..config import Config
from ..sources.shared import stored

NT, NS, AN, NH, NP, NC, PH, DENSE, BM25 = range(9)
NAME_ONLY = (NP, NC)


def record_tokens(recs: DataFrame, column: str) -> DataFrame:
    """(ckey, rec_id, side, tok), distinct."""
    toks = F.array_distinct(F.filter(F.split(F.coalesce(F.col(column), F.lit("")), " "), lambda t: t != ""))
    return recs.select("ckey", "rec_id", "side", F.explode(toks).alias("tok"))


def token_df(toks: DataFrame) -> DataFrame:
    return toks.groupBy("ckey", "tok").agg(F.count("*").alias("df"))


def rare_tokens(recs: DataFrame, column: str, k: int) -> DataFrame:
    """(ckey, rec_id, side, tok): the k rarest tokens of a record, of those that two records or more hold; ties by text."""
    toks = record_tokens(recs, column)
    shared = token_df(toks).where("df >= 2")
    w = W.partitionBy("ckey", "side", "rec_id").orderBy("df", "tok")
    return toks.join(shared, ["ckey", "tok"]).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("ckey", "rec_id", "side", "tok")


#: Words that every task knows with their document frequency, at most; records whose words it looks up at a time.
COMMON_WORDS, RECORDS = 100_000, 1_000


def _common(shared: DataFrame) -> dict:
    """ckey -> (words, df) of the COMMON_WORDS most frequent words or somewhat fewer, rarest first, ties by text."""
    import pyarrow.compute as pc

    level = F.floor(F.log2("df") * 8)
    least, n = None, 0
    for r in sorted(shared.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        n += r["count"]
        if n > COMMON_WORDS:
            break
        least = r["level"]
    if least is None:
        return {}
    rows = shared.where(level >= least).select("ckey", "tok", "df").toArrow().sort_by([("df", "ascending"), ("tok", "ascending")]).combine_chunks()
    own = {key: rows.filter(pc.equal(rows.column(0), key)) for key in rows.column(0).unique() if key.is_valid}
    return {key.as_py(): (x.column(1).combine_chunks(), x.column(2).to_numpy()) for key, x in own.items()}


def rare_words(recs: DataFrame, column: str, k: int) -> DataFrame:
    """As :func:`rare_tokens`, for long texts: of a record's common words, which tasks know, only the k rarest leave it.

    Any other word is rarer than these, so all of them are sent to meet their frequencies, as in rare_tokens.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    toks = record_tokens(recs, column)
    counted = token_df(toks).where("df >= 2 and ckey is not null")
    shared = recs.sparkSession.read.schema(counted.schema).parquet(stored(counted, "token-df"))
    known = _common(shared)
    words = F.array_distinct(F.filter(F.split(F.coalesce(F.col(column), F.lit("")), " "), lambda t: t != ""))

    step = RECORDS

    def pick(batches):
        for rows in (b.slice(a, step) for b in batches for a in range(0, b.num_rows, step)):
            for key in rows.column(0).unique().drop_null():
                part = rows.filter(pc.equal(rows.column(0), key))
                common, df = known.get(key.as_py(), (pa.array([], pa.string()), np.zeros(0, np.int64)))
                flat, row = part.column(3).flatten(), np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(3)).to_numpy())
                at = pc.fill_null(pc.index_in(flat, value_set=common), -1).to_numpy()
                mine = np.flatnonzero(at >= 0)
                mine = mine[np.lexsort((at[mine], row[mine]))]
                new = np.diff(row[mine], prepend=-1) != 0
                mine = mine[np.arange(len(mine)) - np.maximum.accumulate(np.where(new, np.arange(len(mine)), 0)) < k]
                sent = np.concatenate([mine, np.flatnonzero(at < 0)])
                found = pa.array(np.concatenate([df[at[mine]], np.zeros(len(sent) - len(mine), np.int64)]), mask=np.arange(len(sent)) >= len(mine))
                own = part.select([0, 1, 2]).take(pa.array(row[sent]))  # without the lists, of which each word would get a copy
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), flat.take(pa.array(sent)), found], ["ckey", "rec_id", "side", "tok", "known"])

    kinds = T.StructType([*[recs.schema[c] for c in ("ckey", "rec_id", "side")], T.StructField("tok", T.StringType()), T.StructField("known", T.LongType())])
    sent = recs.select("ckey", "rec_id", "side", words.alias("words")).mapInArrow(pick, kinds)
    met = sent.join(shared, ["ckey", "tok"], "left").withColumn("df", F.coalesce("known", "df")).where("df is not null")
    w = W.partitionBy("ckey", "side", "rec_id").orderBy("df", "tok")
    return met.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("ckey", "rec_id", "side", "tok")


def first_numbers(recs: DataFrame, column: str, k: int) -> DataFrame:
    nums = F.slice(F.filter(F.split(F.coalesce(F.col(column), F.lit("")), " "), lambda t: t != ""), 1, k)
    return recs.select("ckey", "rec_id", "side", F.explode(F.array_distinct(nums)).alias("tok"))


def _lists(toks: DataFrame, name: str) -> DataFrame:
    return toks.groupBy("ckey", "rec_id", "side").agg(F.sort_array(F.collect_set("tok")).alias(name))


def cross_keys(a: DataFrame, b: DataFrame, ktype: int) -> DataFrame:
    """(ckey, rec_id, side, ktype, a, b): each token of one list with each of the other, inside a record."""
    both = _lists(a, "xs").join(_lists(b, "ys"), ["ckey", "rec_id", "side"])
    return both.select("ckey", "rec_id", "side", F.lit(ktype).alias("ktype"), F.explode("xs").alias("a"), "ys").select("ckey", "rec_id", "side", "ktype", "a", F.explode("ys").alias("b"))


def pair_keys(a: DataFrame, ktype: int = NP) -> DataFrame:
    """Unordered pairs of a record's tokens."""
    one = _lists(a, "xs")
    first = one.select("ckey", "rec_id", "side", F.lit(ktype).alias("ktype"), F.posexplode("xs").alias("at", "a"), "xs")
    return first.select("ckey", "rec_id", "side", "ktype", "a", F.explode(F.slice("xs", F.col("at") + 2, F.greatest(F.size("xs") - F.col("at") - 1, F.lit(0)))).alias("b"))


def whole_keys(recs: DataFrame, column: str, ktype: int = NC) -> DataFrame:
    return recs.where(F.coalesce(F.col(column), F.lit("")) != "").select("ckey", "rec_id", "side", F.lit(ktype).alias("ktype"), F.col(column).alias("a"), F.lit("").alias("b"))


def build_keys(recs: DataFrame, cfg: Config, families: tuple[int, ...] = (NT, NS, AN, NH, NP, NC, PH)) -> DataFrame:
    """Keys of all wanted families."""
    name, addr = lambda k: rare_tokens(recs, "n_core", k), lambda k: rare_words(recs, "a_alpha", k)
    skel, nums = lambda: rare_words(recs, "a_skel", max(1, cfg.addr_topk - 1)), lambda: first_numbers(recs, "a_nums", cfg.num_topk)
    made = {
        NT: lambda: cross_keys(name(cfg.name_topk), addr(cfg.addr_topk), NT),
        NS: lambda: cross_keys(rare_tokens(recs, "n_skel", cfg.name_topk), skel(), NS),
        AN: lambda: cross_keys(nums(), addr(max(1, cfg.addr_topk - 1)), AN),
        NH: lambda: cross_keys(name(cfg.name_topk), nums(), NH),
        NP: lambda: pair_keys(name(cfg.name_topk + 1), NP),
        NC: lambda: whole_keys(recs, "n_concat", NC),
        PH: lambda: cross_keys(rare_tokens(recs, "n_phon", cfg.name_topk), skel(), PH),
    }
    return reduce(DataFrame.unionByName, [made[f]() for f in families])


def usable_keys(keys: DataFrame, sizes: DataFrame, cfg: Config) -> DataFrame:
    """(ckey, ktype, a, b, w): keys on both sides within the caps, with the weight ln(1 + N / df)."""
    df = keys.groupBy("ckey", "ktype", "a", "b").agg(F.count_if(F.col("side") == "q").alias("df_q"), F.count_if(F.col("side") == "i").alias("df_i"))
    cap = F.when(F.col("ktype").isin(*NAME_ONLY), cfg.max_df_name).otherwise(cfg.max_df_pair)
    ok = df.where((F.col("df_i") > 0) & (F.col("df_q") > 0) & (F.col("df_i") <= cap) & (F.col("df_q") * F.col("df_i") <= cfg.max_pairs_per_key))
    return ok.join(sizes, "ckey").select("ckey", "ktype", "a", "b", F.log1p(F.col("n_i") / F.col("df_i")).alias("w"))


def index_sizes(recs: DataFrame) -> DataFrame:
    return recs.where("side = 'i'").groupBy("ckey").agg(F.count("*").alias("n_i"))


def key_candidates(recs: DataFrame, cfg: Config, families: tuple[int, ...] = (NT, NS, AN, NH, NP, NC, PH), asked: DataFrame | None = None) -> DataFrame:
    """(ckey, q_id, i_id, bscore, bits, brank): the k_key best index records of each query record.

    ``asked``: (q_id), distinct and small enough to be broadcast, the only queries that meet their keys' records; the
    frequencies and caps of keys are those of all records.
    """
    keys = build_keys(recs, cfg, families).distinct()
    kept = keys.join(usable_keys(keys, index_sizes(recs), cfg), ["ckey", "ktype", "a", "b"])
    # the caps bound both lists of a key, and the join has brought its rows together already
    side = lambda s: F.collect_list(F.when(F.col("side") == s, F.col("rec_id")))
    if asked is not None:
        kept = kept.join(F.broadcast(asked.select(F.col("q_id").alias("rec_id"), F.lit(True).alias("asks"))), "rec_id", "left").where("side = 'i' or asks")
    lists = kept.groupBy("ckey", "ktype", "a", "b").agg(F.first("w").alias("w"), side("q").alias("qs"), side("i").alias("is"))
    pairs = lists.select("ckey", "ktype", "w", F.explode("qs").alias("q_id"), "is").select("ckey", "ktype", "w", "q_id", F.explode("is").alias("i_id"))
    scored = pairs.groupBy("ckey", "q_id", "i_id").agg(F.sum("w").alias("bscore"), F.bit_or(F.expr("shiftleft(1, ktype)")).alias("bits"))
    return top_candidates(scored, cfg.k_key)


def top_candidates(scored: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("ckey", "q_id").orderBy(F.round("bscore", 9).desc(), F.bit_count("bits").desc(), "i_id")
    return scored.withColumn("brank", F.row_number().over(w) - 1).where(F.col("brank") < k)


def country_or_blank(q: DataFrame, idx: DataFrame) -> DataFrame:
    """Index rows by query partition: rows without a country go to every partition of the query side with one.

    The set of countries is bounded by the query side's distinct keys; blank rows alone are repeated.
    """
    keys = q.select("ckey").distinct()
    own = idx.join(keys, "ckey", "left_semi")
    blank = idx.where("ckey = ''").drop("ckey").crossJoin(keys.where("ckey <> ''"))
    return own.unionByName(blank.select(*own.columns))


def merge_candidates(keys: DataFrame, extras: list[tuple[DataFrame, int]], k_key: int) -> DataFrame:
    """Union of candidate lists. extras: (ckey, q_id, i_id[, dcos]) with the bit of the list."""
    base = keys.select("ckey", "q_id", "i_id", F.col("bscore").cast("double"), F.col("bits").cast("int"), F.col("brank").cast("int"), (F.col("dcos") if "dcos" in keys.columns else F.lit(None)).cast("double").alias("dcos"))
    for extra, bit in extras:
        cos = F.col("dcos") if "dcos" in extra.columns else F.lit(None)
        base = base.unionByName(extra.select("ckey", "q_id", "i_id", F.lit(None).cast("double").alias("bscore"), F.lit(1 << bit).alias("bits"), F.lit(None).cast("int").alias("brank"), cos.cast("double").alias("dcos")))
    out = base.groupBy("ckey", "q_id", "i_id")
    return out.agg(F.coalesce(F.max("bscore"), F.lit(0.0)).alias("bscore"), F.bit_or("bits").alias("bits"), F.coalesce(F.min("brank"), F.lit(k_key + 50)).alias("brank"), F.max("dcos").alias("dcos"))


def is_blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def keep_empty_deeper(ranked: DataFrame, rank: str, empty: Column, k: int, k_empty: int) -> DataFrame:
    """Rank under k, or under k_empty where the index address is blank (ranks from 0)."""
    return ranked.where((F.col(rank) < k) | ((F.col(rank) < k_empty) & empty))


def keep_script_deeper(ranked: DataFrame, rank: str, q_native: Column, i_native: Column, k: int, k_script: int) -> DataFrame:
    return ranked.where((F.col(rank) < k) | ((F.col(rank) < k_script) & (q_native | i_native)))


def keep_adaptive(ranked: DataFrame, rank: str, q_native: Column, i_native: Column, q_empty: Column, i_empty: Column, cfg: Config) -> DataFrame:
    budget = F.when(~q_native & ~q_empty, cfg.k_dense_easy).otherwise(cfg.k_dense)
    budget = F.when(q_empty, F.greatest(budget, F.lit(cfg.k_dense_empty))).otherwise(budget)
    budget = F.when(q_native, F.greatest(budget, F.lit(cfg.k_dense_script))).otherwise(budget)
    r = F.col(rank)
    return ranked.where((r < budget) | ((r < cfg.k_dense_script) & (q_native | i_native)) | ((r < cfg.k_dense_empty) & (q_empty | i_empty)))
