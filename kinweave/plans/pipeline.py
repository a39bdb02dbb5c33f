"""A whole linkage run: prepare, block, features, two trained stages, calibration, decision, lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.addresses import normalize_addresses
from ..functions.names import normalize_names
from ..functions.text import country_key, first_number, is_non_latin, reranker_text, retrieval_tokens
from ..operators import blocking as B
from ..operators import decide as D
from ..operators import features as X
from ..operators.diagnostics import hard_negatives, top_rows
from ..operators.retrieval import bm25_topk, knn_topk
from ..operators.validate import id_lists
from ..sources.stages import fingerprint, stage
from . import learn as L

FEATURES = [*X.NAME_SCORES, *X.ADDRESS_SCORES, "n_alias_best", "n_cos_char", "n_cos_word", "a_cos_word", "n_jacc", "n_first_eq", "n_len_q", "n_len_i", "n_ntok_diff", "i_translit", "i_domain", "i_alias", "a_empty_i", "a_num_jacc", "a_num_conflict", "a_first_num_eq", "a_qnum_in_i", "a_state_eq", "a_len_i", "a_ncomp_i", "i_addr_translit", "src_s3", "bscore", "brank", "b_ntypes", *X.BITS, "dense_cos", "q_name_df_s1", "i_name_df_idx", "i_name_df_s1"]
CONTEXT = ["g_max_n_tset", "g_diff_n_tset", "g_rank_n_tset", "g_max_a_tset", "g_diff_a_tset", "g_rank_a_tset", "g_max_combo", "g_diff_combo", "g_rank_combo", "g_rank_bscore", "q_ncand", "i_ncand_s1", "i_rank_combo", "i_diff_combo", "i_rank_bscore"]


def prepare(s1: DataFrame, index: DataFrame) -> DataFrame:
    """Normalised records of both sides (ckey, rec_id, side, src, columns, raw name and address)."""
    cols = ["entity_id", "business_name", "business_address", "country"]
    q = s1.select(*cols, F.lit(1).alias("src"), F.lit("q").alias("side"))
    i = index.select(*cols, F.col("src").cast("int"), F.lit("i").alias("side"))
    rows = q.unionByName(i).withColumn("ckey", country_key(F.col("country"))).withColumnRenamed("entity_id", "rec_id")
    rows = normalize_addresses(normalize_names(rows, "business_name"), "business_address", "country")
    sides = {s: rows.where(F.col("side") == s) for s in "qi"}
    return sides["q"].unionByName(B.country_or_blank(sides["q"], sides["i"]))


def candidates(recs: DataFrame, cfg: Config, vectors: DataFrame | None = None) -> DataFrame:
    """Keys, BM25 and, where vectors (ckey, rec_id, side, vec) are given, nearest neighbours."""
    extras = []
    toks = recs.select("ckey", "rec_id", "side", "business_name", "business_address", retrieval_tokens(F.col("business_name"), F.col("business_address")).alias("toks"))
    q, i = toks.where("side = 'q'").withColumnRenamed("rec_id", "q_id"), toks.where("side = 'i'").withColumnRenamed("rec_id", "i_id")
    ranked = bm25_topk(q.select("ckey", "q_id", "toks"), i.select("ckey", "i_id", "toks"), max(cfg.bm25_k, cfg.bm25_k_empty), cfg)
    blank = i.select("ckey", "i_id", B.is_blank(F.col("business_address")).alias("_blank"))
    extras.append((B.keep_empty_deeper(ranked.join(blank, ["ckey", "i_id"]), "rk", F.col("_blank"), cfg.bm25_k, cfg.bm25_k_empty), B.BM25))
    if vectors is not None and cfg.dense:
        vq, vi = (vectors.where(F.col("side") == s).select("ckey", F.col("rec_id").alias(f"{s}_id"), "vec") for s in "qi")
        near = knn_topk(vq, vi, max(cfg.k_dense, cfg.k_dense_script, cfg.k_dense_empty if cfg.dense_adaptive else 0))
        native = lambda side: recs.where(F.col("side") == side).select("ckey", F.col("rec_id").alias(f"{side}_id"), is_non_latin(F.coalesce("business_name", F.lit(""))).alias(f"_{side}n"))
        near = near.join(native("q"), ["ckey", "q_id"]).join(native("i"), ["ckey", "i_id"])
        if cfg.dense_adaptive:
            bare = lambda side: toks.where(F.col("side") == side).select("ckey", F.col("rec_id").alias(f"{side}_id"), B.is_blank(F.col("business_address")).alias(f"_{side}e"))
            near = near.join(bare("q"), ["ckey", "q_id"]).join(bare("i"), ["ckey", "i_id"])
            near = B.keep_adaptive(near, "rk", F.col("_qn"), F.col("_in"), F.col("_qe"), F.col("_ie"), cfg)
        else:
            near = B.keep_script_deeper(near, "rk", F.col("_qn"), F.col("_in"), cfg.k_dense, cfg.k_dense_script)
        extras.append((near, B.DENSE))
    return B.merge_candidates(B.key_candidates(recs, cfg), extras, cfg.k_key)


def features(pairs: DataFrame, recs: DataFrame, cfg: Config) -> DataFrame:
    return X.context_features(X.base_features(pairs, recs, cfg))


def labelled(x: DataFrame, truth: DataFrame) -> DataFrame:
    y = x.join(truth.select("q_id", "i_id", F.lit(1.0).alias("y")), ["q_id", "i_id"], "left").fillna(0.0, ["y"])
    return y.withColumn("fold", L.fold_of("q_id"))


def of_training_countries(x: DataFrame, cfg: Config) -> DataFrame:
    """Rows of the partitions that models may learn from: all, or those of ``cfg.train_countries``."""
    return x.where(F.col("ckey").isin([c.strip().lower() for c in cfg.train_countries])) if cfg.train_countries else x


def train(spark: SparkSession, base: str, s1: DataFrame, index: DataFrame, truth: DataFrame, cfg: Config, vectors: DataFrame | None = None, force: bool = False) -> dict:
    """Models of both stages, calibration and the best decision; stages are kept under ``base``.

    Models and calibration learn from the training countries only; the decision is tuned on all.
    """
    inputs = fingerprint(s1, index, truth, *([] if vectors is None else [vectors]))
    keep = lambda name, make: stage(spark, base, cfg, name, make, force, inputs)
    recs = keep("records", lambda: prepare(s1, index))
    pairs = keep("pairs", lambda: candidates(recs, cfg, vectors))
    x = keep("features", lambda: labelled(features(pairs, recs, cfg), truth))
    rows = of_training_countries(x, cfg)
    rows = rows if rows.count() <= cfg.max_train_rows else hard_negatives(rows, cfg.max_train_rows, seed=cfg.seed)
    one = L.train_folds(L.assembled(rows, FEATURES + CONTEXT), "y", cfg.stage1_folds, cfg)
    scored = keep("stage1", lambda: L.predict_folds(L.assembled(x, FEATURES + CONTEXT), one, "p1").drop("_x"))
    two = keep("features2", lambda: X.stage2_features(scored.drop("q_ncand", "i_ncand_s1"), recs))
    cols = [*X.STAGE2_OWN, *X.STAGE2_CORE]
    second = L.train_folds(L.assembled(of_training_countries(two, cfg), cols), "y", cfg.stage2_folds, cfg)
    p2 = keep("stage2", lambda: L.predict_folds(L.assembled(two, cols), second, "p2").drop("_x"))
    iso = L.calibrate(of_training_countries(p2, cfg).where(F.col("fold").isin(list(cfg.stage2_folds))), "p2", "y")
    final = keep("scores", lambda: decided_scores(L.apply_calibration(p2, iso, "p2", "p"), recs, cfg).select("ckey", "q_id", "i_id", "fold", "p"))
    own = final.where(F.col("fold").isin(list(cfg.stage2_folds)))
    entities = recs.where("side = 'q'").select(F.col("rec_id").alias("q_id"), F.col("country")).withColumn("fold", L.fold_of("q_id"))
    best = D.tune(own, truth, entities.where(F.col("fold").isin(list(cfg.stage2_folds)))).orderBy(F.desc("f05"), "kind", "tau", "gamma", "miss").first()
    held = entities.where(F.col("fold").isin(list(cfg.holdout_folds)))
    chosen = D.apply_decision(final.where(F.col("fold").isin(list(cfg.holdout_folds))), best["kind"], best["tau"], best["gamma"] or 0.0, best["miss"] or 0.0)
    counts = D.entity_counts(held, truth.join(held, "q_id", "left_semi"), chosen)
    return {"stage1": one, "stage2": second, "calibration": iso, "decision": best.asDict(), "holdout_f05": counts.agg(D.macro_f05(counts)).first()[0], "config": cfg.to_json()}


def decided_scores(x: DataFrame, recs: DataFrame, cfg: Config) -> DataFrame:
    """Scores moved by house numbers."""
    num = lambda s: recs.where(F.col("side") == s).select("ckey", F.col("rec_id").alias(f"{s}_id"), first_number(F.col("a_nums")).alias(f"_{s}num"))
    out = x.join(num("q"), ["ckey", "q_id"]).join(num("i"), ["ckey", "i_id"])
    return out.withColumn("p", D.adjust_house_number(F.col("p"), F.col("_qnum"), F.col("_inum"), cfg.housenum_boost, cfg.housenum_pen)).drop("_qnum", "_inum")


def predict(spark: SparkSession, base: str, s1: DataFrame, index: DataFrame, model: dict, cfg: Config, vectors: DataFrame | None = None, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(matches, candidates) as id lists, a row for each query record; ``row_no`` is that of ``s1``, the place in its file."""
    from ..config import enforce_contract

    enforce_contract(Config.from_json(model["config"]), cfg)
    inputs = fingerprint(s1, index, *([] if vectors is None else [vectors]))
    keep = lambda name, make: stage(spark, base, cfg, name, make, force, inputs)
    recs = keep("records", lambda: prepare(s1, index))
    pairs = keep("pairs", lambda: candidates(recs, cfg, vectors))
    x = keep("features", lambda: features(pairs, recs, cfg).withColumn("fold", F.lit(-1)))
    scored = keep("stage1", lambda: L.predict_folds(L.assembled(x, FEATURES + CONTEXT), model["stage1"], "p1").drop("_x"))
    two = X.stage2_features(scored.drop("q_ncand", "i_ncand_s1"), recs)
    p2 = L.predict_folds(L.assembled(two, [*X.STAGE2_OWN, *X.STAGE2_CORE]), model["stage2"], "p2").drop("_x")
    final = keep("scores", lambda: decided_scores(L.apply_calibration(p2, model["calibration"], "p2", "p"), recs, cfg).select("ckey", "q_id", "i_id", "p"))
    how = model["decision"]
    chosen = D.apply_decision(final, how["kind"], how["tau"], how["gamma"] or 0.0, how["miss"] or 0.0)
    entities = s1.select(F.col("entity_id").alias("q_id"), F.col("row_no") if "row_no" in s1.columns else F.monotonically_increasing_id().alias("row_no"))
    return id_lists(entities, chosen, "p"), id_lists(entities, final, "p")


def blend(p: F.Column, other: F.Column, weight: float) -> F.Column:
    """A second scorer's probability mixed into the first's, where it has one."""
    return F.when(other.isNull(), p).otherwise((1 - weight) * p + weight * other)


def shortlist(scored: DataFrame, least: float = 0.02, limit: int = 4_000_000) -> DataFrame:
    """Pairs worth a costly second scorer: one owner each, the most likely ones."""
    return top_rows(D.one_owner(scored).where(F.col("p") >= least), limit, F.col("p"), ["q_id", "i_id"])


def rerank_pairs(scored: DataFrame, recs: DataFrame, least: float = 0.02, limit: int = 4_000_000) -> DataFrame:
    """(ckey, q_id, i_id, p, left, right): pairs for a costly second scorer, with the texts it reads."""
    said = reranker_text(F.col("business_name"), F.col("business_address"), F.col("country"))
    side = lambda s, name: recs.where(F.col("side") == s).select("ckey", F.col("rec_id").alias(f"{s}_id"), said.alias(name))
    return shortlist(scored, least, limit).select("ckey", "q_id", "i_id", "p").join(side("q", "left"), ["ckey", "q_id"]).join(side("i", "right"), ["ckey", "i_id"])


def reranked(scored: DataFrame, other: DataFrame, weight: float) -> DataFrame:
    """``scored`` with the probabilities of ``other`` (q_id, i_id, r) mixed in where it has one."""
    x = scored.join(other.select("q_id", "i_id", F.col("r").alias("_r")), ["q_id", "i_id"], "left")
    return x.withColumn("p", blend(F.col("p"), F.col("_r"), weight)).drop("_r")


def evaluate_blends(scored: DataFrame, other: DataFrame, truth: DataFrame, entities: DataFrame, how: dict, weights: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """(weight, f05) of the decision ``how`` after mixing; a row a weight."""
    rows = []
    for w in weights:
        chosen = D.apply_decision(reranked(scored, other, w), how["kind"], how["tau"], how["gamma"] or 0.0, how["miss"] or 0.0)
        counts = D.entity_counts(entities, truth, chosen)
        rows.append(counts.agg(F.lit(w).alias("weight"), D.macro_f05(counts).alias("f05")))
    return reduce(DataFrame.unionByName, rows)


def blocking_report(recs: DataFrame, pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """(ckey, recall, reduction, pairs_per_query)."""
    n = recs.groupBy("ckey").agg(F.count_if(F.col("side") == "q").alias("nq"), F.count_if(F.col("side") == "i").alias("ni"))
    q = recs.where("side = 'q'").select("ckey", F.col("rec_id").alias("q_id"))
    hit = truth.join(q, "q_id").join(pairs.select("q_id", "i_id", F.lit(1).alias("_hit")).distinct(), ["q_id", "i_id"], "left").groupBy("ckey").agg(F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("recall"))
    size = pairs.groupBy("ckey").agg(F.count("*").alias("np"))
    out = reduce(lambda a, b: a.join(b, "ckey", "left"), [n, hit, size])
    return out.select("ckey", "recall", (1 - F.col("np") / (F.col("nq") * F.col("ni"))).alias("reduction"), (F.col("np") / F.col("nq")).alias("pairs_per_query"))
