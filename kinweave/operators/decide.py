"""From scored pairs to chosen pairs, and how good the choice is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def adjust_house_number(p: Column, q_num: Column, i_num: Column, boost: float = 0.05, penalty: float = 0.05) -> Column:
    """Equal known house numbers add, close ones take away; -1 is unknown."""
    known, gap = (q_num >= 0) & (i_num >= 0), F.abs(q_num - i_num)
    moved = p + F.when(known & (gap == 0), F.lit(boost)).when(known & (gap >= 1) & (gap <= 5), F.lit(-penalty)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), moved))


def one_owner(pairs: DataFrame, p: str = "p") -> DataFrame:
    """Each index record keeps its best query; ties to the smaller query id."""
    w = W.partitionBy("i_id").orderBy(F.col(p).desc(), "q_id")
    return pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def threshold(pairs: DataFrame, tau: float, p: str = "p") -> DataFrame:
    return pairs.where(F.col(p) >= tau)


def expected_f(pairs: DataFrame, tau: float, gamma: float, miss: float, p: str = "p") -> DataFrame:
    """The prefix of a query's candidates that maximises expected F0.5, if it beats choosing nothing.

    All windows share one partitioning, so one shuffle serves them.
    """
    ranked = W.partitionBy("q_id").orderBy(F.col(p).desc(), "i_id")
    whole = W.partitionBy("q_id")
    x = pairs.withColumn("_k", F.row_number().over(ranked)).withColumn("_cum", F.sum(p).over(ranked.rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum(p).over(whole))
    x = x.withColumn("_empty", gamma * F.exp(F.sum(F.log1p(-F.least(F.col(p), F.lit(1 - 1e-12)))).over(whole)))
    x = x.withColumn("_ef", F.when(F.col(p) < tau, -1.0).otherwise(1.25 * F.col("_cum") / (0.25 * (F.col("_all") + miss) + F.col("_k"))))
    x = x.withColumn("_top", F.max("_ef").over(whole))
    x = x.withColumn("_stop", F.min(F.when(F.col("_ef") == F.col("_top"), F.col("_k"))).over(whole))
    return x.where((F.col("_k") <= F.col("_stop")) & (F.col("_top") > F.col("_empty")) & (F.col("_top") > 0)).drop("_k", "_cum", "_all", "_empty", "_ef", "_top", "_stop")


def apply_decision(pairs: DataFrame, kind: str, tau: float, gamma: float = 1.0, miss: float = 0.0) -> DataFrame:
    kept = one_owner(pairs)
    return expected_f(kept, tau, gamma, miss) if kind == "expected_f" else threshold(kept, tau)


def f05(g: Column, p: Column, tp: Column) -> Column:
    """F0.5 of one entity: 1 if both are empty, 0 if one is."""
    return F.when((g == 0) & (p == 0), 1.0).when((g == 0) | (p == 0) | (tp == 0), 0.0).otherwise(1.25 * tp / (0.25 * g + p))


def entity_counts(entities: DataFrame, truth: DataFrame, chosen: DataFrame) -> DataFrame:
    """entities (q_id, ..) with G, P, TP; entities without rows in the others stay."""
    g = truth.groupBy("q_id").agg(F.count("*").alias("G"))
    p = chosen.join(truth.select("q_id", "i_id", F.lit(1).alias("_y")), ["q_id", "i_id"], "left").groupBy("q_id").agg(F.count("*").alias("P"), F.count("_y").alias("TP"))
    return entities.join(g, "q_id", "left").join(p, "q_id", "left").fillna(0, ["G", "P", "TP"])


def macro_f05(counts: DataFrame) -> Column:
    return F.avg(f05(F.col("G"), F.col("P"), F.col("TP")))


# The settings that tuning tries.
THRESHOLDS = [round(0.05 + 0.025 * i, 3) for i in range(37)]
TAUS, GAMMAS, MISSES = [0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6], [0.6, 0.7, 0.85, 1.0, 1.1, 1.2, 1.35, 1.5, 1.7], [0.0, 0.1, 0.2, 0.3]


def tune(pairs: DataFrame, truth: DataFrame, entities: DataFrame, thresholds: list[float] | None = None, grid: list[tuple[float, float, float]] | None = None) -> DataFrame:
    """(kind, tau, gamma, miss, f05) of every setting. Each entity's candidates become one sorted array, on which all settings are evaluated."""
    thresholds = THRESHOLDS if thresholds is None else thresholds
    grid = [(t, g, m) for t in TAUS for g in GAMMAS for m in MISSES] if grid is None else grid
    y = one_owner(pairs.select("q_id", "i_id", "p")).join(truth.select("q_id", "i_id", F.lit(1).alias("y")), ["q_id", "i_id"], "left")
    ranked = W.partitionBy("q_id").orderBy(F.col("p").desc(), "i_id")
    upto = ranked.rowsBetween(W.unboundedPreceding, 0)
    y = y.withColumn("y", F.coalesce("y", F.lit(0))).withColumn("k", F.row_number().over(ranked))
    y = y.withColumn("cum", F.sum("p").over(upto)).withColumn("tp", F.sum("y").over(upto).cast("int"))
    lists = y.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("k", "p", "cum", "tp"))).alias("c"))
    g = truth.groupBy("q_id").agg(F.count("*").alias("G"))
    x = entities.select("q_id").join(g, "q_id", "left").join(lists, "q_id", "left").fillna(0, ["G"])
    x = x.withColumn("c", F.coalesce("c", F.array().cast(lists.schema["c"].dataType)))
    x = x.select("q_id", "G", F.col("c.p").alias("ps"), F.col("c.cum").alias("cum"), F.col("c.tp").alias("tp"))
    settings = [("threshold", t, None, None) for t in thresholds] + [("expected_f", *s) for s in grid]
    table = pairs.sparkSession.createDataFrame(settings, "kind string, tau double, gamma double, miss double")
    x = x.crossJoin(F.broadcast(table))  # a fixed number of settings
    n = F.size("ps")
    total = F.coalesce(F.try_element_at("cum", F.lit(-1)), F.lit(0.0))
    nothing = F.coalesce("gamma", F.lit(0.0)) * F.aggregate("ps", F.lit(1.0), lambda a, p: a * (1 - F.least(p, F.lit(1 - 1e-12))))
    ef = F.zip_with("cum", F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda c, k: F.struct(c.alias("c"), k.alias("k")))
    ef = F.transform(F.filter(ef, lambda t: t["c"].isNotNull()), lambda t: F.when(F.element_at("ps", t["k"]) < F.col("tau"), -1.0).otherwise(1.25 * t["c"] / (0.25 * (total + F.col("miss")) + t["k"])))
    top = F.array_max(ef)
    chosen = F.when(F.col("kind") == "threshold", F.size(F.filter("ps", lambda p: p >= F.col("tau")))).when((n > 0) & (top > nothing) & (top > 0), F.array_position(ef, top)).otherwise(0)
    x = x.withColumn("P", chosen.cast("int")).withColumn("TP", F.when(F.col("P") > 0, F.element_at("tp", F.greatest(F.col("P"), F.lit(1)))).otherwise(0))
    return x.groupBy("kind", "tau", "gamma", "miss").agg(macro_f05(x).alias("f05"))
