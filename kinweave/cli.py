"""Command line: ``python -m kinweave.cli COMMAND``; the commands are those of :func:`parser`."""

from __future__ import annotations

import argparse
from dataclasses import fields
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import decide as D
from .operators import diagnostics as E
from .operators import validate as V
from .plans import learn as L
from .plans import pipeline as P
from .sources import tsv
from .sources.stages import drop_stage, fingerprint, save_report, stage


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinweave")
    p.add_argument("command", choices=["all", "train", "predict", "prepare", "block", "features", "blocking-report", "score", "errors", "rerank-pairs", "rerank-eval", "rerank-apply", "clean"])
    p.add_argument("--data", help="folder with s1.tsv, s2.tsv, s3.tsv and ground_truth.tsv")
    p.add_argument("--test", help="folder of the records to predict; --data if not given")
    p.add_argument("--work", default="work")
    p.add_argument("--out", default="output")
    p.add_argument("--pred", help="id list to score")
    p.add_argument("--vectors", help="Parquet of (ckey, rec_id, side, vec) for nearest neighbours in training")
    p.add_argument("--test-vectors", help="the same for the records to predict")
    p.add_argument("--scores", help="Parquet of a second scorer's (q_id, i_id, r)")
    p.add_argument("--weight", type=float, default=0.5, help="share of the second scorer")
    p.add_argument("--force", action="store_true", help="make all stages anew")
    for f in fields(Config):
        flag = f"--{f.name.replace('_', '-')}"
        if isinstance(f.default, bool):
            p.add_argument(flag, action=argparse.BooleanOptionalAction, default=f.default)
        elif isinstance(f.default, tuple):
            kind = int if f.default else str
            p.add_argument(flag, type=lambda s, kind=kind: tuple(kind(x.strip()) for x in s.split(",") if x.strip()), default=f.default)
        else:
            p.add_argument(flag, type=type(f.default), default=f.default)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("kinweave").getOrCreate()
    cfg = Config(**{f.name: getattr(a, f.name) for f in fields(Config) if hasattr(a, f.name)})
    read = lambda folder: (tsv.read_records(spark, f"{folder}/s1.tsv"), tsv.index_union(*[tsv.read_records(spark, f"{folder}/s{k}.tsv") for k in (2, 3)]))
    s1, index = read(a.data)
    truth = tsv.explode_truth(tsv.read_id_map(spark, f"{a.data}/ground_truth.tsv")) if a.command != "predict" else None
    base = f"{a.work}/train"
    vectors, test_vectors = (spark.read.parquet(v) if v else None for v in (a.vectors, a.test_vectors))
    inputs = "" if truth is None else fingerprint(s1, index, truth, *([] if vectors is None else [vectors]))
    if a.command == "clean":
        for name in ("records", "pairs", "features", "stage1", "features2", "stage2", "scores"):
            drop_stage(spark, base, cfg, name, inputs)
        return 0
    if a.command.startswith("rerank-"):
        return rerank(spark, a, cfg, base, inputs, s1, truth)
    if a.command in ("prepare", "block", "features", "blocking-report"):
        keep = partial(stage, spark, base, cfg, force=a.force, inputs=inputs)
        recs = keep("records", lambda: P.prepare(s1, index))
        if a.command != "prepare":
            pairs = keep("pairs", lambda: P.candidates(recs, cfg, vectors))
            if a.command == "features":
                keep("features", lambda: P.labelled(P.features(pairs, recs, cfg), truth))
            if a.command == "blocking-report":
                P.blocking_report(recs, pairs, truth).show(100, False)
        return 0
    if a.command in ("score", "errors"):
        entities = s1.select(F.col("entity_id").alias("q_id"), "country")
        chosen = tsv.explode_truth(tsv.read_id_map(spark, a.pred))
        if a.command == "errors":
            keep = partial(stage, spark, base, cfg, force=a.force, inputs=inputs)
            recs = keep("records", lambda: P.prepare(s1, index))
            pairs = keep("pairs", lambda: P.candidates(recs, cfg, vectors))
            tsv.write_rows(E.error_examples(truth, chosen, pairs, recs), f"{a.out}/errors")
            E.error_kinds(entities, truth, chosen, pairs).show(100, False)
            return 0
        E.score_rollup(D.entity_counts(entities, truth, chosen)).show(100, False)
        return 0
    if a.command == "predict":
        model = L.load_run(spark, f"{a.work}/models")
    else:
        model = P.train(spark, base, s1, index, truth, cfg, vectors, a.force)
        L.save_run(spark, model, f"{a.work}/models")
        save_report(spark, f"{a.out}/report", {"holdout_f05": model["holdout_f05"], "decision": model["decision"]})
    if a.command in ("all", "predict"):
        t1, ti = read(a.test or a.data)
        matches, cands = P.predict(spark, f"{a.work}/test", t1, ti, model, cfg, test_vectors, a.force)
        tsv.write_id_lists(matches, f"{a.out}/matching", "source1_entity_id\tmatched_entity_ids")
        tsv.write_id_lists(cands, f"{a.out}/candidates", "source1_entity_id\tcandidate_entity_ids")
    return 0


def rerank(spark: SparkSession, a: argparse.Namespace, cfg: Config, base: str, inputs: str, s1: DataFrame, truth: DataFrame) -> int:
    """Pairs for a second scorer, its blends on the held-out folds, and lists after mixing it in; all need a trained run."""

    def missing() -> DataFrame:
        raise SystemExit("train first: there are no scores of this data under --work")

    kept = partial(stage, spark, base, cfg, make=missing, inputs=inputs)
    scores, recs = kept(name="scores"), kept(name="records")
    how = L.load_run(spark, f"{a.work}/models")["decision"]
    if a.command == "rerank-pairs":
        P.rerank_pairs(scores, recs).write.mode("overwrite").parquet(f"{a.out}/rerank_pairs")
        return 0
    other = spark.read.parquet(a.scores)
    if a.command == "rerank-eval":
        held = F.col("fold").isin(list(cfg.holdout_folds))
        entities = recs.where("side = 'q'").select(F.col("rec_id").alias("q_id"), "country").withColumn("fold", L.fold_of("q_id")).where(held)
        P.evaluate_blends(scores.where(held), other, truth.join(entities, "q_id", "left_semi"), entities, how).show(100, False)
        return 0
    final = P.reranked(scores, other, a.weight)
    chosen = D.apply_decision(final, how["kind"], how["tau"], how["gamma"] or 0.0, how["miss"] or 0.0)
    entities = s1.select(F.col("entity_id").alias("q_id"), "row_no")
    tsv.write_id_lists(V.id_lists(entities, chosen, "p"), f"{a.out}/matching", "source1_entity_id\tmatched_entity_ids")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
