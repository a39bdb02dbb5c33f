"""The command line from files to lists, with a second scorer on top."""

import pytest
from pyspark.sql import functions as F

from kinweave.cli import main
from kinweave.sources import tsv
from kinweave.sources.synthetic import generate

KNOBS = ["--rounds", "2", "--tree-depth", "2", "--min-leaf", "2", "--k-key", "6", "--stage1-folds", "0,1", "--stage2-folds", "2,3,4,5", "--train-countries", "us,india"]


def lines(path):
    return [x for f in sorted(path.glob("part-*")) for x in f.read_text().splitlines()]


def test_commands(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr("pyspark.sql.SparkSession.stop", lambda self: None)
    s1, index, truth = generate(spark, 60)
    s1, index, truth = (x.toPandas() for x in (s1, index, truth))
    s1 = s1.sample(frac=1, random_state=3)  # not in order of ids
    cols = ["entity_id", "business_name", "business_address", "country"]
    data = tmp_path / "data"
    data.mkdir()
    s1[cols].to_csv(data / "s1.tsv", sep="\t", index=False, quoting=3, escapechar="\\")
    for k in (2, 3):
        index[index.src == k][cols].to_csv(data / f"s{k}.tsv", sep="\t", index=False, quoting=3, escapechar="\\")
    found = truth.groupby("q_id")["i_id"].agg(",".join)
    text = "".join(f"{q}\t{found.get(q, '')}\n" for q in s1.entity_id)
    (data / "ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + text)
    run = lambda *a: main([*a, "--data", str(data), "--work", str(tmp_path / "work"), "--out", str(tmp_path / "out"), *KNOBS])
    with pytest.raises(SystemExit):
        run("rerank-pairs")
    assert run("all") == 0
    for name in ("matching", "candidates"):
        got = lines(tmp_path / "out" / name)
        assert [x.split("\t")[0] for x in got[1:]] == list(s1.entity_id)
    pred = tmp_path / "pred.tsv"
    pred.write_text("\n".join(lines(tmp_path / "out" / "matching")) + "\n")
    assert run("errors", "--pred", str(pred)) == run("score", "--pred", str(pred)) == run("rerank-pairs") == 0
    pairs = spark.read.parquet(f"{tmp_path}/out/rerank_pairs")
    assert pairs.count() > 0 and {"left", "right", "p"} <= set(pairs.columns)
    right = spark.createDataFrame(truth)[["q_id", "i_id"]].withColumn("y", F.lit(1.0))
    pairs.join(right, ["q_id", "i_id"], "left").select("q_id", "i_id", F.coalesce("y", F.lit(0.0)).alias("r")).write.parquet(f"{tmp_path}/scores")
    assert run("rerank-eval", "--scores", f"{tmp_path}/scores") == run("rerank-apply", "--scores", f"{tmp_path}/scores", "--weight", "1.0") == 0
    assert "weight" in capsys.readouterr().out
    chosen = tsv.explode_truth(tsv.read_id_map(spark, f"{tmp_path}/out/matching"))
    assert chosen.join(right, ["q_id", "i_id"], "left_anti").count() <= 2
    assert run("clean") == 0
    assert not list((tmp_path / "work" / "train").glob("*/scores"))
