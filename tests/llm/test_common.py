import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from kinweave.llm import ann, bpe, common, decontaminate, langid, simhash, sstable, substring, suffix, warc


def test_settings_and_folders_are_as_before(spark, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    r = random.Random(1)
    rows = [(d, " ".join(f"w{r.randint(0, 50)}" for _ in range(80)), "en", "<p>" * d) for d in range(20)]
    docs = spark.createDataFrame([*rows, (30, rows[3][1], "en", "")], "doc_id long, text string, lang string, html string")
    items = docs.limit(2).select(F.col("doc_id").alias("item_id"), "text")
    vectors = spark.range(30).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
    before, folders = dict(spark.conf.getAll), set(common._made)
    uri = common.scratch(spark, "own")
    warc.write_archives(warc.with_revisits(docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), "html")), f"{uri}/w")
    found = [
        simhash.components(simhash.fingerprints(docs)),
        simhash.without_near_copies(docs),
        bpe.encode(docs, path, digest=True),
        warc.read_archives(spark, f"{uri}/w"),
        suffix.digests(docs),
        ann.search(vectors, vectors.where("vec_id < 3"), 4),
        decontaminate.find_leaks(docs, items),
        substring.digests(docs),
        sstable.digests(spark, sstable.write_table(docs, path, f"{uri}/t")),
        langid.predict(docs, langid.train(docs)),
    ]
    assert all(f.count() > 0 for f in found)
    assert dict(spark.conf.getAll) == before
    made = [p for p in common._made if p not in folders]
    assert len(made) > 10
    common.release(spark, made)
    shared = common.shared_dir(spark).removeprefix("file://")
    import os

    assert set(common._made) == folders
    assert not {p.rpartition("/")[2] for p in made} & set(os.listdir(shared))


def test_no_folder_of_one_machine_on_a_cluster():
    unset = SimpleNamespace(get=lambda key, default=None: default)
    session = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session)


@pytest.mark.parametrize("heavy", [1, 5, 1000])
def test_joined_equals_a_join(spark, monkeypatch, heavy):
    monkeypatch.setattr(common, "HEAVY", heavy)
    left = common.stored(spark.createDataFrame([(0 if i % 3 else i % 17, i) for i in range(300)], "k long, v long"), "left")
    right = common.stored(left.where("k % 2 = 0").groupBy("k").agg(F.count("*").alias("n")).withColumn("x", F.col("k") * 10), "right")
    for how in ("inner", "left"):
        want = left.join(right.drop("n"), ["k"], how).collect()
        got = common.joined(left, right, ["k"], "n", how)
        assert got.columns == ["k", "v", "x"]
        assert sorted(map(str, got.collect())) == sorted(map(str, want))


def test_batches_are_cut(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.column(0)[0].as_py()])], ["n", "first"])

    got = common.mapped(spark.range(0, 1000, 1, 1), sizes, "n long, first long", 300).collect()
    assert [(r.n, r.first) for r in got] == [(300, 0), (300, 300), (300, 600), (100, 900)]
