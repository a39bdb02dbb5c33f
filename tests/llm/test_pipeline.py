"""The pipeline against a plain Python version of each stage on a small table."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P

R = random.Random(12)
EN = ["the", "of", "and", "thin", "whole", "house", "river", "stone", "with", "water"]
FR = ["été", "où", "çà", "même", "eau", "quelle", "forêt", "père", "âme", "île"]


def text(n, words):
    return " ".join(R.choice(words) + R.choice(["", "ing", "ly", "s", "er", "ment"]) + R.choice(["", "a", "o"]) for _ in range(n))


@pytest.fixture(scope="module")
def planted(tmp_path_factory, spark):
    item = text(30, EN)
    passage = text(60, EN)
    docs = {i: (text(R.randint(150, 250), EN), "en") for i in range(40)} | {i: (text(R.randint(150, 250), FR), "fr") for i in range(40, 70)}
    near = docs[3][0].split()
    near[50] = "changed"
    docs[70] = (" ".join(near), "en")
    docs[71] = (docs[45][0], "fr")
    docs[5] = (docs[5][0] + " " + passage, "en")
    docs[72] = (text(100, EN) + "\n" + passage + " " + text(100, EN), "en")
    docs[73] = (text(100, EN) + " " + item + " " + text(90, EN), "en")
    docs[74] = ("12 34 !!", "en")
    docs[75] = (None, "en")
    docs[76] = ("", None)
    docs[77] = (passage, "en")
    at = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "of the")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, docs, passage


def test_pipeline(spark, planted):
    at, docs, passage = planted
    got = {r.doc_id: r for r in P.run(spark, at).collect()}
    assert set(got) == set(docs) - {70, 71, 73, 74, 75, 76, 77}
    t = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    for d, r in got.items():
        want = docs[d][0]
        if d == 72:
            want = want.replace("\n", " ").replace(passage + " ", "")
        assert r.decoded_sha256 == hashlib.sha256(want.encode()).hexdigest(), d
        assert list(r.token_ids) == t.encode(want, add_special_tokens=False).ids
        assert r.n_tokens == len(r.token_ids)


def test_stages_keep_the_columns(spark, planted):
    at, docs, _ = planted
    frame = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, frame, at)
        assert out.dtypes == frame.dtypes
    assert len(P.STAGES) == 5


def test_empty_table(spark, planted, tmp_path):
    at, _, _ = planted
    spark.read.parquet(f"{at}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{at}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stages_with_odd_columns(spark, planted):
    """Names that clash with the operators' own, and names that are no identifiers."""
    from pyspark.sql import functions as F

    at, docs, _ = planted
    frame = spark.read.parquet(f"{at}/documents.parquet").limit(30)
    for name in ("did", "rest", "row", "seq", "a b-c.d", "score", "lang_pred", "kept", "component", "fp"):
        frame = frame.withColumn(name, F.col("doc_id") * 2)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, frame, at)
        assert out.dtypes == frame.dtypes
        assert all(r["did"] == r["a b-c.d"] == r["doc_id"] * 2 for r in out.collect())
    assert P.STAGES[-1][1](spark, frame, at).count() == frame.count()
