"""From ``documents`` to token ids in five stages.

1. language ID: rows without a language that stands out go;
2. SimHash near-dedup: of each group of near copies (five-word shingles, similarity 0.8) the smallest id stays;
3. substring dedup: words of 50-word windows that repeat a document of smaller id are cut out;
4. benchmark decontamination: documents holding a test item go;
5. BPE: token ids, and a digest of what they decode to.

Each stage's result is written as Parquet under ``spark.checkpoint.dir`` and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import bpe, common, decontaminate, langid, simhash, substring

TOKENIZER = "byte_bpe_50k.json"
#: Workers that encode go on to other stages, and keep their memos: smaller ones than for encoding alone.
MEMO_PIECES = 20_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs)
    found = langid.predict(docs, model).where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous"))
    return found.select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(TOKENIZER)
    found = bpe.encode(docs, path, digest=True, memo=MEMO_PIECES)
    return found.select(common.plain_id().alias("doc_id"), "rest.lang", "rest.source", "n_tokens", F.col("ids").alias("token_ids"), "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("bpe", tokenize),
]

#: No stage but the third has an equivalent in SQL; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        before, path = path, common.scratch(spark, f"stage-{name}")
        with common.cleaned(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.release(spark, [before])
    return docs
