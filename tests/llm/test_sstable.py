import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinweave.llm import sstable

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "  two  spaces \n\n x", "It's Über-naïve 東京 12345!\t\n", "a<|endoftext|> b<|endoftext|>", "x\t \ny  \n z ", "plain words here, twice: plain words", "z" * 3000, " 　 a b", "q", "a word, (another) and word; word. 'tis it's it's. naïve, Été! x.y. -- ... a,b 's. Ǆ."]


@pytest.mark.parametrize("limit", [1 << 28, 64])
def test_equals_the_library(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(sstable, "SHARD_BYTES", limit)
    t = Tokenizer.from_file(PATH)
    rows = [(i * 37 % 101 - 20, x, 0) for i, x in enumerate(TEXTS * 3)]
    rows += [(None, "no id", 0), (5, "same id", 0), (5, "same id", 0), *[(7, f"hot {i % 9}", 0) for i in range(40)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    shards = sstable.write_table(docs, PATH, f"file://{tmp_path}/t")
    assert limit > 64 or len(shards) > 20
    got = sstable.digests(spark, shards).collect()
    want, at = [], 0
    text = F.coalesce("text", F.lit(""))
    ordered = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("hash")).collect()
    for d, text, _ in sorted(ordered, key=lambda r: (2**63 - 1 if r[0] is None else r[0], r[2])):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    found = [x.tolist() for name, _, _ in shards for x in sstable.Shard(name).get(7)]
    assert len(found) == sum(d == 7 for d, _, _ in rows)


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sstable.digests(spark, sstable.write_table(docs, PATH, f"file://{tmp_path}/e")).count() == 0


def test_lookup(tmp_path):
    r = random.Random(6)
    rows = sorted({r.randint(-(2**40), 2**62) for _ in range(3000)})
    table = []
    for ident in rows:
        for _ in range(40 if ident == rows[1500] else 1):
            table.append((ident, np.array([r.randrange(200_000 if ident % 3 == 0 else 60_000) for _ in range(r.randint(0, 60))], np.int64)))
    uri = f"file://{tmp_path}/x/one.sst"
    docs, ids, _ = sstable.write_shard(uri, table)
    shard = sstable.Shard(uri)
    assert (docs, ids) == (len(table), sum(len(x) for _, x in table)) == (shard.docs, shard.total)
    assert len(shard.blocks) > 3
    assert [(i, x.tolist()) for i, x in shard.scan()] == [(i, x.tolist()) for i, x in table]
    for ident in [*rows[::97], rows[0], rows[-1], rows[1500]]:
        assert [x.tolist() for x in shard.get(ident)] == [x.tolist() for i, x in table if i == ident]
    for ident in range(1000, 1400):
        assert ident in rows or shard.get(ident) == []


def test_table_reads_back(spark, tmp_path):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "doc_id long, text string")
    t = Tokenizer.from_file(PATH)
    got = {r.did: list(r.ids) for r in sstable.read_table(spark, sstable.write_table(docs, PATH, f"file://{tmp_path}/r", end_id=None)).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
