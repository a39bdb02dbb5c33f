import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.config import Config
from kinweave.operators import blocking as B
from kinweave.operators import cosines as C
from kinweave.operators import features as X
from kinweave.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def records(spark, ident):
    """Words of either side; some ids and terms are missing, one id stands twice, one in two partition keys."""
    r = random.Random(7)
    rows = [(key, side, f"{side}{n}", " ".join(r.choices("ab cd efg hi é j kl".split(), k=r.randrange(9))), " ".join(f"w{int(r.expovariate(0.1))}" for _ in range(r.randrange(60)))) for key in ("us", "fr", None) for side in "qi" for n in range(12)]
    rows += [("us", "i", "i3", "again", "w1 w2 w2"), ("us", "q", None, "ab", "w1"), ("us", "i", "i99", None, None)]
    df = spark.createDataFrame(rows, "ckey string, side string, rec_id string, n_core string, a_full string")
    return df.withColumn("rec_id", F.substring("rec_id", 2, 9).cast(ident))


@pytest.mark.parametrize("held, ident", [(6_000_000, "string"), (150, "long")])
def test_cosines_of_pairs(spark, monkeypatch, held, ident):
    monkeypatch.setattr(C, "HELD_TERMS", held)
    monkeypatch.setattr(C, "RECORDS", 5)
    recs = records(spark, ident).repartition(6, "rec_id").localCheckpoint()
    side = lambda s: recs.where(F.col("side") == s).select("ckey", F.col("rec_id").alias(f"{s}_id")).distinct()
    pairs = side("q").join(side("i"), "ckey").select(*X.PAIR, F.lit(5).alias("bits"))
    pairs = pairs.unionByName(spark.createDataFrame([("us", "1", "77", 5)], "ckey string, q_id string, i_id string, bits int").select("ckey", F.col("q_id").cast(ident), F.col("i_id").cast(ident), "bits"))
    terms = {"c": X.char_terms("n_core"), "n": X._words("n_core"), "a": X._words("a_full")}
    got = C.pair_cosines(pairs, recs, terms)
    assert got.columns == [*pairs.columns, *terms]
    got = {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()}
    assert len(got) == pairs.count() and all(v[0] == 5 for v in got.values())
    for k, (name, column) in enumerate(terms.items(), 1):
        want = X.pair_cosine(pairs, X.cosine_weights(recs, column), name).collect()
        assert {tuple(r)[:3]: r[name] for r in want} == pytest.approx({p: v[k] for p, v in got.items()}, abs=1e-12)
    assert sum(v[3] > 0 for v in got.values()) > 100


def test_cosines_without_pairs_or_records(spark):
    recs, pairs = records(spark, "long"), spark.createDataFrame([], "ckey string, q_id long, i_id long")
    assert C.pair_cosines(pairs, recs, {"a": X._words("a_full")}).collect() == []
    one = spark.createDataFrame([("us", 1, 2)], pairs.schema)
    assert [tuple(r) for r in C.pair_cosines(one, recs.limit(0), {"a": X._words("a_full")}).collect()] == [("us", 1, 2, 0.0)]


def test_features_deal_no_row_a_term(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(X, "context_features", lambda x, f=X.context_features: made.setdefault("x", f(x)))
    base = X.base_features
    monkeypatch.setattr(X, "base_features", lambda *a: made.setdefault("base", base(*a)))
    rows = QUERIES["pair_features"](spark, DATA)
    assert "generate" not in made["base"]._jdf.queryExecution().executedPlan().toString().lower()
    # windows carry what they read and make
    assert len(made["x"].columns) < 25 and rows.count() > 0 and not spark.catalog._jcatalog.listTables().count()


def test_words_of_a_long_record_are_sent_without_their_list(spark, monkeypatch):
    """Each word sent took a copy of its record's words along: 258 MB here."""
    given, frame = [], type(spark.range(0))
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, made=frame.mapInArrow: given.append((self, f)) or made(self, f, *a))
    own = " ".join(f"{n:08d}" for n in range(4_000))
    recs = spark.createDataFrame([("us", 1, "q", own + " oak elm"), ("us", 2, "i", "elm oak")], "ckey string, rec_id long, side string, a_alpha string")
    got = sorted(tuple(r) for r in B.rare_words(recs, "a_alpha", 1).collect())
    assert got == [("us", 1, "q", "elm"), ("us", 2, "i", "elm")]
    rows, pick = given[-1]
    batches, pool, before = rows.toArrow().to_batches(), pa.proxy_memory_pool(pa.default_memory_pool()), pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        assert sum(b.num_rows for b in pick(iter(batches))) == 4_002
    finally:
        pa.set_memory_pool(before)
    assert pool.max_memory() < 10_000_000
