import numpy as np
from pyspark.sql import functions as F

from kinweave.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, every, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    dim = max({len(v) for _, v in ok}, key=lambda n: sum(len(v) == n for _, v in ok), default=0)
    ok = [(i, v) for i, v in ok if len(v) == dim]
    out = {}
    for q, x in ok:
        if q % every == 0:
            near = sorted((-sum(float(a) * float(b) for a, b in zip(x, v, strict=True)), i) for i, v in ok if i != q)[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def got(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.qid, r.rank)):
        out.setdefault(r.qid, []).append((r.vid, r.score))
        assert r.rank == len(out[r.qid])
    return out


def sample(n=1500, dim=24):
    r = np.random.default_rng(5)
    x = r.normal(size=(n, dim)).astype(np.float32)
    x[400:900] = x[400]
    x[900:1000] = 3 * x[401]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    return [*rows, (5000, None, 0), (5020, [0.0] * dim, 0), (5040, [float("nan")] * dim, 0), (5060, [1.0, None] * (dim // 2), 0), (5080, [1.0] * 3, 0), (None, [1.0] * dim, 0), (5100, [float("inf")] + [0.0] * (dim - 1), 0), (5120, [], 0)]


def test_recall_and_scores(spark, monkeypatch):
    rows = sample()
    monkeypatch.setattr(ann, "BUCKET_ROWS", 50)
    v = spark.createDataFrame(rows, SCHEMA)
    found, want = got(ann.search(v, v.where(F.col("vec_id") % 20 == 0), 20)), brute(rows, 20, 20)
    assert set(found) == set(want)
    hits = [len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) > 0.9
    index = {i: np.array(x, np.float32).astype(float) for i, x, _ in rows[:1500]}
    for q, near in found.items():
        assert len({i for i, _ in near}) == 20 and q not in dict(near)
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - float(index[q] @ index[i])) < 1e-9 for i, s in near)


def test_recall_with_two_hashes(spark, monkeypatch):
    monkeypatch.setattr(ann, "SIZES", ((100, 10, 1, 8), (None, 32, 2, 48)))
    assert ann.sized(100) == (10, 1, 8) and ann.sized(101) == (32, 2, 48)
    rows = sample()
    v = spark.createDataFrame(rows, SCHEMA)
    found, want = got(ann.search(v, v.where(F.col("vec_id") % 100 == 0), 20)), brute(rows, 100, 20)
    assert set(found) == set(want)
    assert np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 20 for q in want]) > 0.9


def test_exact_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "_ROWS", 37)
    rows = sample(1000)
    v = spark.createDataFrame(rows, SCHEMA).repartition(5)
    usable, dim = ann.usable(v, "vec_id", "embedding")
    asked = ann.C.stored(usable.where("vid % 20 = 0"), "asked")
    found, want = got(ann.exact(usable, asked, dim, 20)), brute(rows, 20, 20)
    assert {q: [i for i, _ in x] for q, x in found.items()} == {q: [i for i, _ in x] for q, x in want.items()}


def test_few_rows_are_all_found(spark):
    rows = [(i, [float(i + 1), 1.0, float(i % 3)], 0) for i in range(12)]
    v = spark.createDataFrame(rows, SCHEMA)
    found = got(ann.search(v, v.where(F.col("vec_id") % 5 == 0), 20))
    want = brute(rows, 5, 20)
    assert {q: [i for i, _ in x] for q, x in found.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(len(x) == 11 for x in found.values())


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 2.0], 0) for i in range(100)] + [(3, [1.0, 2.0], 0)]
    v = spark.createDataFrame(rows, SCHEMA)
    found = got(ann.search(v, v.where("vec_id = 40"), 5))
    assert [i for i, _ in found[40]] == [0, 1, 2, 3, 4]


def test_empty(spark):
    v = spark.createDataFrame([], SCHEMA)
    assert ann.search(v, v, 5).count() == 0


def test_rotations_keep_lengths_and_probes_start_at_home():
    r = np.random.default_rng(2)
    x = r.normal(size=(50, 10))
    t = ann.Tables(10, 6, 2, 9)
    assert t.size == 16
    y = t._turned(x, 0, 0)
    assert np.allclose(np.linalg.norm(y, axis=1), 1)
    home, probed = t.buckets(x), t.probed(x)
    assert (probed[:, :, :2] == home[:, :, None]).any(axis=2).all() and probed.shape == (50, 6, 9)  # two axes may tie
