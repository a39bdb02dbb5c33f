import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from kinweave.llm import common, simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius):
    fps = [(d, brute_print(t)) for d, t in rows]
    group = {i: i for i in range(len(fps))}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
                group[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(fps):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, f"{fp:016x}", low[root(i)]) for i, (d, fp) in enumerate(fps))


def sample():
    r = random.Random(2)
    base = [" ".join(f"w{r.randint(0, 400)}" for _ in range(r.randint(0, 300))) for _ in range(20)]
    rows = []
    for d in range(150):
        words = r.choice(base).split()
        for _ in range(r.randint(0, 2)):
            if words:
                words[r.randrange(len(words))] = f"w{r.randint(0, 400)}"
        rows.append((d, " ".join(words)))
    return [*rows, (200, None), (201, ""), (202, "One"), (203, "oNE"), (204, "one two"), (205, "É x\ty"), (206, "a " * 3000)]


def digest(found):
    from pyspark.sql import functions as F

    return sorted((x.did, x.f, x.component) for x in found.select("did", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component").collect())


def test_matches_brute_force(spark, monkeypatch):
    rows = sample()
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, component long")
    monkeypatch.setattr(simhash, "TILE_MIN", 16)
    for radius in (3, 8):
        assert digest(simhash.components(simhash.fingerprints(docs), radius)) == brute_components(rows, radius)


def test_tiles_equal_all_pairs():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**63, 3000, dtype=np.uint64)
    x[1000:2000] = x[:1000] ^ np.uint64(5)
    node, to = simhash.tile_links(x, None, 3)
    assert sorted(zip(node.tolist(), to.tolist(), strict=True)) == [(i + 1000, i) for i in range(1000)]
    node, to = simhash.tile_links(x[:1000], x[1000:], 3)
    assert sorted(zip(node.tolist(), to.tolist(), strict=True)) == [(i + 1000, i) for i in range(1000)]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.components(simhash.fingerprints(docs)).count() == 0


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "x y z")], "doc_id long, text string")
    got = sorted((x.did, x.component) for x in simhash.components(simhash.fingerprints(docs)).collect())
    assert got == [(3, 3), (3, 3), (common.NULL_ID, 3), (common.NULL_ID, common.NULL_ID)]


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 2000), (5, 5)], "a long, b long")
    got = {(x.node, x.component) for x in common.connected_components(edges, "t").collect()}
    assert got == {(i, 0) for i in range(1, 301)} | {(2000, 1000)}


def test_near_copies_leave_one_row_of_each_group(spark):
    r = random.Random(8)
    rows, groups = [], {}
    for g in range(30):
        base = [f"w{r.randint(0, 3000)}" for _ in range(r.randint(150, 400))]
        for k in range(r.randint(1, 5)):
            words = list(base)
            for _ in range(min(k, 2)):
                words[r.randrange(len(words))] = f"x{r.randint(0, 3000)}"
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(words), g))
    rows += [(900, "one two", 0), (901, None, 0), (902, "", 0), (903, None, 0), (904, "one three", 0), (905, "one two", 0), (905, "one two", 0), (None, "one two", 1), (None, "own text here", 1)]
    got = simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string, seq long"))
    assert got.columns == ["doc_id", "text", "seq"]
    ids = [x.doc_id for x in got.collect()]
    assert len(ids) == len(set(ids))
    first = {}
    for d, g in groups.items():
        first.setdefault(g, d)
    assert set(ids) == set(first.values()) | {900, 901, 904, None}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.without_near_copies(empty).count() == 0


def test_wide_distance_follows_similarity():
    r = np.random.default_rng(3)
    for similarity in (0.6, 0.8, 0.9):
        far = []
        for _ in range(40):
            n = 600
            both = r.integers(0, 2**63, n, dtype=np.uint64)
            own = int(n * (1 - similarity) / (2 * similarity))
            x, y = (np.concatenate([both, r.integers(0, 2**63, own, dtype=np.uint64)]) for _ in range(2))
            far.append(np.bitwise_count(simhash.wide_fingerprint(common.mix64(x), 8) ^ simhash.wide_fingerprint(common.mix64(y), 8)).sum())
        assert abs(np.mean(far) - simhash.radius_of(similarity, 512)) < 6


def test_a_repeated_line_makes_no_near_copies(spark):
    line = " ".join(f"l{i}" for i in range(10))
    rows = [(d, " ".join([line] * 100 + [f"own{d}w{i}" for i in range(200)])) for d in range(4)]
    got = simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x.doc_id for x in got.collect()) == [0, 1, 2, 3]


def test_verified_links_match_all_pairs():
    r = np.random.default_rng(4)
    sets = []
    for n in (1, 4, 5, 9, 10, 40, 100):
        base = r.integers(0, 2**63, n, dtype=np.uint64)
        for _ in range(12):
            own = r.integers(0, 2**63, int(r.integers(0, n // 3 + 2)), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([base[: n - int(r.integers(0, n // 6 + 1))], own])))
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8]
    a, b = (np.array(x) for x in zip(*near, strict=True))
    got = simhash.verified_links(sets, 0.8)
    assert set(got) <= set(near)
    c, d = (np.array(x) for x in zip(*got, strict=True))
    assert np.array_equal(simhash._labels(len(sets), a, b), simhash._labels(len(sets), c, d))


def test_copies_just_similar_enough(spark):
    pairs = []
    for p in range(40):
        both = [f"b{p}w{i}" for i in range(404)]
        pairs.append([" ".join(both + [f"{side}{p}w{i}" for i in range(50)]) for side in "xy"])
    for p in range(20):
        both = [f"s{p}w{i}" for i in range(8 + p)]  # one word more or less: 0.8 at 8 words
        pairs.append([" ".join(both), " ".join([*both, "more"])])
    rows = [(2 * p + k, t) for p, pair in enumerate(pairs) for k, t in enumerate(pair)]
    got = simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x.doc_id for x in got.collect()) == list(range(0, len(rows), 2))


def test_groups_cut_into_blocks(spark, monkeypatch):
    """One large group of near copies, compared in blocks of some texts, and unlike texts that share a passage with it."""
    monkeypatch.setattr(simhash, "GROUP_BYTES", 6_000)
    r = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for d in range(40):
        words = list(base)
        words[r.randrange(200)] = f"x{d}"
        rows.append((d, " ".join(words)))
    rows += [(100 + d, " ".join(base[:150] + [f"o{d}w{i}" for i in range(120)])) for d in range(6)]
    got = simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x.doc_id for x in got.collect()) == [0, *range(100, 106)]


def test_ids_that_stand_twice_join_no_unlike_classes(spark):
    texts = ["a b c d e", "q r s t u v", "k l m n o p"]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[1]), (3, texts[2]), (3, texts[0])]
    got = {(x.did, x.fp): x.component for x in simhash.components(simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert sorted(got.values()) == [3, 3, 3, 7, 7]


def test_only_sets_of_like_size_meet(spark):
    """Sizes on both sides of each bound: all pairs that may be similar meet, sizes far apart do not."""
    sizes = [0, 1, 4, 5, *range(40, 60, 3), 80, 100, 125, 400, 500, 512, 640, 641, 5000, 6250, 100_000]
    rows = [(i * 7919, i, n) for i, n in enumerate(sizes)]
    reps = spark.createDataFrame(rows, "fp long, rep long, n long").withColumn("class", simhash.size_class(F.col("n"), 0.8)).drop("n")
    met = set()
    for r in simhash.tile_pairs(reps, 24).collect():
        x, y = [t.rep for t in r.x], [t.rep for t in r.y] if r.y else None
        met |= {frozenset((a, b)) for a in x for b in (x if y is None else y)}
    for i, a in enumerate(sizes):
        for j, b in enumerate(sizes[:i]):
            if min(a, b) >= 0.8 * max(a, b):
                assert frozenset((i, j)) in met, (a, b)
            elif max(min(a, b), 1) < 0.63 * max(a, b):
                assert frozenset((i, j)) not in met, (a, b)
