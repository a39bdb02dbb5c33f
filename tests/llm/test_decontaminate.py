import math
import random
from collections import Counter

import numpy as np

from kinweave.llm import decontaminate as D

R = random.Random(9)
WORDS = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 40


def text(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


ITEMS = [(i, text(R.randint(8, 60))) for i in range(70)] + [(70, text(150)), (71, "the of"), (72, None), (73, ""), (None, text(30))]


def corpus():
    docs = []
    for d in range(120):
        words = text(R.randint(0, 500)).split()
        leak = None
        if d % 3 == 0:
            item, t = R.choice(ITEMS[:71] + ITEMS[-1:])
            at = R.randint(0, len(words))
            words[at:at] = t.upper().replace(" ", ", ").split()
            leak = item
        docs.append((d, " ".join(words), d % 3 == 0, leak))
    return docs


def plain(docs, items):
    """All entries against all passages: the rows of the query, by scoring everything."""
    entries, short = [], []
    for item, t in items:
        words = D.words_of(t)
        if 0 < len(words) < D.MIN_WORDS:
            short.append((item, words))
        elif words:
            n = -(-len(words) // D.HALF)
            size = -(-len(words) // n)
            entries += [(item, words[i : i + size]) for i in range(0, len(words), size)]
    df = Counter(w for _, e in entries for w in set(e))
    mean = sum(len(e) for _, e in entries) / max(len(entries), 1)
    idf = {w: math.log1p((len(entries) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    grams = lambda x, n: [tuple(x[i : i + n]) for i in range(len(x) - n + 1)]
    out = set()
    for d, t in docs:
        words, best = D.words_of(t), {}
        for item, e in entries:
            tf = Counter(e)
            weight = {w: idf[w] * n * (D.K1 + 1) / (n + D.K1 * (1 - D.B + D.B * len(e) / mean)) for w, n in tf.items()}
            for p in range(len(words) // D.HALF + 1):
                passage = words[p * D.HALF : (p + 2) * D.HALF]
                score = sum(weight[w] for w in set(passage) & set(weight)) / sum(weight.values())
                if score < D.THRESHOLD:
                    continue
                cut = -(-2 * len(e) // 3)
                q, a = (sum(g in set(grams(passage, min(D.GRAM, len(x)))) for g in grams(x, min(D.GRAM, len(x)))) / len(grams(x, min(D.GRAM, len(x)))) for x in (e[:cut], e[cut:]))
                if q >= D.OVERLAP and a >= D.OVERLAP:
                    best[item] = max(best.get(item, (0, 0, 0)), (score, q, a))
        for item, own in short:
            if any(D.words_of(line) == own for line in (t or "").splitlines()):
                best.setdefault(item, (1.0, 1.0, 1.0))
        out |= {(d, item, *(round(x, 6) for x in v)) for item, v in best.items()}
    return out


def test_rows_equal_scoring_everything(spark, monkeypatch, tmp_path):
    docs = [(d, t) for d, t, _, _ in corpus()] + [(500, None), (501, ""), (502, "THE, of!\nmore words here"), (3, "own text"), (503, ITEMS[5][1] + " " + text(20_000))]
    items = [*ITEMS, (72, ITEMS[5][1])]
    spark.createDataFrame([(*x, 7) for x in docs], "doc_id long, text string, passage int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*x, 7) for x in items], "item_id long, text string, score int").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = plain(docs, items)
    assert (502, 71, 1.0, 1.0, 1.0) in want
    for shard, group in ((4096, 1 << 22), (17, 1000)):
        monkeypatch.setattr(D, "SHARD_ITEMS", shard)
        monkeypatch.setattr(D, "GROUP_BYTES", group)
        got = [tuple(r)[:5] for r in D.op7_decontaminate(spark, str(tmp_path)).collect()]
        assert len(got) == len(want)
        assert {(d, i, *(round(x, 6) for x in v)) for d, i, *v in got} == want


def test_leaks_are_found_and_clean_rows_left(spark):
    docs = corpus()
    frame = spark.createDataFrame([(d, t, 0) for d, t, _, _ in docs] + [(500, None, 0), (501, "", 0), (3, docs[3][1], 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.did, r.item_id) for r in D.find_leaks(frame, items).collect()}
    assert got == {(d, leak) for d, _, has, leak in docs if has}
    kept = {r.doc_id for r in D.without_leaks(frame, items).collect()}
    assert kept == {d for d, _, has, _ in docs if not has} | {500, 501}


def test_many_items_and_ids_that_are_texts(spark):
    r = random.Random(4)
    own = [" ".join(f"v{r.randint(0, 5000)}" for _ in range(r.randint(12, 40))) for _ in range(2500)]
    items = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(own)], "item_id string, text string").repartition(3)
    docs = spark.createDataFrame([(i, text(40) + " " + own[i * 250] + " " + text(40)) for i in range(10)], "doc_id long, text string")
    assert len(D.build(items)) == 3
    assert {(x.did, x.item_id) for x in D.find_leaks(docs, items).collect()} == {(i, f"i{i * 250}") for i in range(10)}


def test_wand_equals_scoring_everything(spark, monkeypatch):
    for shard in (4096, 17):
        monkeypatch.setattr(D, "SHARD_ITEMS", shard)
        for index in map(D.shard, D.build(spark.createDataFrame(ITEMS, "item_id long, text string"))):
            for _, t, _, _ in corpus()[:40]:
                seq = np.array([index.ids.get(w, -1) for w in D.words_of(t)], np.int64)
                for threshold in (0.1, 0.3, 0.6):
                    got = {(p, e): round(s, 6) for p, e, s in index.retrieve(seq, threshold)} if index.entries else {}
                    want = {}
                    for p in range(len(seq) // D.HALF + 1):
                        terms = set(seq[p * D.HALF : (p + 2) * D.HALF].tolist()) - {-1}
                        for e in range(len(index.entries)):
                            s = sum(x for t2 in terms for e2, x in index.postings.get((t2, e // 4), []) if e2 == e)
                            if s >= threshold:
                                want[p, e] = round(s, 6)
                    assert got == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.find_leaks(docs, none).count() == 0
    assert D.without_leaks(docs, none).count() == 1
    assert D.find_leaks(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
