import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kinweave.llm import langid

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "tz", "ein", "ung"], "cc": ["é", "eau", "oi", "ç"], "dd": ["ción", "rr", "ñ", "ja"], "ee": ["ост", "ни", "ко", "ва"]}


def corpus(n=400, seed=0):
    r = random.Random(seed)
    rows = []
    for d in range(n):
        lang = r.choice(list(SYLLABLES))
        words = ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 60))]
        rows.append((d, " ".join(words), lang if r.random() < 0.9 else None, lang))
    return rows


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, truth string")
    model = langid.train(docs)
    got = langid.predict(docs, model).select("row.*", "lang_pred", "score", "ambiguous", langid.held_out("row`.`doc_id").alias("held")).collect()
    assert len(got) == 400
    held = [x for x in got if x.held]
    assert all(x.held == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    assert sum(x.lang_pred == x.truth for x in held) / len(held) > 0.95
    assert all(0 <= x.score <= 1 and x.ambiguous == (x.score < 0.5) for x in got)


def test_held_out_rows_and_null_languages_teach_nothing(spark):
    rows = corpus()
    other = [(d, t, "zz" if zlib.crc32(str(d).encode()) % 5 == 0 else lang, x) for d, t, lang, x in rows]
    schema = "doc_id long, text string, lang string, truth string"
    a, b = (langid.train(spark.createDataFrame(x, schema)) for x in (rows, other))
    assert a.langs == b.langs == sorted(SYLLABLES)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.trust, b.trust)


def test_undetermined_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "12 !?", 3), (4, "ka lo", 4), (None, "sch", 5), (4, "ka lo", 6), (5, "é" * 200_000, 7)], "doc_id long, text string, score int")
    model = langid.train(spark.createDataFrame(corpus(), "doc_id long, text string, lang string, truth string"))
    got = {x.row.score: (x.lang_pred, x.score) for x in langid.predict(docs, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4] == got[6] and got[4][0] == "aa"
    assert got[5][0] == "bb" and got[7][0] == "cc"


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    assert [(x.lang_pred, x.score) for x in langid.predict(docs, langid.train(docs)).collect()] == [("und", 0.0)]
    one = spark.createDataFrame([(d, "a b", "xx") for d in range(9)], "doc_id long, text string, lang string")
    assert {x.lang_pred for x in langid.predict(one, langid.train(one)).collect()} == {"xx"}
    empty = docs.where(F.lit(False))
    assert langid.predict(empty, langid.train(empty)).count() == 0


def test_codewords_differ():
    for n in (2, 3, 4, 5, 6, 7, 20, 60, 200):
        code = langid.codewords(n)
        assert len({tuple(x) for x in code}) == n
        assert (np.abs(code.sum(axis=0)) < n).all()
    assert min((langid.codewords(5)[i] != langid.codewords(5)[j]).sum() for i in range(5) for j in range(i)) == 8


def test_whole_texts_count():
    text = "a b c d e" * 30_000
    n = sum(len(g) for g in langid.grams(text))
    assert n == sum(len(text) + 2 - k + 1 for k in langid.GRAMS)


def plain(rows):
    """(doc_id, held_out, lang_pred, score) of (doc_id, text, lang), without numpy in the counting and without Spark."""

    def grams(text):
        data = f" {text.lower()} ".encode()
        return [((int.from_bytes(data[i : i + n], "big") + n) * 2654435761 % 2**32) >> 17 for n in (1, 2, 3, 4) for i in range(len(data) - n + 1)]

    letters = lambda t: t is not None and any(c.isalpha() for c in t)
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d, _, _ in rows}
    learn = [(t, lang) for d, t, lang in rows if not held[d] and lang is not None and letters(t)]
    langs = sorted({x for _, x in learn})
    counts = {x: [0.0] * langid.BUCKETS for x in langs}
    for t, lang in learn:
        for g in grams(t):
            counts[lang][g] += 1
    rate = {x: [(c + 0.5) / (sum(counts[x]) + 0.5 * langid.BUCKETS) for c in counts[x]] for x in langs}
    code = langid.codewords(len(langs))
    sides = [([x for i, x in enumerate(langs) if code[i, b] > 0], [x for i, x in enumerate(langs) if code[i, b] < 0]) for b in range(code.shape[1])]
    memo = {}

    def weight(b, g):
        if (b, g) not in memo:
            one, two = sides[b]
            memo[b, g] = math.log(sum(rate[x][g] for x in one) / len(one)) - math.log(sum(rate[x][g] for x in two) / len(two))
        return memo[b, g]

    def margins(t):
        gs = Counter(grams(t))
        n = sum(gs.values())
        return [sum(weight(b, g) * k for g, k in gs.items()) / n * min(n, 100) for b in range(len(sides))]

    right = [0] * len(sides)
    for t, lang in learn:
        for b, m in enumerate(margins(t)):
            right[b] += code[langs.index(lang), b] * m > 0
    trust = [max(math.log((k + 1) / (len(learn) + 1 - k)), 0.01) for k in right]
    mean = sum(trust) / len(trust)
    out = {}
    for d, t, _ in rows:
        if not letters(t):
            out[d] = (held[d], "und", 0.0)
            continue
        m = margins(t)
        loss = [sum(math.log1p(math.exp(-c * x)) * w / mean for c, x, w in zip(code[i].tolist(), m, trust, strict=True)) for i in range(len(langs))]
        share = [math.exp(min(loss) - x) for x in loss]
        best = loss.index(min(loss))
        out[d] = (held[d], langs[best], share[best] / sum(share))
    return out


def test_query_equals_a_plain_version(spark, tmp_path):
    rows = [(d, t, lang) for d, t, lang, _ in corpus(120, 3)] + [(900, None, "aa"), (901, "12", "bb"), (902, "", None), (903, "ka lo " * 3000, "aa")]
    spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in langid.op10_language_id(spark, str(tmp_path)).collect()}
    want = plain(rows)
    assert {d: x[:2] for d, x in got.items()} == {d: x[:2] for d, x in want.items()}
    assert all(abs(got[d][2] - want[d][2]) < 1e-4 for d in want)
