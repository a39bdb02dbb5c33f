import hashlib
import random

from kinweave.llm import substring

SCHEMA = "doc_id long, text string, seq string, hit int"


def brute(rows, window):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    starts = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            starts[key] = min(starts.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def sample():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 5)))
    base = [[word() for _ in range(r.randint(0, 160))] for _ in range(25)]
    passage = [word() for _ in range(60)]
    rows = []
    for d in range(80):
        w = list(r.choice(base))
        kind = r.random()
        if kind < 0.4 and w:
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = word()
        elif kind < 0.6:
            at = r.randint(0, len(w))
            w[at:at] = passage[r.randint(0, 12) :]
        rows.append((d, r.choice([" ", "\n", "\t  "]).join(w)))
    return [*rows, (100, None), (101, ""), (102, "one"), (103, "x " * 500), (104, "x " * 300)]


def test_matches_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame([(*x, "extra", 1) for x in rows], SCHEMA)
    got = sorted(tuple(x) for x in substring.digests(docs).collect())
    assert got == brute(rows, 50)


def test_other_windows_and_a_full_filter(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.digests(docs, window=20, period=13, filter_bits=3).collect()
    assert sorted(tuple(x) for x in got) == brute(rows, 20)


def test_empty_and_null_ids(spark):
    assert substring.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(map(str, range(60)))
    docs = spark.createDataFrame([(None, text), (5, text), (5, text), (7, "a")], "doc_id long, text string")
    got = {(x.doc_id, x.n_removed) for x in substring.digests(docs).collect()}
    assert got == {(None, 60), (5, 0), (7, 0)}


def test_cover():
    for period in (1, 2, 7, 13, 31):
        cover = substring.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert len(substring.difference_cover(31)) == 6


def test_stage_keeps_clean_rows(spark):
    text = " ".join(map(str, range(60)))
    docs = spark.createDataFrame([(1, text, "en"), (2, f"a b\n{text} c", "en"), (3, text, "de"), (4, None, "fr"), (5, "a  b", "fr")], "doc_id long, text string, lang string")
    got = {x.doc_id: (x.text, x.lang) for x in substring.without_repeats(docs).collect()}
    assert got == {1: (text, "en"), 2: ("a b c", "en"), 4: ("", "fr"), 5: ("a  b", "fr")}


def test_a_passage_that_very_many_documents_hold(spark, monkeypatch):
    monkeypatch.setattr(substring.C, "HEAVY", 7)
    r = random.Random(2)
    words = lambda n: [f"v{r.randint(0, 9999)}" for _ in range(n)]
    passage, copy = words(70), words(90)
    rows = [(i, " ".join(words(r.randint(0, 40)) + passage + words(r.randint(0, 40)))) for i in range(300)]
    rows += [(1000 + i, " ".join(copy)) for i in range(300)] + [(1000, " ".join(copy)), (None, " ".join(copy)), (None, " ".join(copy))]
    got = sorted((tuple(x) for x in substring.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = brute([(2**63 - 1 if d is None else d, t) for d, t in rows], 50)
    assert got == sorted(((None if d == 2**63 - 1 else d, *x) for d, *x in want), key=str)
