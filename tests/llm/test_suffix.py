import hashlib
import random

import numpy as np

from kinweave.llm import suffix


def brute(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = {}
    for _, t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def sample():
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    base = [text(r.randint(0, 900)) for _ in range(15)]
    passage = text(260)
    rows = []
    for d in range(60):
        t = r.choice(base)
        if r.random() < 0.5:
            for _ in range(r.randint(1, 2)):
                at = r.randint(0, len(t))
                t = t[:at] + r.choice("xyz") + t[at + r.randint(0, 1) :]
        if r.random() < 0.3:
            at = r.randint(0, len(t))
            t = t[:at] + passage[r.randint(0, 30) :] + t[at:]
        rows.append((d, t))
    own = text(210)
    return [*rows, (60, None), (61, ""), (62, "a" * 201), (63, "b" * 200), (64, "ab" * 400), (65, own + "q" + own), (66, text(250) + "c" * 230), (0, rows[0][1])]


def test_matches_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, key int")
    for length, bits in ((200, 28), (40, 4)):
        got = sorted(tuple(x) for x in suffix.digests(docs, length=length, filter_bits=bits).collect())
        assert got == brute(rows, length)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_long_text_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix, "_SEGMENT", 300)
    r = random.Random(1)
    t = "".join(r.choice("ab cde") for _ in range(2000))
    rows = [(1, t), (2, t[500:1400] + "z" + t[200:450])]
    got = sorted(tuple(x) for x in suffix.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows, 200)


def test_repeat_in_two_segments_of_one_text(spark):
    r = random.Random(7)
    own = lambda n: "".join(r.choices("abcdefgh", k=n))
    passage, size = own(200), suffix._SEGMENT
    parts = [own(size // 2) + "1", passage, "2" + own(2 * size) + "3", passage, "4" + own(size // 2)]
    kept = "".join(parts[::2]).encode()
    got = [tuple(x) for x in suffix.digests(spark.createDataFrame([(1, "".join(parts))], "doc_id long, text string")).collect()]
    assert got == [(1, len(kept) + 400, 400, 2, hashlib.sha256(kept).hexdigest())]


def test_flags_over_segments(monkeypatch):
    monkeypatch.setattr(suffix, "_SEGMENT", 300)
    r = random.Random(9)
    own = lambda n: bytes(r.choices(range(97, 123), k=n))
    a, passage, b, c = own(310), own(200), own(700), own(1000)
    for text, times in ((a + passage + b + passage + c, 2), (a + passage + b + passage + b"-" + passage + c, 3)):
        runs = suffix.Runs([own(500), text], 200)
        at = [i for i in range(len(text) - 199) if text[i : i + 200] == passage]
        assert len(at) == times
        for i in at:
            assert runs.again[(runs.row == 1) & (runs.first <= i) & (i <= runs.last)].all()
        for row, size in ((0, 500), (1, len(text))):
            mine = runs.row == row
            covered = np.concatenate([np.arange(x, y + 1) for x, y in zip(runs.first[mine], runs.last[mine], strict=True)])
            assert sorted(covered.tolist()) == list(range(size - 199))


def test_hot_keys_are_counted_string_by_string(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_CONTEXTS", 3)
    monkeypatch.setattr(suffix.C, "HEAVY", 1)
    r = random.Random(5)
    own = lambda n: "".join(r.choices("abcdefgh", k=n))
    passage = own(260)
    rows = [(i, own(r.randint(0, 300)) + passage + own(r.randint(0, 300))) for i in range(30)] + [(99, rows) for rows in [passage * 3] * 5]
    for heavy in (1, 1000):
        monkeypatch.setattr(suffix.C, "HEAVY", heavy)
        got = sorted(tuple(x) for x in suffix.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == brute(rows, 200)


def test_columns_of_any_name_come_back(spark):
    rows = [(1, "x" * 450, 3, "a"), (2, "short", 4, "b"), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, u long, `key.spans` string")
    got = sorted(suffix.find_repeats(docs).collect(), key=lambda x: x.did)
    assert [(x.did, x.text, x.rest["u"], x.rest["key.spans"], [tuple(s) for s in x.spans]) for x in got] == [(1, "x" * 450, 3, "a", [(0, 450)]), (2, "short", 4, "b", []), (3, "", None, None, [])]


def test_longest_factors():
    r = np.random.default_rng(0)
    data = r.integers(97, 99, 300).astype(np.uint8)
    for cap in (8, 11, 16, 40):
        starts = np.arange(len(data) - cap + 1)
        earlier, later = suffix.longest_factors(data, starts, cap)

        def common(i, j, cap=cap):
            n = 0
            while n < cap and data[i + n] == data[j + n]:
                n += 1
            return n

        assert earlier.tolist() == [max((common(i, j) for j in range(i)), default=0) for i in starts]
        assert later.tolist() == [max((common(i, j) for j in range(i + 1, len(starts))), default=0) for i in starts]


def test_empty(spark):
    assert suffix.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_first_inside_a_text(spark):
    t = "".join(chr(33 + i * 7 % 90) for i in range(90)) * 5
    got = [tuple(x) for x in suffix.earlier_factors(spark.createDataFrame([(1, t)], "doc_id long, text string"), length=100).collect()]
    assert got == [(1, 90, 360)]
