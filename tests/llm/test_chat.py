import hashlib
import random

import duckdb
import pytest

from kinweave.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string, loss int"
T = chat.Template()


def rows():
    r = random.Random(2)
    parts = [*T.control_strings, "\\", "[", "<", "|", "end|>", "é", " x\n", "</s", "s>", "\U0001f600"]
    out = []
    for c in range(60):
        for t in range(r.randint(1, 9)):
            role = ["user", "assistant"][t % 2] if c % 3 else r.choice(["system", "user", "assistant", "tool", "<|end|>", None])
            out.append((c, t if c % 5 else 3, role, r.choice([None, ""]) if r.random() < 0.1 else "".join(r.choice(parts) for _ in range(r.randint(0, 30))), 0))
    return [*out, (None, 1, "user", "a", 0), (None, None, "user", "b", 0), (99, 0, "assistant", "x" * 100_000, 0)]


def plain(data):
    convs = {}
    for c, t, role, text, _ in data:
        convs.setdefault(c, []).append((t is not None, t, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda x: (x[0], x[1] or 0, x[2].encode(), x[3].encode()))
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        both = "".join(f"{x[2]}\n{x[3]}\n" for x in turns)
        out[c] = (len(turns), hashlib.sha256(both.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_read_back_gives_what_went_in(spark):
    data = rows()
    formatted = chat.format_turns(spark.createDataFrame(data, SCHEMA))
    got = chat.read_back(formatted).collect()
    null = 2**63 - 1
    assert {None if r.conv == null else r.conv: tuple(r)[1:5] for r in got} == plain(data)
    texts = {}
    for r in formatted.collect():
        texts.setdefault(r.conv, []).append((r.at, r.text))
    for r in got:
        whole = "".join(t for _, t in sorted(texts[r.conv]))
        assert len(whole) == r.formatted_chars
        assert whole.count(T.begin) == 1 and whole.count(T.close) == whole.count(T.open[0]) == r.n_turns
        assert not any(c in whole for c in T.controls)


def test_escaping_is_reversible():
    r = random.Random(1)
    t = chat.Template(begin="ab", open=("ba", "bb"), close="aab", controls=("aba",))
    for _ in range(3000):
        s = "".join(r.choice("ab\\") for _ in range(r.randint(0, 12)))
        e = t.escape(s)
        assert t.unescape(e) == s and not any(c in e for c in t.control_strings)


def test_machine_names_bad_turns(spark):
    data = [(1, 0, "user", "a", 0), (1, 1, "user", "b", 0), (1, 2, "assistant", "c", 0), (2, 0, "assistant", "d", 0), (3, 0, "system", "s", 0), (3, 1, "user", "u", 0), (3, 2, "assistant", "v", 0)]
    got = {(r.conv, r.at): r.problem for r in chat.format_turns(spark.createDataFrame(data, SCHEMA)).collect()}
    assert {k: v for k, v in got.items() if v} == {(1, 1): "user after user", (2, 0): "assistant after the start"}
    with pytest.raises(ValueError):
        chat.Template(close="x")


def test_sql(spark, tmp_path):
    data = [(c, t, role, text, 0) for i, (c, t, role, text, _) in enumerate(rows()) if c is not None and role for t in [i]]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = chat.op5_chat(spark, str(tmp_path))
    rel = db.execute(chat.ORACLE)
    assert [c[0] for c in rel.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())


def test_empty(spark):
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], SCHEMA))).count() == 0
