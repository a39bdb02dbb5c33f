import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.functions import similarity as S
from kinweave.functions import text as T
from kinweave.functions.addresses import normalize_addresses
from kinweave.functions.names import normalize_names
from kinweave.functions.phonetic import nysiis, spoken
from kinweave.functions.tags import address_tags, name_tags

WORDS = st.text(alphabet="abcde fgh", max_size=14)


@pytest.mark.parametrize(("token", "want"), [("industries", "intstrs"), ("imdastris", "intstrs"), ("", ""), ("2024", "2024"), ("shah", "sh"[:1])])
def test_skeleton(spark, token, want):
    assert spark.createDataFrame([(token,)], "t string").select(T.skeleton(F.col("t"))).first()[0] == want


def test_phonetic_codes():
    assert nysiis("industries") == nysiis("imdastris") == "INDASTR"
    assert nysiis("42") == "42" and nysiis("") == ""


def test_golden_scores():
    assert round(S.ratio("industries", "imdastris"), 6) == 0.736842
    assert S.levenshtein_similarity("industries", "imdastris") == pytest.approx(0.7)
    assert S.token_set_ratio("apex media", "media apex ltd") == 1.0
    assert S.token_set_ratio("", "a") == 0.0
    assert S.partial_ratio("tools", "acme tools inc") == 1.0
    assert round(S.jaro_winkler("martha", "marhta"), 6) == 0.961111


@settings(max_examples=150, deadline=None)
@given(WORDS, WORDS)
def test_score_properties(a, b):
    for name, f in S.SCORERS.items():
        assert 0 <= f(a, b) <= 1, name
        assert f(a, b) == pytest.approx(f(b, a)) or name in ("jaro_winkler",)
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert S.common_subsequence(a, b) == table[-1][-1]
    shuffled = " ".join(reversed(a.split()))
    assert S.token_sort_ratio(a, b) == S.token_sort_ratio(shuffled, b)


def test_scores_column(spark):
    df = spark.createDataFrame([("ab cd", "cd ab"), ("x", "x"), (None, "x"), ("", "")], "a string, b string")
    s = S.scores({"r": ("ratio", F.col("a"), F.col("b")), "t": ("token_sort_ratio", F.col("a"), F.col("b"))})
    got = [tuple(r[0]) if r[0] else None for r in df.select(s.alias("s")).collect()]
    assert got == [(0.4, 1.0), (1.0, 1.0), (None, None), (1.0, 1.0)]


def test_join_initials(spark):
    rows = ["l l c", "s a r l x", "a bc d", "acme l l c", "a | b"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(T.join_initials(F.col("t"))).collect()]
    assert got == ["llc", "sarlx", "a bc d", "acme llc", "a | b"]


def test_fold_of_ids(spark):
    rows = [f"S1-{i:05d}" for i in range(50)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(T.crc_fold(F.col("t"))).collect()]
    assert got == [zlib.crc32(x.encode()) % 10 for x in rows]
    assert got[1] == 4


def test_names(spark):
    rows = ["Apex Media Private Limited", "The Company Inc", "M/s. L L C Traders f/k/a Old Name Ltd", "www.acme-tools.com", "", None, "Café & Co"]
    out = normalize_names(spark.createDataFrame([(x,) for x in rows], "n string"), "n").collect()
    assert [r.n_core for r in out[:4]] == ["apex media", "the co inc", "traders old name", "acme tools"]
    assert (out[2].n_alt_a, out[2].n_alt_b, out[2].n_alias) == ("traders", "old name", True)
    assert out[3].n_domain and not out[0].n_domain
    assert out[4].n_full == out[5].n_full == "" and not out[5].n_alias
    assert out[6].n_full == "cafe and co"


def test_addresses(spark):
    rows = [("304, 3rd Floor, MG Road, Bangalore, KA", "India"), ("12 W Main St Apt 4B, Springfield, New York", "US"), ("N/A", "US"), ("<blank>", "US"), (None, None), ("near SBI, 5 rue de Lyon", "France"), ("007 Elm St, 007", "")]
    out = normalize_addresses(spark.createDataFrame(rows, "a string, c string"), "a", "c").collect()
    assert (out[0].a_state, out[0].a_nums) == ("karnataka", "304 3")
    assert (out[1].a_state, out[1].a_full) == ("ny", "12 west main street 4 b springfield ny")
    assert out[2].a_empty and out[4].a_empty and out[2].a_ncomp == 0
    assert out[5].a_full.startswith("near") and not out[5].a_core.startswith("near")
    assert (out[6].a_nums, out[6].a_first_num) == ("7", "7")


def test_retrieval_tokens(spark):
    got = spark.createDataFrame([("Acme-X", "1 Rd")], "n string, a string").select(T.retrieval_tokens(F.col("n"), F.col("a"))).first()[0]
    assert got == ["n:acme", "n:x", "a:1", "a:rd", "g:acme", "g:cmex"]


def test_tags(spark):
    df = spark.createDataFrame([("12 Oak Road, Reno", "Oak Rd, RENO 12"), ("1 A St", ""), ("5 Elm St", "6 ELM ST")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = [set(r[0]) for r in df.select(address_tags(a, b, a, b)).collect()]
    assert "street_type_abbreviated" in got[0] and got[1] == {"address_EMPTY"}
    assert {"address_UPPERCASED", "number_fully_changed"} <= got[2]
    names = spark.createDataFrame([("Acme Tools", "Zed Works")], "a string, b string").select(name_tags(a, b, a, b)).first()[0]
    assert {"name_zero_token_overlap", "name_RANDOM_replacement"} <= set(names)


def test_letters_of_other_alphabets():
    vectors = {"Москва": "moskva", "Щука й": "shchuka y", "Αθήνα": "athena", "Ψυχή": "psuche", "שלום": "shlvm", "سلام": "slam", "すし": "susi", "サクラ": "sakura", "서울": "seoul", "თბილისი": "tbilisi", "กา": "kaa", "北京": "  ", "①": "1", "☃": " "}
    for text, want in vectors.items():
        assert T.fold_text(text) == want, text


def test_skeleton_of_a_very_long_token(spark):
    from kinweave.functions import text

    long = "b" + "aeiou" * 600 + "ktr"
    got = spark.createDataFrame([(long,), ("",), (None,)], "t string").select(text.skeleton(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == ["bktr", "", None]


def test_skeletons_of_words_are_those_of_the_expression(spark):
    said = ["phone which shahh photograph bhaag wizard quay hhh aeiou mississippi queueing thththe", "tree", "", None, "zhhz xxq oooo"]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    want = F.array_join(F.transform(T.tokens(F.col("s")), T.skeleton), " ").alias("want")
    code = lambda least: spoken(F.lit("knight ab"), F.col("s"), least)
    got = df.select(want, code(500)["skel"].alias("all"), code(7)["skel"].alias("few"), code(7)["phon"].alias("phon")).collect()
    assert [r["all"] for r in got] == [r.want for r in got]
    assert [r.few and r.few[:7] for r in got] == [r.want and r.want[:7] for r in got] and len(got[0].few) < len(got[0].want)
    assert {r.phon for r in got} == {f"{nysiis('knight')} {nysiis('ab')}"}
