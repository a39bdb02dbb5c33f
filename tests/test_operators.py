import pytest
from pyspark.sql import functions as F

from kinweave.config import Config, enforce_contract
from kinweave.operators import blocking as B
from kinweave.operators import decide as D
from kinweave.operators import diagnostics as E
from kinweave.operators import validate as V
from kinweave.sources import tsv

PAIRS = "q_id long, i_id long, p double"


def chosen(spark, rows, **how):
    return sorted((r.q_id, r.i_id) for r in D.expected_f(spark.createDataFrame(rows, PAIRS), **how).collect())


def test_expected_f_vectors(spark):
    how = {"tau": 0.02, "gamma": 1.0, "miss": 0.0}
    assert chosen(spark, [(1, 1, 0.9), (1, 2, 0.6), (1, 3, 0.2)], **how) == [(1, 1)]
    assert chosen(spark, [(1, 1, 0.95), (1, 2, 0.9), (1, 3, 0.3)], **how) == [(1, 1), (1, 2)]
    assert chosen(spark, [(1, 1, 0.3)], tau=0.02, gamma=1.7, miss=0.0) == []
    assert chosen(spark, [(1, 1, 1.0), (2, 1, 0.0)], **how) == [(1, 1)]


def test_tune_agrees_with_the_windows(spark):
    rows = [(q, 10 * q + k, round((q * 7 + k * 13) % 19 / 20 + 0.01, 3)) for q in range(12) for k in range(q % 5)]
    pairs = spark.createDataFrame(rows, PAIRS)
    truth = spark.createDataFrame([(q, i) for q, i, p in rows if p > 0.6 or i % 7 == 0] + [(3, 999)], "q_id long, i_id long")
    ents = spark.createDataFrame([(q,) for q in range(14)], "q_id long")
    table = {(r.kind, r.tau, r.gamma, r.miss): r.f05 for r in D.tune(pairs, truth, ents, [0.3, 0.6], [(0.1, 1.0, 0.1), (0.02, 0.6, 0.0)]).collect()}
    for (kind, tau, gamma, miss), f in table.items():
        picked = D.apply_decision(pairs, kind, tau, gamma or 0.0, miss or 0.0)
        counts = D.entity_counts(ents, truth, picked)
        assert counts.agg(D.macro_f05(counts)).first()[0] == pytest.approx(f)


def test_f05_and_house_numbers(spark):
    df = spark.createDataFrame([(2, 3, 2), (0, 0, 0), (0, 1, 0), (2, 0, 0)], "g int, p int, t int")
    got = [r[0] for r in df.select(D.f05(F.col("g"), F.col("p"), F.col("t"))).collect()]
    assert [round(x, 6) for x in got] == [0.714286, 1.0, 0.0, 0.0]
    nums = spark.createDataFrame([(0.5, 12, 12), (0.5, 12, 15), (0.5, 12, 20), (0.5, -1, 12)], "p double, a int, b int")
    got = [round(r[0], 6) for r in nums.select(D.adjust_house_number(F.col("p"), F.col("a"), F.col("b"))).collect()]
    assert got == [0.55, 0.45, 0.5, 0.5]


def test_one_owner_and_thresholds(spark):
    pairs = spark.createDataFrame([(1, 5, 0.7), (2, 5, 0.7), (2, 6, 0.1)], PAIRS)
    assert sorted((r.q_id, r.i_id) for r in D.one_owner(pairs).collect()) == [(1, 5), (2, 6)]
    assert D.threshold(pairs, 0.7).count() == 2


def recs(spark, rows):
    cols = "ckey string, rec_id long, side string, n_core string, a_alpha string, a_nums string"
    return spark.createDataFrame(rows, cols).withColumn("n_concat", F.replace("n_core", F.lit(" "), F.lit("")))


def test_caps_on_keys(spark):
    rows = [("us", 0, "q", "acme tools", "oak", "1")] + [("us", i, "i", "acme tools", "oak", "1") for i in range(1, 6)]
    r = recs(spark, rows)
    all_of = B.key_candidates(r, Config(max_df_name=5, max_df_pair=5), (B.NC,))
    assert all_of.count() == 5 and {x.brank for x in all_of.collect()} == set(range(5))
    assert B.key_candidates(r, Config(max_df_name=4), (B.NC,)).count() == 0
    assert B.key_candidates(r, Config(max_pairs_per_key=4), (B.NC,)).count() == 0
    assert round(all_of.first().bscore, 6) == round(0.6931471805599453, 6)


def test_merge_keeps_every_list(spark):
    keys = spark.createDataFrame([("us", 1, 2, 3.0, 5, 0)], "ckey string, q_id long, i_id long, bscore double, bits int, brank int")
    extra = spark.createDataFrame([("us", 1, 2, 0.5), ("us", 1, 9, 0.4)], "ckey string, q_id long, i_id long, dcos double")
    got = {(r.q_id, r.i_id): (r.bscore, r.bits, r.brank, r.dcos) for r in B.merge_candidates(keys, [(extra, B.DENSE)], 40).collect()}
    assert got == {(1, 2): (3.0, 5 | 128, 0, 0.5), (1, 9): (0.0, 128, 90, 0.4)}


def test_contract():
    enforce_contract(Config(), Config(seed=1))
    with pytest.raises(ValueError, match="k_key"):
        enforce_contract(Config(), Config(k_key=3))
    assert Config.from_json(Config(k_key=7).to_json()) == Config(k_key=7)
    assert Config().key() != Config(k_key=7).key()


def test_records_file(spark, tmp_path):
    path = tmp_path / "s1.tsv"
    path.write_bytes("﻿Entity_ID\tbusiness_name\tbusiness_address\tcountry\r\nS1-1\tA \"b\" 'c'\tx\ty\tUS\r\n\r\nS1-2\tshort\r\n\tno\tid\tUS\r\nS1-1\tagain\tz\tUS\r\n".encode())
    got = [tuple(r)[1:] for r in tsv.read_records(spark, str(path)).orderBy("row_no").collect()]
    assert got == [("S1-1", "A \"b\" 'c'", "x y", "US"), ("S1-2", "short", "", "")]
    other = tmp_path / "o.tsv"
    other.write_text("country\tentity_id\nUS\tS1-9\n")
    assert [tuple(r)[1:] for r in tsv.read_records(spark, str(other)).collect()] == [("S1-9", "", "", "US")]
    bad = tmp_path / "b.tsv"
    bad.write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError, match="entity_id"):
        tsv.read_records(spark, str(bad))


def test_checks_of_list_files(spark):
    header = "source1_entity_id\tmatched_entity_ids"
    required = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "s1_id string")

    def rules(*rows, known=None):
        lines = spark.createDataFrame(list(enumerate(rows)), "row_no long, value string")
        return {r.rule for r in V.check_list_file(lines, header, required, known).collect()}

    clean = ("S1-1\tS2-1,S3-1", "S1-2\t", "S1-3\tS2-2")
    assert rules(header, *clean) == set()
    assert rules("source1_entity_id,matched_entity_ids", *clean) == {"header"}
    assert rules(header, "S1-1", *clean[1:]) == {"no_tab"}
    assert rules(header, *clean, clean[0]) == {"duplicate_row"}
    assert rules(header, "S1-1\tS2-1,S2-1", *clean[1:]) == {"duplicate_id"}
    assert rules(header, "S1-1\tS1-2", *clean[1:]) == {"self_match"}
    assert rules(header, "S1-1\tX-2", *clean[1:]) == {"bad_prefix"}
    assert rules(header, *clean[1:]) == {"missing_s1"}
    assert rules(header, *clean, "S1-9\t") == {"extra_s1"}
    known = spark.createDataFrame([("S2-1",), ("S3-1",)], "id string")
    assert rules(header, *clean, known=known) == {"unknown_id"}
    a = spark.createDataFrame([("S1-1", ["S2-1"]), ("S1-2", ["S2-9"])], "s1_id string, ids array<string>")
    assert [r.s1_id for r in V.check_subset(a, a.limit(1)).collect()] == ["S1-2"]


def test_written_lists_pass_the_checks(spark, tmp_path):
    ents = spark.createDataFrame([("S1-2", 1), ("S1-1", 0)], "q_id string, row_no long")
    pairs = spark.createDataFrame([("S1-1", "S2-1", 0.5), ("S1-1", "S3-1", 0.9), ("S1-1", "S3-1", 0.1), ("S1-1", "X", 1.0)], "q_id string, i_id string, p double")
    tsv.write_id_lists(V.id_lists(ents, pairs, "p"), str(tmp_path / "o"), "source1_entity_id\tmatched_entity_ids")
    text = "".join(f.read_text() for f in sorted((tmp_path / "o").glob("part-*")))
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-1\tS3-1,S2-1\nS1-2\t\n"
    back = tsv.read_id_map(spark, str(tmp_path / "o"))
    assert {r.s1_id: list(r.ids) for r in back.collect()} == {"S1-1": ["S3-1", "S2-1"], "S1-2": []}


def test_truth_against_itself_is_perfect(spark):
    truth = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "q_id long, i_id long")
    ents = spark.createDataFrame([(1, "us"), (2, "in"), (3, "us")], "q_id long, country string")
    got = {r.country: (r.n, r.f05, r.perfect) for r in E.score_rollup(D.entity_counts(ents, truth, truth)).collect()}
    assert got == {"ALL": (3, 1.0, 1.0), "us": (2, 1.0, 1.0), "in": (1, 1.0, 1.0)}


def test_subsample_keeps_clusters(spark):
    q = spark.createDataFrame([(i,) for i in range(60)], "q_id long")
    idx = spark.createDataFrame([(i,) for i in range(100, 300)], "i_id long")
    truth = spark.createDataFrame([(i, 100 + i) for i in range(60)] + [(i, 160 + i) for i in range(60)], "q_id long, i_id long")
    a, b, t = E.dev_subsample(q, idx, truth, 0.4)
    kept, ids = {r.q_id for r in a.collect()}, {r.i_id for r in b.collect()}
    assert 10 < len(kept) < 40
    assert {r.i_id for r in t.collect()} == {x for k in kept for x in (100 + k, 160 + k)} <= ids
    assert not any(100 + k in ids for k in set(range(60)) - kept)


@pytest.mark.parametrize("sorted_rows", [0, 100_000])
def test_top_rows_matches_sorting(spark, monkeypatch, sorted_rows):
    monkeypatch.setattr(E, "SORTED_ROWS", sorted_rows)
    rows = [(i, (i * 7919) % 101 / 7 if i % 13 else None, i % 5) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, s double, g int")
    order = sorted(rows, key=lambda r: (float("inf") if r[1] is None else -r[1], r[0]))
    for n in (0, 1, 17, 2500, 4999, 5000, 9000):
        got = sorted(r.id for r in E.top_rows(df, n, F.col("s"), ["id"]).collect())
        assert got == sorted(r[0] for r in order[:n])
    assert E.top_rows(df.limit(0), 3, F.col("s"), ["id"]).count() == 0


def test_hard_negatives_and_samples(spark):
    rows = [(q, i, float(q * i % 17), None, i, int(i % 4 == 0)) for q in range(30) for i in range(20)]
    df = spark.createDataFrame(rows, "q_id long, i_id long, bscore double, dcos double, brank int, y int")
    pos = {(r[0], r[1]) for r in rows if r[5]}
    got = {(r.q_id, r.i_id) for r in E.hard_negatives(df, 200).collect()}
    rest = sorted(((r[0], r[1]) for r in rows if not r[5]), key=lambda k: (-round(k[0] * k[1] % 17 - 0.01 * k[1], 9), *k))
    assert got == pos | set(rest[: 200 - len(pos)])
    few = {(r.q_id, r.i_id) for r in E.hard_negatives(df, 40).collect()}
    assert len(few) == 40 and few < pos and {q for q, _ in few} != set(range(10))
    heavy = df.withColumn("w", F.when(F.col("q_id") < 5, 100.0).otherwise(0.1))
    drawn = E.weighted_sample(heavy, "w", 80, ["q_id", "i_id"]).collect()
    assert len(drawn) == 80 and sum(r.q_id < 5 for r in drawn) > 60
    some = E.group_sample(df, "q_id", 130).groupBy("q_id").count().collect()
    assert len(some) == 7 and all(r["count"] == 20 for r in some)
    assert E.group_sample(df, "q_id", 600).count() == 600


def test_files_keep_their_order(spark, tmp_path):
    lists = spark.createDataFrame([(f"S1-{i}", str(i), (i * 37) % 101) for i in range(101)], "source1_entity_id string, ids string, row_no long")
    for files in (1, 3):
        tsv.write_id_lists(lists, f"{tmp_path}/{files}", "head\tids", files=files)
        lines = [x for f in sorted((tmp_path / str(files)).glob("part-*")) for x in f.read_text().splitlines()]
        assert lines == ["head\tids", *[f"S1-{r.source1_entity_id[3:]}\t{r.ids}" for r in lists.orderBy("row_no").collect()]]


def test_stages_follow_their_inputs(spark, tmp_path):
    from kinweave.sources.stages import drop_stage, fingerprint, stage

    cfg = Config()

    def made(data, force=False):
        df = spark.read.parquet(data)
        return stage(spark, f"{tmp_path}/work", cfg, "x", lambda: df, force, fingerprint(df)).count()

    spark.range(5).write.parquet(f"{tmp_path}/a")
    spark.range(9).write.parquet(f"{tmp_path}/b")
    assert (made(f"{tmp_path}/a"), made(f"{tmp_path}/b"), made(f"{tmp_path}/a")) == (5, 9, 5)
    spark.range(7).write.mode("overwrite").parquet(f"{tmp_path}/a")
    assert made(f"{tmp_path}/a") == made(f"{tmp_path}/a", force=True) == 7
    inputs = fingerprint(spark.read.parquet(f"{tmp_path}/a"))
    assert any(inputs in str(x) for x in (tmp_path / "work").iterdir())
    drop_stage(spark, f"{tmp_path}/work", cfg, "x", inputs)
    assert not list((tmp_path / "work").glob(f"*{inputs}/x"))
