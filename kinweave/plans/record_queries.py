"""Registered queries over records, lines and texts made from whole tables, and over decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, text
from ..functions.addresses import normalize_addresses
from ..functions.tags import name_tags
from ..operators import blocking as B
from ..operators import decide as D
from ..operators import diagnostics as E
from ..operators import features as X
from ..sources import tsv
from . import pipeline as P
from . import views as S
from .registry import crc_sql, query, r6

# --- business records: every part is a firm, every customer has an address and a country -----------

_FORMS = ["", " Inc", " LLC", " Private Limited", " Services", " Corp.", " Ltd", " Company"]
_FIRMS = f"firm AS (SELECT p_partkey AS id, 'The ' || p_name || ([{', '.join(f"'{x}'" for x in _FORMS)}])[p_partkey % {len(_FORMS)} + 1] AS name FROM part)"


def _firms(spark, d):
    form = F.element_at(F.array(*map(F.lit, _FORMS)), (F.col("p_partkey") % len(_FORMS) + 1).cast("int"))
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("The "), "p_name", form).alias("name"))


_CANON = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in names.V.NAME_WORDS.items()) + "}"
_LEGAL = ", ".join(f"'{w}'" for w in sorted(names.V.LEGAL_WORDS))


@query(f"""WITH {_FIRMS}, w AS (SELECT id, list_transform(list_filter(string_split(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''), lambda x: coalesce({_CANON}[x], x)) AS t FROM firm)
SELECT id, array_to_string(t, ' ') AS n_full, array_to_string(CASE WHEN len(list_filter(t, lambda x: x NOT IN ({_LEGAL}))) > 0 THEN list_filter(t, lambda x: x NOT IN ({_LEGAL})) ELSE t END, ' ') AS n_core FROM w""")
def norm_name_core(spark, d):
    return names.normalize_names(_firms(spark, d), "name", phonetic=False, folded=True).select("id", "n_full", "n_core")


@query()
def norm_name(spark, d):
    """All name columns, of firms and of every document's first line."""
    line = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("name"))
    return names.normalize_names(_firms(spark, d).unionByName(line), "name").select("id", *names.COLUMNS)


@query()
def norm_addr(spark, d):
    from ..functions.addresses import COLUMNS

    nation = S.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.element_at(F.array(*map(F.lit, ["US", "India", "France"])), (F.col("n_nationkey") % 3 + 1).cast("int")).alias("country"))
    c = S.table(spark, d, "customer").join(nation, "c_nationkey")
    addr = F.concat(F.col("c_custkey").cast("string"), F.lit(" "), F.initcap("c_mktsegment"), F.lit(" Road, "), F.floor("c_acctbal").cast("string"), F.lit(" Oak Ave"))
    return normalize_addresses(c.select(F.col("c_custkey").alias("id"), addr.alias("addr"), "country"), "addr", "country").select("id", *COLUMNS)


_LANDS = """s1 AS (SELECT c_custkey AS id, lower(trim(coalesce(CASE WHEN c_custkey % 19 = 0 THEN '' WHEN c_nationkey < 20 THEN ' Nation ' || c_nationkey END, ''))) AS ckey FROM customer),
ix AS (SELECT s_suppkey AS id, lower(trim(CASE WHEN s_suppkey % 5 = 0 THEN ' ' ELSE 'NATION ' || s_nationkey END)) AS ckey FROM supplier)"""


@query(f"""WITH {_LANDS}, q AS (SELECT DISTINCT ckey FROM s1)
SELECT id, ckey FROM ix JOIN q USING (ckey) UNION ALL SELECT ix.id, q.ckey FROM ix CROSS JOIN q WHERE ix.ckey = '' AND q.ckey <> ''""")
def blank_country_partition(spark, d):
    key = F.col("c_custkey")
    q = S.table(spark, d, "customer").select(key.alias("id"), text.country_key(F.when(key % 19 == 0, "").when(F.col("c_nationkey") < 20, F.concat(F.lit(" Nation "), F.col("c_nationkey").cast("string")))).alias("ckey"))
    i = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), text.country_key(F.when(F.col("s_suppkey") % 5 == 0, " ").otherwise(F.concat(F.lit("NATION "), F.col("s_nationkey").cast("string")))).alias("ckey"))
    return B.country_or_blank(q, i)


@query("""SELECT c_custkey::VARCHAR AS entity_id, 2 AS src FROM customer WHERE c_custkey % 3 > 0
UNION ALL SELECT s_suppkey::VARCHAR, 3 FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey % 3 > 0 AND c_custkey = s_suppkey)""")
def src_union_antidup(spark, d):
    two = S.table(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").cast("string").alias("entity_id"))
    return tsv.index_union(two, S.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("entity_id")))


# --- lines: every customer is a line, some of them broken ----------------------------------------


def _record_lines(spark, d):
    """Customers as lines: a tab inside the address, short lines, blank ids, ids that come again, spaces to trim."""
    k, c = F.col("c_custkey"), S.table(spark, d, "customer")
    ident = F.when(k % 11 == 0, " ").when(k % 7 == 0, F.concat(F.lit("S1-"), (k - 1).cast("string"))).otherwise(F.concat(F.lit(" S1-"), k.cast("string")))
    address = F.when(k % 5 == 0, F.concat(F.lit("1 \"Rd\tx\ty "), "c_mktsegment")).otherwise(F.col("c_mktsegment"))
    line = F.when(k % 13 == 0, F.concat_ws("\t", ident, "c_name")).otherwise(F.concat_ws("\t", ident, "c_name", address, F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit(" "))))
    head = spark.createDataFrame([(0, "entity_id\tbusiness_name\tbusiness_address\tcountry")], "row_no long, value string")
    return head.unionByName(c.select((k + 1).alias("row_no"), line.alias("value")))


_LINES = """l AS (SELECT c_custkey + 1 AS row_no, CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN 'S1-' || (c_custkey - 1) ELSE 'S1-' || c_custkey END AS entity_id, c_name AS business_name,
CASE WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN '1 "Rd x y ' || c_mktsegment ELSE c_mktsegment END AS business_address, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE 'N' || c_nationkey END AS country, c_custkey AS k FROM customer)"""


@query(f"WITH {_LINES} SELECT entity_id, arg_min(business_name, row_no) AS business_name, arg_min(business_address, row_no) AS business_address, arg_min(country, row_no) AS country FROM l WHERE entity_id <> '' GROUP BY entity_id")
def tsv_repair(spark, d):
    return tsv.parse_records(_record_lines(spark, d)).drop("row_no")


@query(f"WITH {_LINES} SELECT CASE WHEN k % 11 = 0 THEN ' ' WHEN k % 7 = 0 THEN entity_id ELSE ' ' || entity_id END AS entity_id, CASE WHEN k % 5 = 0 THEN 'x' ELSE country || ' ' END AS country FROM l WHERE k % 13 <> 0")
def countries_of_lines(spark, d):
    return tsv.parse_countries(_record_lines(spark, d))


@query(f"WITH {_LINES} SELECT DISTINCT CASE WHEN k % 11 = 0 THEN ' ' WHEN k % 7 = 0 THEN entity_id ELSE ' ' || entity_id END AS id FROM l UNION SELECT 'entity_id'")
def ids_of_lines(spark, d):
    return tsv.parse_ids(_record_lines(spark, d))


def _truth_lines(spark, d):
    """A line for each customer with its orders, with spaces and empty places; every ninth customer comes a second time with one order only."""
    o = S.table(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.concat(F.lit("S2-"), F.col("o_orderkey").cast("string")).alias("id"))
    whole = o.groupBy("c").agg(F.concat(F.array_join(F.array_sort(F.collect_list("id")), ", "), F.lit(",,")).alias("ids")).select((F.col("c") + 1).alias("row_no"), "c", "ids")
    again = o.where("c % 9 = 0").groupBy("c").agg(F.min("id").alias("ids")).select((F.col("c") + 10_000_000).alias("row_no"), "c", "ids")
    rows = whole.unionByName(again).select("row_no", F.concat(F.lit("S1-"), F.col("c").cast("string"), F.lit("\t"), "ids").alias("value"))
    return spark.createDataFrame([(0, tsv.GROUND_TRUTH_HEADER)], "row_no long, value string").unionByName(rows)


_TRUTH_LINES = """tl AS (SELECT 'S1-' || o_custkey AS q_id, 'S2-' || o_orderkey AS i_id, o_custkey AS c, min('S2-' || o_orderkey) OVER (PARTITION BY o_custkey) AS least FROM orders)"""


@query(f"WITH {_TRUTH_LINES} SELECT q_id, i_id FROM tl WHERE c % 9 <> 0 OR i_id = least")
def gt_explode(spark, d):
    return tsv.explode_truth(tsv.parse_id_map(_truth_lines(spark, d)))


@query(f"WITH {_TRUTH_LINES} SELECT q_id AS s1_id, CASE WHEN c % 9 = 0 THEN min(i_id) ELSE string_agg(i_id, ',' ORDER BY i_id) END AS ids FROM tl GROUP BY q_id, c")
def id_map_last(spark, d):
    return tsv.parse_id_map(_truth_lines(spark, d)).select("s1_id", F.array_join("ids", ",").alias("ids"))


@query(f"WITH {_TRUTH_LINES}, t AS (SELECT q_id, i_id FROM tl WHERE c % 9 <> 0 OR i_id = least) SELECT q_id, i_id, regexp_extract(q_id, '[0-9]+$')::BIGINT % 4 > 0 AND regexp_extract(i_id, '[0-9]+$')::BIGINT % 5 > 0 AS known FROM t")
def truth_resolved(spark, d):
    t = tsv.explode_truth(tsv.parse_id_map(_truth_lines(spark, d)))
    q = S.table(spark, d, "customer").where("c_custkey % 4 > 0").select(F.concat(F.lit("S1-"), F.col("c_custkey").cast("string")).alias("q_id"))
    i = S.table(spark, d, "orders").where("o_orderkey % 5 > 0").select(F.concat(F.lit("S2-"), F.col("o_orderkey").cast("string")).alias("i_id"))
    known, unknown = tsv.resolve_truth(t, q, i)
    return known.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))


# --- texts ---------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(t, '\\p{L}'), lambda c: unicode(c) > 591)) > 0 AS native, regexp_matches(t, '[^\\x00-\\x7F]') AND NOT regexp_matches(t, '[A-Za-z]') AS non_latin, NOT regexp_matches(lower(t), '[a-z]') AS no_latin,
len(regexp_extract_all(t, '[\\p{L}\\p{N}]+')) AS words, len(t) AS chars FROM t""")
def text_flags(spark, d):
    c = F.coalesce(F.col("text"), F.lit(""))
    return S.table(spark, d, "documents").select("doc_id", text.has_native(c).alias("native"), text.is_non_latin(c).alias("non_latin"), text.no_latin_letter(c).alias("no_latin"), F.size(text.unicode_tokens(c)).cast("long").alias("words"), F.length(c).cast("long").alias("chars"))


_PAIRS_OF_PARTS = "n AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 2) AS tail FROM part), nn AS (SELECT a.p_name AS a, b.p_name AS b FROM n a JOIN n b ON a.tail = b.tail AND a.p_name < b.p_name)"


def _pairs_of_parts(spark, d):
    n = S.table(spark, d, "part").select("p_name", F.split("p_name", " ")[1].alias("tail")).distinct()
    return n.withColumnRenamed("p_name", "a").join(n.withColumnRenamed("p_name", "b"), "tail").where("a < b")


_GRAMS = "(CASE WHEN length({0}) >= 3 THEN list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3))) ELSE [{0}] END)"


@query(f"""WITH {_PAIRS_OF_PARTS}, g AS (SELECT a, b, replace(a, ' ', '') AS x, replace(b, ' ', '') AS y FROM nn), t AS (SELECT *, {_GRAMS.format('x')} AS gx, {_GRAMS.format('y')} AS gy FROM g)
SELECT a, b, CASE WHEN abs(length(a) - length(b)) > 3 THEN 4 ELSE levenshtein(a, b) END AS capped, round(len(list_intersect(gx, gy)) / len(list_distinct(list_concat(gx, gy))), 6) AS trigrams, len(gx) AS n FROM t""")
def edit_measures(spark, d):
    """Levenshtein distance with a cap, and Jaccard similarity of trigrams."""
    a, b = F.col("a"), F.col("b")
    x, y = text.trigrams(a), text.trigrams(b)
    return _pairs_of_parts(spark, d).select("a", "b", text.capped_levenshtein(a, b).cast("long").alias("capped"), F.round(text.jaccard(x, y), 6).alias("trigrams"), F.size(x).cast("long").alias("n"))


@query(f"SELECT DISTINCT p_type || ' / ' || p_brand AS name, substr(regexp_replace(p_type || ' / ' || p_brand, '[^A-Za-z0-9]+', '_', 'g'), 1, 40) || '_' || lpad(printf('%x', {crc_sql("p_type || ' / ' || p_brand")}), 8, '0') AS safe FROM part")
def safe_names(spark, d):
    c = F.concat("p_type", F.lit(" / "), "p_brand")
    return S.table(spark, d, "part").select(c.alias("name"), text.safe_name(c).alias("safe")).distinct()


@query(f"WITH {S.REC}, t AS (SELECT rec_id, ckey, array_to_string(name, ' ') AS n, array_to_string(addr, ' ') AS a FROM rec) SELECT rec_id, md5('query: ' || n || ' | ' || a) AS encoder, 'name: ' || substr(n, 1, 100) || ' address: ' || substr(a, 1, 100) || ' country: ' || substr(ckey, 1, 100) AS reranker, substr(a, 1, 200) AS scorer FROM t")
def model_texts(spark, d):
    """Texts for encoders (by digest), rerankers and scorers."""
    n, a, c = F.col("n_core"), F.col("a_full"), F.col("ckey")
    return S.records(spark, d).select("rec_id", F.md5(text.encoder_text(n, a)).alias("encoder"), text.reranker_text(n, a, c).alias("reranker"), text.scorer_text(a).alias("scorer"))


@query(f"WITH {S.REC}, t AS (SELECT rec_id, list_filter(addr, lambda x: regexp_full_match(x, '[0-9]{{1,18}}')) AS nums FROM rec) SELECT rec_id, CASE WHEN len(nums) > 0 THEN nums[1]::BIGINT ELSE -1 END AS house FROM t")
def house_numbers(spark, d):
    return S.records(spark, d).select("rec_id", text.first_number(F.col("a_nums")).alias("house"))


@query("""WITH x AS (SELECT p_partkey % 5 AS rule, p_name, split_part(p_name, ' ', 1) AS h, split_part(p_name, ' ', 2) AS t FROM part), n AS (SELECT rule, count(*) AS n FROM x WHERE h <> t GROUP BY rule)
SELECT tag, CAST(sum(n) AS BIGINT) AS n FROM n JOIN (VALUES (0, 'legal_suffix_dropped'), (0, 'name_truncated'), (1, 'token_appended'), (1, 'token_appended_descriptor'), (2, 'typo_in_name'), (3, 'word_transposition'), (4, 'name_truncated')) v(rule, tag) USING (rule) GROUP BY tag""")
def tag_rates(spark, d):
    """Every part's name against itself changed by one of five rules."""
    x = S.table(spark, d, "part").select((F.col("p_partkey") % 5).alias("rule"), "p_name", F.split("p_name", " ")[0].alias("h"), F.split("p_name", " ")[1].alias("t")).where("h <> t")
    rule, p = F.col("rule"), F.col("p_name")
    first = F.when(rule == 0, F.concat(p, F.lit(" Inc"))).when(rule == 4, F.concat("h", F.lit(" qqzz "), "t")).otherwise(p)
    second = F.when(rule == 1, F.concat(p, F.lit(" Group"))).when(rule == 2, F.concat("h", F.lit(" "), "t", F.lit("x"))).when(rule == 3, F.concat("t", F.lit(" "), "h")).otherwise(p)
    x = x.select(first.alias("a"), second.alias("b"))
    a, b = F.col("a"), F.col("b")
    return x.select(F.explode(name_tags(a, b, a, b)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


# --- features and decisions ----------------------------------------------------------------------

_COUNTED = ["n_jacc", "n_first_eq", "n_len_q", "n_len_i", "n_ntok_diff", "a_num_jacc", "a_num_conflict", "a_first_num_eq", "a_qnum_in_i", "a_len_i", "a_ncomp_i", "a_empty_i", "b_ntypes", "bit_nt", "bit_np", "bit_nc", "src_s3", "q_name_df_s1", "i_name_df_idx", "i_name_df_s1"]


@query(f"""WITH {S.PAIRS}, f AS (SELECT rec_id, src, list_distinct(name) AS nd, name, addr, len(name) AS nt, array_to_string(name, ' ') AS n, length(array_to_string(addr, ' ')) AS la, len(addr) AS nc, list_filter(addr, lambda x: regexp_full_match(x, '[0-9]+')) AS nums,
  count(*) FILTER (WHERE side = 'q') OVER w AS dq, count(*) FILTER (WHERE side = 'i') OVER w AS di FROM rec WINDOW w AS (PARTITION BY ckey, array_to_string(name, ' '))),
x AS (SELECT p.q_id, p.i_id, p.bits, a.nd AS qd, b.nd AS idd, a.name AS qn, b.name AS inn, a.n AS qs, b.n AS iss, a.nums AS qa, b.nums AS ia, b.la, b.nc, b.src, a.dq AS qdq, b.dq AS idq, b.di AS idi,
  len(list_distinct(list_intersect(a.nums, b.nums))) AS shared, len(list_distinct(list_concat(a.nums, b.nums))) AS uni, len(a.nums) > 0 AND len(b.nums) > 0 AS nn FROM pr p JOIN f a ON a.rec_id = p.q_id JOIN f b ON b.rec_id = p.i_id)
SELECT q_id, i_id, round(CASE WHEN len(list_distinct(list_concat(qd, idd))) > 0 THEN len(list_intersect(qd, idd)) / len(list_distinct(list_concat(qd, idd))) END, 6) AS n_jacc, (coalesce(qn[1], '') = coalesce(inn[1], ''))::INT::DOUBLE AS n_first_eq, length(qs)::DOUBLE AS n_len_q, length(iss)::DOUBLE AS n_len_i, abs(len(qn) - len(inn))::DOUBLE AS n_ntok_diff,
round(CASE WHEN nn THEN shared / uni END, 6) AS a_num_jacc, CASE WHEN nn THEN (shared = 0)::INT::DOUBLE END AS a_num_conflict, CASE WHEN nn THEN (qa[1] = ia[1])::INT::DOUBLE END AS a_first_num_eq, CASE WHEN nn THEN list_contains(ia, qa[1])::INT::DOUBLE END AS a_qnum_in_i,
la::DOUBLE AS a_len_i, nc::DOUBLE AS a_ncomp_i, (nc = 0)::INT::DOUBLE AS a_empty_i, bit_count(bits)::DOUBLE AS b_ntypes, ((bits >> {B.NT}) & 1)::DOUBLE AS bit_nt, ((bits >> {B.NP}) & 1)::DOUBLE AS bit_np, ((bits >> {B.NC}) & 1)::DOUBLE AS bit_nc, (src = 3)::INT::DOUBLE AS src_s3, qdq::DOUBLE AS q_name_df_s1, idi::DOUBLE AS i_name_df_idx, idq::DOUBLE AS i_name_df_s1 FROM x""")
def counted_features(spark, d):
    recs = S.records(spark, d).withColumns({"n_translit": F.lit(False), "n_domain": F.lit(False), "n_alias": F.lit(False), "a_translit": F.lit(False), "a_empty": F.col("a_full") == "", "a_ncomp": F.size("addr"), "a_state": F.lit(""), "a_first_num": F.substring_index("a_nums", " ", 1)})
    pairs = S.scored(recs).withColumn("dcos", F.lit(None).cast("double"))
    made = X.counted_features()
    return X.both_sides(pairs, recs.drop("name", "addr", "h")).select("q_id", "i_id", *[F.round(made[c], 6).alias(c) for c in _COUNTED])


@query(f"WITH {S.PAIRS} SELECT q_id, i_id, p FROM (SELECT * FROM one WHERE p >= 0.02 ORDER BY p DESC, q_id, i_id LIMIT 150)")
def rerank_shortlist(spark, d):
    return P.shortlist(S.scored(S.records(spark, d)), 0.02, 150).select("q_id", "i_id", "p")  # the limit is the operator


@query(f"WITH {S.PAIRS} SELECT q_id, i_id, round(CASE WHEN (q_id + i_id) % 3 = 0 THEN p ELSE 0.6 * p + 0.4 * ((q_id * 7 + i_id) % 11) / 10 END, 6) AS p FROM pr")
def rerank_blend(spark, d):
    x = S.scored(S.records(spark, d))
    other = F.when((F.col("q_id") + F.col("i_id")) % 3 != 0, (F.col("q_id") * 7 + F.col("i_id")) % 11 / 10)
    return x.select("q_id", "i_id", F.round(P.blend(F.col("p"), other, 0.4), 6).alias("p"))


_TAUS = f"""taus AS (SELECT tau FROM (VALUES {", ".join(f"({t!r}::DOUBLE)" for t in E.BOUND_TAUS)}) t(tau)), g AS (SELECT q_id, count(*) AS G FROM truth GROUP BY q_id),
per AS (SELECT tau, o.q_id, count(*) AS P, count(t.q_id) AS TP FROM one o JOIN taus ON p >= tau LEFT JOIN truth t ON t.q_id = o.q_id AND t.i_id = o.i_id GROUP BY ALL),
byt AS (SELECT tau, country, avg({S.f05_sql("coalesce(g.G, 0)", "coalesce(P, 0)", "coalesce(TP, 0)")}) AS f, count(*) AS n FROM ent e CROSS JOIN taus LEFT JOIN g USING (q_id) LEFT JOIN per USING (tau, q_id) GROUP BY ALL)"""


@query(f"WITH {S.PAIRS}, {_TAUS} SELECT country, n, arg_min(tau, (-round(f, 9), tau)) AS tau, round(max(f), 6) AS f05 FROM byt GROUP BY country, n")
def country_thresholds(spark, d):
    recs = S.records(spark, d)
    return E.country_thresholds(S.scored(recs), S.truth(recs), S.entities(recs)).select("country", "n", "tau", r6("f05"))


@query(f"""WITH {S.PAIRS}, {_TAUS}, chosen AS (SELECT q_id, i_id FROM one WHERE p >= 0.5), ct AS (SELECT c.q_id, count(*) AS P, count(t.q_id) AS TP FROM chosen c LEFT JOIN truth t ON t.q_id = c.q_id AND t.i_id = c.i_id GROUP BY c.q_id),
h AS (SELECT t.q_id, count(*) AS hit FROM truth t JOIN cand c ON c.q_id = t.q_id AND c.i_id = t.i_id GROUP BY t.q_id),
l AS (SELECT o.q_id, row_number() OVER r AS k, count(t.q_id) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp, coalesce(G, 0) AS G FROM one o LEFT JOIN truth t ON t.q_id = o.q_id AND t.i_id = o.i_id LEFT JOIN g ON g.q_id = o.q_id WINDOW r AS (PARTITION BY o.q_id ORDER BY o.p DESC, o.i_id)),
pf AS (SELECT q_id, max({S.f05_sql("G", "k", "tp")}) AS f FROM l GROUP BY q_id)
SELECT 'shipped' AS bound, round(avg({S.f05_sql("coalesce(G, 0)", "coalesce(P, 0)", "coalesce(TP, 0)")}), 6) AS f05 FROM ent LEFT JOIN g USING (q_id) LEFT JOIN ct USING (q_id)
UNION ALL SELECT 'best_threshold', round(max(f), 6) FROM (SELECT tau, sum(f * n) / sum(n) AS f FROM byt GROUP BY tau)
UNION ALL SELECT 'best_threshold_by_country', round(sum(f * n) / sum(n), 6) FROM (SELECT country, max(f) AS f, max(n) AS n FROM byt GROUP BY country)
UNION ALL SELECT 'best_prefix', round(avg(greatest(coalesce(f, 0), CASE WHEN coalesce(G, 0) = 0 THEN 1.0 ELSE 0.0 END)), 6) FROM ent LEFT JOIN g USING (q_id) LEFT JOIN pf USING (q_id)
UNION ALL SELECT 'best_subset', round(avg({S.f05_sql("coalesce(G, 0)", "coalesce(hit, 0)", "coalesce(hit, 0)")}), 6) FROM ent LEFT JOIN g USING (q_id) LEFT JOIN h USING (q_id)""")
def decision_bounds(spark, d):
    recs = S.records(spark, d)
    pairs = S.scored(recs)
    return E.decision_bounds(pairs, S.truth(recs), S.entities(recs), D.apply_decision(pairs, "threshold", 0.5)).select("bound", r6("f05"))


@query(f"""WITH {S.PAIRS}, n AS (SELECT ckey, count(*) FILTER (WHERE side = 'q') AS nq, count(*) FILTER (WHERE side = 'i') AS ni FROM rec GROUP BY ckey), np AS (SELECT ckey, count(*) AS np FROM cand GROUP BY ckey),
r AS (SELECT e.country AS ckey, avg((c.q_id IS NOT NULL)::INT) AS recall FROM truth t JOIN ent e USING (q_id) LEFT JOIN cand c ON c.q_id = t.q_id AND c.i_id = t.i_id GROUP BY e.country)
SELECT ckey, round(recall, 6) AS recall, round(1 - np / (nq * ni), 6) AS reduction, round(np / nq, 6) AS pairs_per_query FROM n LEFT JOIN r USING (ckey) LEFT JOIN np USING (ckey)""")
def blocking_report(spark, d):
    recs = S.records(spark, d)
    return P.blocking_report(recs, S.scored(recs), S.truth(recs)).select("ckey", r6("recall"), r6("reduction"), r6("pairs_per_query"))
