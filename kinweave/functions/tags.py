"""Tags for how one name or address was changed into another. Marks are stripped once, the rest is JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .names import literal_map, mapped
from .text import alnum_tokens, capped_levenshtein, jaccard, trigrams


def _tags(found: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in found.items()]))


def _subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def name_tags(raw1: Column, raw2: Column, plain1: Column, plain2: Column) -> Column:
    """Tags of name 2 against name 1; ``plain`` are the texts without combining marks."""
    t1, t2 = alnum_tokens(plain1), alnum_tokens(plain2)
    s1, s2 = F.array_distinct(t1), F.array_distinct(t2)
    legal = lambda t: t.isin(*sorted(V.TAG_LEGAL))
    c1, c2 = F.filter(s1, lambda t: ~legal(t)), F.filter(s2, lambda t: ~legal(t))
    l1, l2 = F.filter(s1, legal), F.filter(s2, legal)
    both = (F.size(s1) > 0) & (F.size(s2) > 0)
    same = lambda a, b: _subset(a, b) & _subset(b, a)
    apart = both & (F.size(F.array_intersect(s1, s2)) == 0)
    form = both & same(c1, c2) & ~same(s1, s2)
    added = F.array_except(s2, s1)
    o1, o2 = F.array_sort(t1), F.array_sort(t2)
    differ = F.filter(F.zip_with(o1, o2, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["a"] != p["b"])
    change = F.get(differ, F.lit(0))
    distance = capped_levenshtein(change["a"], change["b"])
    marked = lambda raw, plain: raw != plain
    return _tags({
        "non_latin_name": ~F.lower(plain2).rlike("[a-z]"),
        "diacritic_injected": marked(raw2, plain2) & ~marked(raw1, plain1),
        "domain_or_handle_name": F.lower(F.trim(raw2)).rlike(r"\.(com|net|in|co\.in|fr)\b|^www|^#"),
        "bracket_or_junk_noise": raw2.rlike(r"[\[\]{}<>|]|^\s*(--|\.\.\.)"),
        "name_zero_token_overlap": apart,
        "name_RANDOM_replacement": apart & (jaccard(trigrams(plain1), trigrams(plain2)) < 0.20),
        "legal_suffix_dropped": form & ~_subset(l1, l2),
        "legal_suffix_added": form & ~_subset(l2, l1),
        "token_appended": both & (F.size(added) > 0) & _subset(s1, s2),
        "token_appended_descriptor": both & _subset(s1, s2) & F.exists(added, lambda t: t.isin(*sorted(V.TAG_ADDED))),
        "word_transposition": both & (o1 == o2) & (t1 != t2),
        "name_truncated": both & _subset(s2, s1) & ~_subset(s1, s2),
        "typo_in_name": both & (F.size(t1) == F.size(t2)) & ~same(s1, s2) & (F.size(differ) == 1) & distance.between(1, 2),
    })


def address_tags(raw1: Column, raw2: Column, plain1: Column, plain2: Column) -> Column:
    digits = lambda t: t.rlike("^[0-9]+$")
    t1, t2 = alnum_tokens(plain1), alnum_tokens(plain2)
    n1, n2, w1, w2 = F.filter(t1, digits), F.filter(t2, digits), F.filter(t1, lambda t: ~digits(t)), F.filter(t2, lambda t: ~digits(t))
    same = lambda a, b: _subset(a, b) & _subset(b, a)
    streets = literal_map(V.TAG_STREET)
    short = lambda w: F.exists(w, lambda t: F.try_element_at(streets, t).isNotNull())
    in_order = F.filter(w1, lambda t: F.array_contains(w2, t))
    in_order2 = F.filter(w2, lambda t: F.array_contains(w1, t))
    reordered = (F.array_sort(w1) == F.array_sort(w2)) & (w1 != w2)
    drifted = (F.size(F.array_intersect(w1, w2)) > 0) & (in_order != in_order2) & (F.array_sort(w1) != F.array_sort(w2))
    numbers = (F.size(n1) > 0) & (F.size(n2) > 0) & ~same(n1, n2)
    common = F.size(F.array_intersect(n1, n2)) > 0
    letters = F.regexp_replace(raw2, r"\P{L}", "")
    found = {
        "null_literal_token": F.contains(raw2, F.lit("<NULL>")),
        "address_UPPERCASED": (letters != "") & ~letters.rlike(r"[^\p{Lu}]"),
        "addr_diacritic_injected": (raw2 != plain2) & (raw1 == plain1),
        "hash_or_pobox_prefix": raw2.rlike(r"(?i)(^|[,\s])#|\bPO BOX\b|\bP\.O\b"),
        "street_type_abbreviated": ~same(w1, w2) & (F.size(F.array_intersect(mapped(w1, streets), mapped(w2, streets))) > 0) & (short(w1) | short(w2)),
        "component_reordered": reordered,
        "component_reordered_partial": drifted,
        "number_perturbed": numbers & common,
        "number_fully_changed": numbers & ~common,
        "number_dropped": (F.size(n1) > 0) & (F.size(n2) == 0),
        "address_component_dropped": _subset(w2, w1) & ~_subset(w1, w2),
    }
    return F.when(F.trim(raw2) == "", F.array(F.lit("address_EMPTY"))).otherwise(_tags(found))
