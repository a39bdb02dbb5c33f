"""Normalised addresses: ten columns from one raw address and its country."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as V
from .names import literal_map
from .text import ascii_fold_all, has_native, skeleton, tokens

COLUMNS = ["a_full", "a_core", "a_alpha", "a_skel", "a_nums", "a_first_num", "a_state", "a_translit", "a_empty", "a_ncomp"]
# Spellings of the three countries with rules of their own.
COUNTRIES = {"US": ("us", "usa", "united states", "united states of america", "u s", "u s a"), "IN": ("india", "in", "bharat", "ind"), "FR": ("france", "fr", "fra", "republique francaise")}
_REGIONS = {"US": V.US_STATES, "IN": V.INDIA_STATES, "FR": V.FRANCE_REGIONS}
_STREETS = {"US": V.US_STREET, "IN": V.INDIA_STREET, "FR": V.FRANCE_STREET}
_TRIMMED = " .-/#"


def profile(country: Column) -> Column:
    c = F.lower(F.trim(F.coalesce(country, F.lit(""))))
    out = F.lit("GEN")
    for name, spellings in COUNTRIES.items():
        out = F.when(c.isin(*spellings), name).otherwise(out)
    return out


def by_profile(prof: Column, choices: dict[str, Column], other: Column) -> Column:
    out = other
    for name, c in choices.items():
        out = F.when(prof == name, c).otherwise(out)
    return out


def join_multiword(c: Column, table: dict[str, str]) -> Column:
    """Names of several words become their one-word form, longest names first."""
    for key in sorted((k for k in table if " " in k), key=len, reverse=True):
        c = F.regexp_replace(c, rf"\b{key}\b", table[key].replace(" ", ""))
    return c


def state_of(words: Column, prof: Column, native: Column) -> Column:
    joined, spaced = F.array_join(words, ""), F.array_join(words, " ")
    found = lambda table, key: F.try_element_at(literal_map(table), key)
    own = lambda values, key: F.when(key.isin(*sorted(set(values))), key)
    by_skeleton = F.when(native, F.try_element_at(skeleton_map(), skeleton(joined)))
    us = F.coalesce(own(V.US_STATES.values(), joined), found(V.US_STATES, spaced))
    india = F.coalesce(found(V.INDIA_CODES, joined), found(V.INDIA_STATES, spaced), own(V.INDIA_STATES.values(), joined), by_skeleton)
    return F.coalesce(by_profile(prof, {"US": us, "IN": india, "FR": own(V.FRANCE_REGIONS.values(), joined)}, F.lit(None).cast("string")), F.lit(""))


def skeleton_map() -> Column:
    """Skeletons of Indian states, built from the states by the expression that is used on texts."""
    pairs = F.array(*[F.struct(skeleton(F.lit(v)).alias("k"), F.lit(v).alias("v")) for v in sorted(set(V.INDIA_STATES.values()))])
    return F.map_from_entries(pairs)


def _component(raw: Column, folded: Column, prof: Column) -> Column:
    """What one comma-separated part gives: words, core words, numbers, state, and whether it counts."""
    native = has_native(raw)
    c = F.btrim(folded, F.lit(_TRIMMED))
    counts = ~c.isin(*sorted(V.NULL_WORDS))
    c = F.regexp_replace(c, r"\b(\d+)(?:st|nd|rd|th)\b", "$1")
    nums = F.regexp_extract_all(c, F.lit(r"\d+"), 0)
    c = F.regexp_replace(c, "&", " and ")
    c = F.regexp_replace(c, r"(?<=\d)(?=[a-z])|(?<=[a-z])(?=\d)", " ")
    c = F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))
    c = by_profile(prof, {k: join_multiword(c, t) for k, t in _REGIONS.items()}, c)
    words = tokens(c)
    cities = literal_map(V.INDIA_CITIES)
    words = F.when(prof == "IN", F.transform(words, lambda t: F.coalesce(F.try_element_at(cities, t), t))).otherwise(words)
    code = F.try_element_at(literal_map(V.US_STATES), F.try_element_at(words, F.lit(1)))
    words = F.when(prof.isin("US", "GEN") & (F.size(words) == 1) & code.isNotNull(), F.array(code)).otherwise(words)
    return F.struct(native.alias("native"), counts.alias("counts"), nums.alias("nums"), words.alias("words"))


def _street_words(words: Column, prof: Column) -> Column:
    streets = by_profile(prof, {k: literal_map(t) for k, t in _STREETS.items()}, literal_map(V.OTHER_STREET))
    full = F.transform(words, lambda t: F.coalesce(F.try_element_at(streets, t), t))
    common = F.filter(full, lambda t: (t != "") & ~t.isin(*sorted(V.UNIT_WORDS)))
    return F.when(prof == "FR", F.filter(full, lambda t: (t != "") & ~t.isin(*sorted(V.FRANCE_UNIT_WORDS)))).otherwise(common)


def normalize_addresses(df: DataFrame, address: str, country: str, folded: bool = False) -> DataFrame:
    """``df`` with COLUMNS. With ``folded`` the address is ASCII already and no Python runs for the folding."""
    raw = F.coalesce(F.col(f"`{address}`"), F.lit(""))
    df = df.withColumn("_raw", F.split(raw, ",", -1)).withColumn("_prof", profile(F.col(f"`{country}`")))
    df = df.withColumn("_low", F.transform("_raw", F.lower) if folded else ascii_fold_all("_raw"))
    prof = F.col("_prof")
    part = F.zip_with("_raw", "_low", lambda r, c: _component(r, c, prof))
    blank = F.lower(F.trim(raw)).isin(*sorted(V.NULL_WORDS))
    df = df.withColumn("_parts", F.filter(F.when(blank, F.filter(part, lambda p: F.lit(False))).otherwise(part), lambda p: p["counts"]))
    df = df.withColumn("_parts", F.transform("_parts", lambda p: F.struct(p["native"].alias("native"), p["nums"].alias("nums"), p["words"].alias("words"), state_of(p["words"], prof, p["native"]).alias("state"))))
    full = F.transform("_parts", lambda p: F.struct(F.when(p["state"] != "", F.array(p["state"])).otherwise(_street_words(p["words"], prof)).alias("words"), p["state"].alias("state")))
    df = df.withColumn("_full", full)
    landmark = lambda p: (p["state"] == "") & F.coalesce(F.try_element_at(p["words"], F.lit(1)).isin(*sorted(V.LANDMARK_WORDS)), F.lit(False))
    df = df.withColumn("_all", F.flatten(F.transform("_full", lambda p: p["words"])))
    df = df.withColumn("_core", F.flatten(F.transform(F.filter("_full", lambda p: ~landmark(p)), lambda p: p["words"])))
    states = F.filter(F.transform("_parts", lambda p: p["state"]), lambda s: s != "")
    df = df.withColumn("a_state", F.coalesce(F.try_element_at(states, F.lit(1)), F.lit("")))
    nums = F.transform(F.filter(F.flatten(F.transform("_parts", lambda p: p["nums"])), lambda n: F.length(n) <= 12), lambda n: n.try_cast("long").cast("string"))
    found = F.size(F.flatten(F.transform("_parts", lambda p: p["nums"])))
    df = df.withColumn("a_empty", (F.size("_all") == 0) & (found == 0))
    df = df.withColumn("_nums", F.slice(F.array_distinct(nums), 1, 6))
    alpha = F.filter("_all", lambda t: (F.length(t) >= 3) & t.rlike("^[a-z]+$") & ~t.isin(*sorted(V.ADDRESS_STOP_WORDS)) & (t != F.col("a_state")))
    df = df.withColumn("_alpha", F.array_distinct(alpha))
    df = df.withColumn("a_full", F.array_join("_all", " ")).withColumn("a_core", F.array_join("_core", " ")).withColumn("a_alpha", F.array_join("_alpha", " "))
    df = df.withColumn("a_skel", F.array_join(F.transform("_alpha", skeleton), " ")).withColumn("a_nums", F.array_join("_nums", " "))
    df = df.withColumn("a_first_num", F.coalesce(F.try_element_at("_nums", F.lit(1)), F.lit("")))
    df = df.withColumn("a_translit", F.when(F.col("a_empty"), False).otherwise(F.exists("_parts", lambda p: p["native"])))
    df = df.withColumn("a_ncomp", F.when(F.col("a_empty"), F.lit(0)).otherwise(F.size("_parts")).cast("short"))
    return df.drop("_raw", "_prof", "_low", "_parts", "_full", "_all", "_core", "_nums", "_alpha")
