"""Normalised business names: ten columns from one raw name."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as V
from .phonetic import nysiis_words
from .text import ascii_fold, has_native, join_initials, skeleton, tokens

COLUMNS = ["n_full", "n_core", "n_concat", "n_alt_a", "n_alt_b", "n_skel", "n_phon", "n_translit", "n_domain", "n_alias"]

# What counts as a title, phone number, domain or alias mark in a folded name.
TITLE = r"^\W*(?:(?:m/s|messrs|mr|mrs|ms)\b\.?\s*)+"
PHONE = r"\+?\d[\d\-\s().]{6,}\d"
DOMAIN = r"(?:https?://)?(?:www\.)?\b([a-z0-9][a-z0-9\-]*)\.(?:co\.in|com|net|org|biz|info|co|in|us|fr|io|online|shop|store|site|app)\b"
ALIAS = r"\b(?:f/?k/?a|a/?k/?a|d/?b/?a|formerly known as|formerly|trading as|doing business as|nee)\b"


def literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def mapped(words: Column, table: Column) -> Column:
    return F.transform(words, lambda t: F.coalesce(F.try_element_at(table, t), t))


def core_words(words: Column) -> Column:
    """Without legal forms; all of them if nothing else is there."""
    kept = F.filter(words, lambda t: ~t.isin(*sorted(V.LEGAL_WORDS)))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def normalize_names(df: DataFrame, name: str, phonetic: bool = True, folded: bool = False) -> DataFrame:
    """``df`` with COLUMNS. With ``folded`` the name is ASCII already and no Python runs for the folding."""
    raw = F.coalesce(F.col(f"`{name}`"), F.lit(""))
    df = df.withColumn("_s", F.lower(raw) if folded else ascii_fold(raw)).withColumn("n_translit", has_native(raw))
    s = F.regexp_replace(F.regexp_replace("_s", TITLE, " "), PHONE, " ")
    df = df.withColumn("_s", s)
    stem = F.when(F.contains("_s", F.lit(".")), F.regexp_replace("_s", DOMAIN, " $1 ")).otherwise(F.col("_s"))
    df = df.withColumn("_d", stem).withColumn("n_domain", F.col("_d") != F.col("_s"))
    s = F.regexp_replace(F.regexp_replace("_d", "[&+]", " and "), "@", " at ")
    df = df.withColumn("_s", s)
    df = df.withColumn("_a", F.regexp_replace("_s", ALIAS, " | ")).withColumn("n_alias", F.col("_a") != F.col("_s"))
    words = F.trim(F.regexp_replace(F.regexp_replace("_a", r"[^a-z0-9|]+", " "), r"\|", "|"))
    # bars are tokens only where they stand alone, so a bar inside a token stays there
    df = df.withColumn("_w", F.array_join(mapped(tokens(join_initials(words)), literal_map(V.NAME_WORDS)), " "))
    trimmed = F.regexp_replace(F.regexp_replace("_w", r"^(?:(?:mr|mrs|ms|messrs|\|)(?: |$))+", ""), r"(?:(?:^| )\|)+$", "")
    bars = F.split(trimmed, r"(?:^| )\|(?= |$)")
    df = df.withColumn("_p", F.filter(F.transform(bars, lambda p: F.trim(p)), lambda p: p != ""))
    df = df.withColumn("_all", F.flatten(F.transform("_p", tokens)))
    df = df.withColumn("_core", core_words(F.col("_all")))
    parts = F.transform("_p", lambda p: F.array_join(core_words(tokens(p)), " "))
    df = df.withColumn("n_full", F.array_join("_all", " ")).withColumn("n_core", F.array_join("_core", " ")).withColumn("n_concat", F.array_join("_core", ""))
    df = df.withColumn("n_alt_a", F.coalesce(F.try_element_at(parts, F.lit(1)), "n_core")).withColumn("n_alt_b", F.coalesce(F.try_element_at(parts, F.lit(-1)), "n_core"))
    df = df.withColumn("n_skel", F.array_join(F.transform("_core", skeleton), " "))
    df = df.withColumn("n_phon", nysiis_words("n_core") if phonetic else F.lit(None).cast("string"))
    blank = raw == ""
    for c in ("n_translit", "n_domain", "n_alias"):
        df = df.withColumn(c, F.when(blank, False).otherwise(F.col(c)))
    return df.drop("_s", "_d", "_a", "_w", "_p", "_all", "_core")
