"""Scalar text functions. Everything here but the two NFKC/NFKD folds is built from JVM expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as V

# --- folding to ASCII ----------------------------------------------------------------------------
# Indic blocks of Unicode share one layout, so one table by offset serves the nine of them from Devanagari (U+0900) on.
_INDIC_FIRST, _INDIC_LAST, _BLOCK = 0x0900, 0x0D7F, 0x80
_CONSONANTS = dict(zip(range(0x15, 0x3A), "k kh g gh n c ch j jh n t th d dh n t th d dh n n p ph b bh m y r r l l l v s s s h".split(), strict=True))
_VOWELS = dict(zip(range(0x05, 0x15), "a aa i ii u uu r l e e e ai o o o au".split(), strict=True))
_SIGNS = dict(zip(range(0x3E, 0x4D), "aa i ii u uu r rr e e e ai o o o au".split(), strict=True))
_VIRAMA, _MARKS = 0x4D, {0x01: "n", 0x02: "n", 0x03: "h", 0x3C: "", 0x3D: ""}
_LATIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ħ": "h", "ı": "i", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."}


#: Cyrillic letters whose Latin form is not how their name begins.
_CYRILLIC = {"ghe": "g", "ie": "e", "io": "yo", "short i": "y", "el": "l", "em": "m", "en": "n", "er": "r", "es": "s", "ef": "f", "ha": "kh", "hard sign": "", "soft sign": "", "yeru": "y", "yu": "yu", "ya": "ya", "yi": "yi", "ukrainian ie": "ye", "byelorussian-ukrainian i": "i", "short u": "w"}
_SYLLABARIES = {"hiragana", "katakana", "hangul", "ethiopic", "cherokee", "yi"}


@lru_cache(4096)
def named_letter(ch: str) -> str | None:
    """A letter in Latin letters after its Unicode name: whole syllables as they are named, others by how the name begins.

    None for characters that are named by number only, such as CJK ideographs.
    """
    script, _, rest = unicodedata.name(ch, "").lower().partition(" ")
    for kind in ("letter ", "syllable ", "character "):
        if kind in rest:
            name = rest.partition(kind)[2].partition(" with ")[0]
            break
    else:
        return "" if unicodedata.combining(ch) else None
    if script in _SYLLABARIES:
        return name.removeprefix("small ").replace(" ", "") if not name.startswith("prolonged") else ""
    if script == "cyrillic" and name in _CYRILLIC:
        return _CYRILLIC[name]
    if script == "thai" and name.startswith(("sara ", "mai ")):
        return name[5:] if name.startswith("sara ") else ""
    name = name.removeprefix("final ")
    return re.match("[^aeiou]+|.?", name.split(" ")[0])[0].replace("rh", "r")


def fold_text(s: str) -> str:
    """NFKC, Latin letters without marks, Indic syllables and letters of other alphabets in Latin letters, lower case.

    Characters without a Latin form (ideographs, symbols) become blanks.
    """
    if s.isascii():
        return s.lower()
    out: list[str] = []
    pending = False  # an Indic consonant waits for its vowel
    for ch in unicodedata.normalize("NFKC", s).lower():
        code = ord(ch)
        if _INDIC_FIRST <= code <= _INDIC_LAST:
            at = (code - _INDIC_FIRST) % _BLOCK
            if at in _SIGNS or at == _VIRAMA:
                out.append(_SIGNS.get(at, "") if pending else "")
                pending = False
                continue
            if pending:
                out.append("a")
            pending = at in _CONSONANTS
            if 0x66 <= at <= 0x6F:
                out.append(str(at - 0x66))
            else:
                out.append(_CONSONANTS.get(at) or _VOWELS.get(at) or _MARKS.get(at, " "))
            continue
        pending = False
        if code < 128:
            out.append(ch)
        elif ch in _LATIN:
            out.append(_LATIN[ch])
        else:
            plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
            if not plain.isascii() or not plain:
                plain = named_letter(ch)
            out.append(" " if plain is None else plain)
    return "".join(out).lower()


@F.pandas_udf(T.StringType())
def ascii_fold(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in s:
        yield x.map(fold_text, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def ascii_fold_all(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in s:
        yield x.map(lambda parts: [fold_text(p) for p in parts], na_action="ignore")


@F.pandas_udf(T.StringType())
def strip_marks(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKD without combining marks."""
    for x in s:
        yield x.map(lambda t: t if t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)), na_action="ignore")


# --- predicates ----------------------------------------------------------------------------------


def has_native(c: Column) -> Column:
    """A letter beyond Latin Extended-B."""
    return c.rlike(r"[\p{L}&&[^\u0000-ɏ]]")


def is_non_latin(c: Column) -> Column:
    """Some non-ASCII character and no ASCII letter."""
    return c.rlike(r"[^\u0000-\u007F]") & ~c.rlike("[A-Za-z]")


def no_latin_letter(stripped: Column) -> Column:
    """No ASCII letter in a text without marks; true for empty and digit-only texts. Of the diagnostics."""
    return ~F.lower(stripped).rlike("[a-z]")


# --- tokens --------------------------------------------------------------------------------------


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def alnum_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)


def unicode_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), 0)


def qgrams(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))).otherwise(F.array().cast("array<string>"))


def retrieval_tokens(name: Column, address: Column) -> Column:
    """Words of the name (n:), of the address (a:) and 4-grams of the squashed name (g:)."""
    name, address = F.coalesce(name, F.lit("")), F.coalesce(address, F.lit(""))
    squashed = F.regexp_replace(F.lower(name), r"[^0-9a-zऀ-ॿ]", "")
    mark = lambda p, xs: F.transform(xs, lambda t: F.concat(F.lit(p), t))
    return F.concat(mark("n:", unicode_tokens(name)), mark("a:", unicode_tokens(address)), mark("g:", qgrams(squashed, 4)))


def skeleton(t: Column) -> Column:
    """Consonant skeleton of a token; digits and empty pass."""
    x = t
    for a, b in V.DIGRAPHS:
        x = F.replace(x, F.lit(a), F.lit(b))
    tail = lambda c: F.substr(c, F.lit(2))
    x = F.concat(F.substring(x, 1, 1), F.replace(tail(x), F.lit("h"), F.lit("")))
    x = F.translate(x, V.SKELETON_FROM, V.SKELETON_TO)
    x = F.concat(F.substring(x, 1, 1), F.regexp_replace(tail(x), "[aeiou]", ""))
    return F.when(t.rlike("^[0-9]*$"), t).otherwise(F.regexp_replace(x, r"(.)\1+", "$1"))


@lru_cache(200_000)
def _word_skeleton(t: str) -> str:
    """As :func:`skeleton`, of a word of small ASCII letters."""
    for a, b in V.DIGRAPHS:
        t = t.replace(a, b)
    t = (t[:1] + t[1:].replace("h", "")).translate(str.maketrans(V.SKELETON_FROM, V.SKELETON_TO))
    return re.sub(r"(.)\1+", r"\1", t[:1] + re.sub("[aeiou]", "", t[1:]))


def skeletons_of_words(words: str, least: int) -> str:
    """Skeletons of a text's words, which are of the letters a to z, joined by blanks: of all, or of the first that make ``least`` letters."""
    out, n = [], 0
    for t in words.split():
        out.append(_word_skeleton(t))
        n += len(out[-1]) + 1
        if n > least:
            break
    return " ".join(out)


def join_initials(c: Column) -> Column:
    """'l l c' -> 'llc': runs of two or more single letters become one token."""
    return F.regexp_replace(c, r"(?<![a-z0-9|])([a-z]) (?=[a-z](?![a-z0-9|]))", "$1")


# --- keys, folds, names of files -----------------------------------------------------------------


def country_key(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def crc_fold(ident: Column, n: int = 10, salt: str = "") -> Column:
    return F.crc32(F.concat(F.lit(salt), ident)) % n


def hash_sample(ident: Column, mod: int) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(mod)) == 0


def safe_name(c: Column) -> Column:
    return F.concat(F.substring(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), 1, 40), F.lit("_"), F.lpad(F.lower(F.hex(F.crc32(c))), 8, "0"))


def first_number(nums: Column) -> Column:
    """First integer token, -1 where there is none."""
    return F.coalesce(F.expr("null").cast("long") if nums is None else F.when(F.regexp_extract(nums, r"(?:^| )([0-9]{1,18})(?= |$)", 1) != "", F.regexp_extract(nums, r"(?:^| )([0-9]{1,18})(?= |$)", 1).try_cast("long")), F.lit(-1).cast("long"))


# --- texts for encoders and scorers --------------------------------------------------------------


def encoder_text(name: Column, address: Column) -> Column:
    return F.concat(F.lit("query: "), F.coalesce(name, F.lit("")), F.lit(" | "), F.coalesce(address, F.lit("")))


def reranker_text(name: Column, address: Column, country: Column, size: int = 100) -> Column:
    cut = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, size)
    return F.concat(F.lit("name: "), cut(name), F.lit(" address: "), cut(address), F.lit(" country: "), cut(country))


def scorer_text(c: Column) -> Column:
    return F.substring(c, 1, 200)


# --- set and edit measures that need no Python ---------------------------------------------------


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def capped_levenshtein(a: Column, b: Column, cap: int = 3) -> Column:
    return F.when(F.abs(F.length(a) - F.length(b)) > cap, F.lit(cap + 1)).otherwise(F.levenshtein(a, b))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def trigrams(plain: Column) -> Column:
    """Distinct trigrams of the letters and digits of a text without marks; the whole text if it is shorter."""
    s = F.regexp_replace(F.lower(plain), "[^a-z0-9]", "")
    return F.when(F.length(s) >= 3, F.array_distinct(qgrams(s, 3))).otherwise(F.array(s))
