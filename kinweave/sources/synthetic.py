"""Generated business records with known matches, made by expressions on row numbers and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "amber birch cedar delta ember falcon garnet harbor indigo jasper kestrel lumen meadow nimbus onyx prairie quartz raven summit timber".split()
KINDS = "traders foods motors textiles pharma books travels printers logistics jewels".split()
FORMS = {"US": ["Inc", "LLC", "Corp"], "India": ["Private Limited", "Limited", "LLP"], "France": ["SARL", "SAS", "SA"]}
STREETS = ["Main Street", "Oak Avenue", "Lake Road", "Hill Drive", "Park Lane", "Mill Court", "River Road", "Church Street"]
CITIES = {"US": ["Austin, Texas", "Reno, Nevada", "Salem, Oregon"], "India": ["Pune, Maharashtra", "Mysore, Karnataka", "Patna, Bihar"], "France": ["Lyon, Normandie", "Nice, Corse", "Brest, Bretagne"]}


def _pick(items: list[str], salt: str, ident: Column) -> Column:
    return F.get(F.array(*map(F.lit, items)), F.pmod(F.xxhash64(F.lit(salt), ident), F.lit(len(items))).cast("int"))


def _chance(salt: str, *on: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), *on), F.lit(10_000)) / 10_000.0


def _by_country(country: Column, table: dict[str, list[str]], salt: str, ident: Column) -> Column:
    out = F.lit("")
    for name, items in table.items():
        out = F.when(country == name, _pick(items, salt, ident)).otherwise(out)
    return out


def generate(spark: SparkSession, n: int, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(s1, index, truth): n query entities, zero to three noisy copies of each in either index source, and a quarter more distractors."""
    ident = F.col("id")
    roll = _chance(f"{seed}c", ident)
    country = F.when(roll < 0.47, "US").when(roll < 0.94, "India").when(roll < 0.98, "France").otherwise("")
    base = spark.range(n).select("id", country.alias("country"))
    like = F.when(F.col("country") == "", "US").otherwise(F.col("country"))
    name = F.initcap(F.concat_ws(" ", _pick(WORDS, f"{seed}a", ident), _pick(WORDS, f"{seed}b", ident), _pick(KINDS, f"{seed}k", ident)))
    base = base.withColumn("name", name).withColumn("form", _by_country(like, FORMS, f"{seed}f", ident))
    number = F.pmod(F.xxhash64(F.lit(f"{seed}h"), ident), F.lit(900)) + 1
    base = base.withColumn("address", F.concat_ws(", ", F.concat_ws(" ", number.cast("string"), _pick(STREETS, f"{seed}s", ident)), _by_country(like, CITIES, f"{seed}t", ident)))
    label = lambda src, i: F.concat(F.lit(f"S{src}-"), F.lpad(i.cast("string"), 7, "0"))
    s1 = base.select(label(1, ident).alias("entity_id"), F.concat_ws(" ", "name", "form").alias("business_name"), F.col("address").alias("business_address"), "country")
    index, truth = None, None
    for src in (2, 3):
        copies = base.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).where(F.col("k") < F.pmod(F.xxhash64(F.lit(f"{seed}m{src}"), ident), F.lit(4)))
        more = spark.range(n, n + n // 8).select("id", F.lit("US").alias("country"), F.concat_ws(" ", _pick(WORDS, f"{seed}x{src}", ident), _pick(KINDS, f"{seed}y{src}", ident)).alias("name"), F.lit("Inc").alias("form"), F.concat_ws(" ", (F.col("id") % 900).cast("string"), F.lit("Elm Street, Reno, Nevada")).alias("address"), F.lit(0).alias("k"))
        rows = copies.unionByName(more)
        u, words = _chance(f"{seed}n{src}", ident, F.col("k")), F.split("name", " ")
        typo = F.concat(F.substring("name", 1, 2), F.substring("name", 4, 100))
        swapped = F.array_join(F.reverse(words), " ")
        full = F.concat_ws(" ", "name", "form")
        if src == 2:
            noisy = F.when(u < 0.20, F.col("name")).when(u < 0.35, swapped).when(u < 0.50, F.concat_ws(" ", typo, "form")).when(u < 0.60, F.concat(F.lower(F.array_join(words, "")), F.lit(".com"))).otherwise(full)
        else:
            noisy = F.when(u < 0.20, F.array_join(F.slice(words, 1, 2), " ")).when(u < 0.35, F.concat_ws(" ", "name", F.lit("Services"))).when(u < 0.50, typo).otherwise(full)
        v = _chance(f"{seed}v{src}", ident, F.col("k"))
        place = F.when(v < 0.10, "").when(v < 0.40, F.upper("address")).otherwise(F.col("address"))
        eid = label(src, ident * 4 + F.col("k"))
        out = rows.select(eid.alias("entity_id"), noisy.alias("business_name"), place.alias("business_address"), "country", F.lit(src).alias("src"))
        pairs = copies.select(label(1, ident).alias("q_id"), eid.alias("i_id"))
        index = out if index is None else index.unionByName(out)
        truth = pairs if truth is None else truth.unionByName(pairs)
    return s1, index, truth
