"""Entity resolution: names to authority records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesignal.functions.keys import lookup_keys
from salesignal.functions.classify import standing


def authority_lookup(names: DataFrame, variants: DataFrame, artists: DataFrame) -> DataFrame:
    """(name, artist_id, ambiguous): keys are tried in order, the first with a hit decides; of several artists the one with more institutions, then a known birth year, then the smaller id.

    names: name. variants: variant_key, artist_id. artists: artist_id, institutions, birth_year. Distinct names are resolved once and joined back by the caller.
    """
    asked = names.select("name").distinct().select("name", F.posexplode(lookup_keys(F.col("name"))).alias("pos", "variant_key"))
    hits = asked.join(variants.select("variant_key", "artist_id").distinct(), "variant_key").groupBy("name", "artist_id").agg(F.min("pos").alias("pos"))
    ranked = hits.join(artists.select("artist_id", "institutions", "birth_year"), "artist_id")
    first = Window.partitionBy("name")
    ranked = ranked.withColumn("_first", F.min("pos").over(first)).filter(F.col("pos") == F.col("_first"))
    order = Window.partitionBy("name").orderBy(F.desc("institutions"), F.col("birth_year").isNull(), "artist_id")
    ranked = ranked.withColumns({"_rank": F.row_number().over(order), "_n": F.count("*").over(first)}).filter("_rank = 1")
    return ranked.select("name", "artist_id", (F.col("_n") > 1).alias("ambiguous"))


def resolve_cascade(claims: DataFrame, stores: list[DataFrame]) -> DataFrame:
    """(claim, key, source): a claim as it stands, its first three and its first two words, each looked up in the stores in turn; the first hit stays.

    claims: claim (a key). stores: key.
    """
    words = F.split("claim", " ")
    forms = F.array_distinct(F.array(F.col("claim"), F.array_join(F.slice(words, 1, 3), " "), F.array_join(F.slice(words, 1, 2), " ")))
    asked = claims.select("claim").distinct().select("claim", F.posexplode(F.filter(forms, lambda f: F.size(F.split(f, " ")) >= 2)).alias("pos", "key"))
    both = None
    for i, store in enumerate(stores):
        own = store.select("key").distinct().withColumn("source", F.lit(i))
        both = own if both is None else both.unionByName(own)
    hits = asked.join(both, "key").withColumn("_rank", F.row_number().over(Window.partitionBy("claim").orderBy("pos", "source")))
    return hits.filter("_rank = 1").select("claim", "key", "source")


def authority_rollup(holdings: DataFrame, distinctions: DataFrame, artists: DataFrame) -> DataFrame:
    """Each artist's museums in order, their number, works held, awards and standing. artists: artist_id, papers."""
    held = holdings.groupBy("artist_id").agg(F.array_sort(F.collect_set("institution")).alias("museums"), F.sum("works").alias("works"))
    awarded = distinctions.groupBy("artist_id").agg(F.array_sort(F.collect_set("distinction")).alias("awards"))
    out = artists.join(held, "artist_id", "left").join(awarded, "artist_id", "left")
    museums, awards = F.coalesce("museums", F.expr("cast(array() as array<string>)")), F.coalesce("awards", F.expr("cast(array() as array<string>)"))
    return out.select("artist_id", museums.alias("museums"), F.size(museums).cast("long").alias("museum_count"), F.coalesce("works", F.lit(0)).alias("works"), awards.alias("awards"), standing(F.col("papers"), F.size(museums), F.size(awards)).alias("standing"))
