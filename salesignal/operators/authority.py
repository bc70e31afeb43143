"""The authority: catalogue records of many sources merged into artists, with their spellings, holdings and distinctions, and what is said of them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesignal.functions.classify import standing
from salesignal.functions.keys import artist_key, sorted_key
from salesignal.functions.names import clean_person_name
from salesignal.operators.resolve import authority_lookup
from salesignal.session import checkpointed

#: Institutions whose holdings count for standing, and how they are called in evidence.
MAJOR = {
    "met": "the Met", "nga": "National Gallery", "saam": "SAAM", "npg": "National Portrait Gallery", "aic": "Art Institute of Chicago", "moma": "MoMA", "whitney": "the Whitney",
    "cleveland": "Cleveland", "hmsg": "Hirshhorn", "chndm": "Cooper Hewitt", "nmafa": "Nat. Museum of African Art", "acm": "Anacostia", "nmaahc": "NMAAHC",
}
FILLED = ("wikidata_qid", "birth_year", "death_year", "nationality")


def usable_key(key: Column) -> Column:
    """Keys of one word or under four letters meet too many people to be stored."""
    return (F.length(key) >= 4) & key.contains(" ")


def id_owners(rows: DataFrame) -> DataFrame:
    """(outside_id, owner, since): the key of the entity that each outside id comes to belong to, and the row from which on it does.

    rows: seq (orderable, one a row), norm_key, outside_id. Going through rows in order, an id that no entity has goes to the entity of the row's key, unless that one has an id already; then the row's id is dropped, and a later row may still bring it to another key. So ids and keys are paired greedily in order of the rows in which they first stand together. In each round the pairs that are the earliest both of their key and of their id are fixed, as nothing before them can take either away, and all pairs with a fixed key or id go; rounds are as many as the longest chain of pairs that wait for one another, few where most keys have one id. Each round aggregates before it shuffles, so neither a key with very many ids nor an id with very many keys meets in one task.
    """
    pair = F.struct("seq", "norm_key", "outside_id")
    open_ = checkpointed(rows.filter("outside_id is not null").groupBy("norm_key", "outside_id").agg(F.min("seq").alias("seq")))
    fixed = None
    while not open_.isEmpty():
        of_key = open_.groupBy("norm_key").agg(F.min(pair).alias("p")).select("p.*")
        of_id = open_.groupBy("outside_id").agg(F.min(pair).alias("p")).select("p.*")
        now = checkpointed(of_key.join(of_id, ["seq", "norm_key", "outside_id"]))
        fixed = now if fixed is None else fixed.unionByName(now)
        open_ = checkpointed(open_.join(now.select("norm_key"), "norm_key", "left_anti").join(now.select("outside_id"), "outside_id", "left_anti"))
    if fixed is None:
        fixed = open_.select("seq", "norm_key", "outside_id")
    return fixed.select("outside_id", F.col("norm_key").alias("owner"), F.col("seq").alias("since"))


def with_entity(rows: DataFrame) -> DataFrame:
    """rows with `entity_key` and `by_id`: the entity that each row becomes part of when rows are added in order: the one that has the row's id by then, else that of its key. Rows without a usable key go.

    An entity is called by the key of the row that made it, which no other entity has. rows: seq, norm_key, outside_id (blank counts as none).
    """
    rows = rows.filter(usable_key(F.col("norm_key"))).withColumn("outside_id", F.nullif(F.trim("outside_id"), F.lit("")))
    owners = id_owners(rows)
    # rows without an id need no join, and would all meet in one task
    named = rows.filter("outside_id is null").withColumns({"entity_key": F.col("norm_key"), "by_id": F.lit(False)})
    own = F.coalesce(F.col("since") <= F.col("seq"), F.lit(False))
    known = rows.filter("outside_id is not null").join(owners, "outside_id", "left").withColumns({"entity_key": F.when(own, F.col("owner")).otherwise(F.col("norm_key")), "by_id": own}).drop("owner", "since")
    return named.unionByName(known)


def merged_entities(landed: DataFrame) -> DataFrame:
    """One row an entity from with_entity's rows: the earliest name stays, gaps are filled by later rows, papers rise, sources are united. Columns of FILLED, papers and source are optional."""
    later = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in FILLED if c in landed.columns]
    papers = [F.max(F.coalesce(F.col("papers").cast("int"), F.lit(0))).alias("papers")] if "papers" in landed.columns else []
    return landed.groupBy("entity_key").agg(
        F.min_by(F.trim("name"), "seq").alias("canonical"), F.max(F.when(F.col("by_id"), F.col("outside_id"))).alias("outside_id"), *later, *papers,
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("records"),
    )


class Authority(NamedTuple):
    artists: DataFrame
    variants: DataFrame
    holdings: DataFrame
    distinctions: DataFrame
    landed: DataFrame


def new_records(records: DataFrame, imported: DataFrame) -> DataFrame:
    """Records of sources that are not imported yet. imported: source."""
    return records.join(imported.select("source").distinct(), "source", "left_anti")


def authority_build(records: DataFrame) -> Authority:
    """The authority from catalogue records, added in order.

    records: seq (orderable, one a row: source by source, then the place in it), source, raw_name, outside_id, wikidata_qid, birth_year, death_year, nationality, papers, institution (null: holds nothing), works, distinction. Names are read as catalogues write them; those of institutions, with digits and of one word go. artists: artist_id (the entity's key), canonical and what merged_entities tells. variants: variant_key (in the order of the name and sorted), artist_id and the source that brought it first. holdings: works summed by institution. distinctions: each once. landed: the records with their artist_id.
    """
    # a spelling is read once, however many records have it, and the records are kept once for all that is asked of them
    spellings = checkpointed(records.select("raw_name").distinct().withColumn("name", clean_person_name(F.col("raw_name"))))
    spellings = spellings.filter("name is not null").withColumn("norm_key", artist_key(F.col("name")))
    rows = checkpointed(records.join(spellings, "raw_name"))
    landed = checkpointed(with_entity(rows)).withColumnRenamed("entity_key", "artist_id")
    artists = merged_entities(landed.withColumnRenamed("artist_id", "entity_key")).withColumnRenamed("entity_key", "artist_id")
    spelled = landed.select("artist_id", "seq", "source", F.explode(F.array_distinct(F.array("norm_key", sorted_key(F.col("norm_key"))))).alias("variant_key"))
    variants = spelled.groupBy("variant_key", "artist_id").agg(F.min_by("source", "seq").alias("source"))
    holdings = landed.filter("institution is not null").groupBy("artist_id", "institution").agg(F.sum(F.coalesce("works", F.lit(1))).alias("works"))
    return Authority(artists, variants, holdings, landed.filter("distinction is not null").select("artist_id", "distinction").distinct(), landed)


def authority_profiles(authority: Authority, history: DataFrame | None = None, crowd: DataFrame | None = None) -> DataFrame:
    """A row for each artist: museums (most works first, then by name), museum_count (major ones), works_held, awards, historic_sales, collections and standing.

    history: artist_id, records (sales of old catalogues: evidence, no standing). crowd: artist_id, museum (claims that anybody may have made: evidence, too).
    """
    held = authority.holdings.groupBy("artist_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("works")).alias("less"), "institution"))).alias("held"), F.sum("works").alias("works_held"))
    awarded = authority.distinctions.groupBy("artist_id").agg(F.array_sort(F.collect_set("distinction")).alias("awards"))
    out = authority.artists.join(held, "artist_id", "left").join(awarded, "artist_id", "left")
    none = F.expr("cast(array() as array<string>)")
    if history is not None:
        out = out.join(history.groupBy("artist_id").agg(F.sum("records").alias("historic_sales")), "artist_id", "left")
    if crowd is not None:
        out = out.join(crowd.groupBy("artist_id").agg(F.array_sort(F.collect_set("museum")).alias("collections")), "artist_id", "left")
    museums = F.coalesce(F.transform("held", lambda h: h["institution"]), none)
    out = out.withColumns(
        {
            "museums": museums,
            "museum_count": F.size(F.filter(museums, lambda m: m.isin(*MAJOR))).cast("long"),
            "works_held": F.coalesce("works_held", F.lit(0)),
            "awards": F.coalesce("awards", none),
            "historic_sales": F.coalesce("historic_sales", F.lit(0)) if history is not None else F.lit(0).cast("long"),
            "collections": F.coalesce("collections", none) if crowd is not None else none,
        }
    ).drop("held")
    return out.withColumn("standing", standing(F.col("papers"), F.col("museum_count"), F.size("awards")))


def describe(museums: Column, papers: Column, awards: Column, collections: Column, historic_sales: Column, birth_year: Column, death_year: Column) -> Column:
    """What is known of an artist as a line: `in the Met, SAAM; papers at Archives of American Art; ... (1838-1909)`. Four museums, three awards and four collections at most."""
    names = F.create_map(*[F.lit(x) for pair in MAJOR.items() for x in pair])
    shown = F.transform(F.slice(F.filter(museums, lambda m: m.isin(*MAJOR)), 1, 4), lambda m: F.try_element_at(names, m))
    parts = F.array(
        F.when(F.size(shown) > 0, F.concat(F.lit("in "), F.array_join(shown, ", "))),
        F.when(papers > 0, "papers at Archives of American Art"),
        F.when(F.size(awards) > 0, F.array_join(F.slice(awards, 1, 3), "; ")),
        F.when(F.size(collections) > 0, F.concat(F.lit("collections per Wikidata: "), F.array_join(F.slice(collections, 1, 4), ", "))),
        F.when(historic_sales > 0, F.concat(historic_sales.cast("string"), F.lit(" historic auction records (Getty PI)"))),
    )
    life = F.when(birth_year.isNotNull() & (birth_year != 0), F.concat(F.lit(" ("), birth_year.cast("string"), F.lit("-"), F.coalesce(F.nullif(death_year, F.lit(0)).cast("string"), F.lit("")), F.lit(")"))).otherwise("")
    said = F.trim(F.concat(F.array_join(F.array_compact(parts), "; "), life))
    return F.when(said == "", "documented artist").otherwise(said)


def described(profiles: DataFrame) -> DataFrame:
    """profiles with `description`."""
    return profiles.withColumn("description", describe(*[F.col(c) for c in ("museums", "papers", "awards", "collections", "historic_sales", "birth_year", "death_year")]))


def lookup_standing(names: DataFrame, authority: Authority, profiles: DataFrame) -> DataFrame:
    """(name, artist_id, ambiguous, canonical, standing, description) of each distinct name that the authority knows: its spellings are tried in turn, of several artists the one with more institutions, then with a birth year, then the smaller id."""
    institutions = authority.holdings.groupBy("artist_id").agg(F.count("*").alias("institutions"))
    ranked = authority.artists.join(institutions, "artist_id", "left").select("artist_id", F.coalesce("institutions", F.lit(0)).alias("institutions"), "birth_year")
    found = authority_lookup(names, authority.variants, ranked)
    return found.join(described(profiles).select("artist_id", "canonical", "standing", "description"), "artist_id").select("name", "artist_id", "ambiguous", "canonical", "standing", "description")


def with_evidence(lots: DataFrame, known: DataFrame, name: str = "artist") -> DataFrame:
    """lots with the standing and the description of the artist they name, null where nothing is known; distinct names are looked up once by the caller (known: lookup_standing's rows)."""
    return lots.join(known.select(F.col("name").alias(name), "standing", "description"), name, "left")
