"""The deep scan and the harvest of results, from raw lots on: sales not seen yet, mills, names claimed in titles, what is known of them, flags and prices."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesignal.functions import classify as c
from salesignal.functions.keys import artist_key
from salesignal.functions.names import claim_from_title, listing_artist_claim
from salesignal.operators.authority import Authority, lookup_standing
from salesignal.operators.feeds import market_row, outcome
from salesignal.operators.select import mills
from salesignal.session import checkpointed

#: Claims that name a kind and no person.
GENERIC = (
    r"(?i)^(native american|african american|american indian|old master|folk artist|american school|french school|english school|chinese school|continental school|pair of|set of|lot of|group of|collection of)$"
    r"|unidentified|unknown artist"
)
#: What a classifier's verdict that a name is none is filed under.
NO_NAME_TIER, NO_NAME_SOURCE = "none", "classifier"


class Scan(NamedTuple):
    """scanned: sale; blocked: house, sale, masters, claims; unknown: name, route (research for people that the authority knows, else classify); flags: lot, sale, artist_key, artist, reason, evidence."""

    scanned: DataFrame
    blocked: DataFrame
    unknown: DataFrame
    flags: DataFrame


def contains_any(text: Column, fragments: Sequence[str]) -> Column:
    """Whether a text holds one of a few fragments of a configuration; null holds none."""
    out = F.lit(False)
    for f in fragments:
        out = out | F.coalesce(F.lower(text).contains(f.lower()), F.lit(False))
    return out


def claims_known(names: DataFrame, market: DataFrame, authority: Authority, profiles: DataFrame) -> DataFrame:
    """names (name, distinct) with what the stores say of each: the market's row for the name as claimed, else for the name that the authority has for it; artist_id, canonical, standing and description.

    market: artist_key, tier, high.
    """
    known = lookup_standing(names, authority, profiles)
    rows = names.join(known, "name", "left").withColumns({"claim": artist_key(F.col("name")), "canonical_key": artist_key(F.col("canonical"))})
    keys = rows.select("claim", F.when(F.col("canonical").isNotNull(), F.col("canonical_key")).alias("canonical")).groupBy("claim").agg(F.max("canonical").alias("canonical"))
    found = market_row(keys.select("claim"), market, keys).drop("canonical")
    return rows.join(found, "claim").select("name", "claim", "canonical", "canonical_key", "standing", "description", "artist_key", "tier", "high")


#: What so many titles say, at most, goes to all tasks, so that lots need not be moved for it.
TOLD = 200_000


def told_lots(lots: DataFrame, titles: DataFrame) -> DataFrame:
    """lots with what is known of their titles; lots of other titles go. titles: title, distinct, and further columns; kept, as they are counted first."""
    return lots.join(F.broadcast(titles) if titles.count() <= TOLD else titles, "title")


def deep_scan(auctions: DataFrame, lots: DataFrame, scanned: DataFrame, blocked: DataFrame, known_lots: DataFrame, market: DataFrame, authority: Authority, profiles: DataFrame, favourites: Sequence[str] = ()) -> Scan:
    """One scan over the sales that none before it took.

    auctions: sale, house, pos, failed (its lots could not be fetched: it is not marked and comes again). lots: lot, sale, title, bid. Sales of blocked houses are left out. A sale that claims too many famous originals is a mill: it is marked, its lots are not looked at, its house is blocked and the house's sales behind it (by pos) are left for good; houses that hold a favourite fragment are never blocked. Of the others' lots, those that are neither skipped by title nor known are new; the artist that a title claims is looked up once for each name. A lot is flagged by its market, else by a strong standing; the description of an artist whom the authority knows is its evidence. Names without a market row are told, to be researched.
    """
    # what is read several times is kept once: the sales, the mills among them, the new lots and what is known of their names
    todo = checkpointed(auctions.join(scanned.select("sale").distinct(), "sale", "left_anti").join(blocked.select("house").distinct(), "house", "left_anti").filter(~F.coalesce("failed", F.lit(False))))
    own = lots.join(todo.select("sale", "house", "pos"), "sale")
    found = checkpointed(mills(own.withColumnRenamed("sale", "auction")).filter("mill").withColumnRenamed("auction", "sale").join(todo, "sale").filter(~contains_any(F.col("house"), favourites)))
    first = found.groupBy("house").agg(F.min("pos").alias("_blocked_at"))
    before = F.col("_blocked_at").isNull() | (F.col("pos") <= F.col("_blocked_at"))
    taken = todo.join(first, "house", "left").filter(before)
    caught = found.join(first, "house").filter(F.col("pos") == F.col("_blocked_at"))
    clean = taken.filter("_blocked_at is null or pos <> _blocked_at").select("sale")
    fresh = lots.join(clean, "sale")
    titles = checkpointed(fresh.select("title").distinct().filter(~c.skip_lot(F.col("title"))).withColumn("name", listing_artist_claim(F.col("title")))).filter("name <> ''")
    new = checkpointed(told_lots(fresh, titles).join(known_lots.select("lot").distinct(), "lot", "left_anti"))
    told = checkpointed(claims_known(new.select("name").distinct(), market, authority, profiles))
    unknown = told.filter("artist_key is null").select("name", F.when(F.col("canonical").isNotNull(), "research").otherwise("classify").alias("route"))
    reason = F.when(c.flag_lot(F.col("tier"), F.col("high"), F.col("bid")), "market").when(c.flag_institution(F.col("standing"), F.col("bid")), "institution")
    flags = new.join(told, "name").withColumn("reason", reason).filter("reason is not null")
    flags = flags.select("lot", "sale", F.coalesce("artist_key", "canonical_key").alias("artist_key"), F.coalesce("canonical", "name").alias("artist"), "reason", F.coalesce("description", F.lit("")).alias("evidence"))
    return Scan(taken.select("sale"), caught.select("house", "sale", "masters", "claims"), unknown, flags)


def resolved_people(claims: DataFrame, market: DataFrame, authority: Authority, profiles: DataFrame) -> DataFrame:
    """(claim, artist): a claim that names a person whom the authority or the market store knows, as it stands, else by its first three words, else by its first two. Claims that name a kind, and forms that a classifier has found to be no name, give nothing.

    claims: claim, distinct. market: artist_key, artist, tier, source.
    """
    words = F.split("claim", " ")
    short = F.array(*[F.when(F.size(words) > n, F.array_join(F.slice(words, 1, n), " ")) for n in (3, 2)])
    asked = claims.filter(~F.col("claim").rlike(GENERIC)).select("claim", F.posexplode(F.array_compact(F.concat(F.array(F.col("claim")), short))).alias("pos", "name"))
    known = lookup_standing(asked.select("name").distinct(), authority, profiles).select("name", F.col("canonical").alias("_a"))
    store = market.filter(~F.coalesce((F.col("tier") == NO_NAME_TIER) & (F.col("source") == NO_NAME_SOURCE), F.lit(False))).select(F.col("artist_key").alias("_k"), F.col("artist").alias("_m"))
    hits = asked.join(known, "name", "left").join(store, artist_key(F.col("name")) == F.col("_k"), "left").withColumn("artist", F.coalesce("_a", "_m")).filter("artist is not null")
    return hits.groupBy("claim").agg(F.min_by("artist", "pos").alias("artist"))


def harvest(auctions: DataFrame, lots: DataFrame, harvested: DataFrame, recorded: DataFrame, market: DataFrame, authority: Authority, profiles: DataFrame, blocked: Sequence[str] = ()) -> DataFrame:
    """(lot, sale, artist, outcome, price, suspect) of closed sales not harvested yet: whom each title claims, resolved to a person, what the lot brought, and whether that is far beneath a strong market. Lots on record, of blocked houses and of nobody known are left out.

    auctions: sale, house, failed. lots: lot, sale, title, realized, bid, bids. market: artist_key, artist, tier, source, high.
    """
    todo = auctions.filter(~F.coalesce("failed", F.lit(False)) & ~contains_any(F.col("house"), blocked)).join(harvested.select("sale").distinct(), "sale", "left_anti").select("sale")
    # a title is read and its claim resolved once, however many lots have it; what it says is kept for them
    own = lots.join(todo, "sale")
    titles = checkpointed(own.select("title").distinct().withColumn("claim", claim_from_title(F.col("title")))).filter("claim <> ''")
    people = resolved_people(titles.select("claim").distinct(), market, authority, profiles)
    strong = market.filter("tier = 'strong'").select(F.col("artist_key").alias("_k"), F.col("high").alias("_ceiling"))
    named = checkpointed(titles.join(people, "claim").join(strong, artist_key(F.col("artist")) == F.col("_k"), "left").select("title", "artist", "_ceiling"))
    rows = told_lots(own, named).join(recorded.select("lot").distinct(), "lot", "left_anti").withColumn("_r", outcome(F.col("realized"), F.col("bid"), F.col("bids")))
    return rows.select("lot", "sale", "artist", "_r.outcome", "_r.price", c.is_suspect(F.col("_r.price"), F.col("_r.outcome"), F.col("_ceiling")).alias("suspect"))
