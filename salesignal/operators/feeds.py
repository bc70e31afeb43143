"""Whole steps of the market feeds: screening of lots, flags, harvest of results, significance; and the small table rules around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesignal.functions import classify as c
from salesignal.operators.resolve import resolve_cascade
from salesignal.operators.select import art_density, mills


def outcome(realized: Column, bid: Column, bids: Column) -> Column:
    """struct(outcome, price): a realised price is a sale, a bid without one a final bid, else unsold."""
    sold, bid_only = F.coalesce(realized > 0, F.lit(False)), F.coalesce((bid > 0) & (bids > 0), F.lit(False))
    return F.struct(F.when(sold, "sold").when(bid_only, "final_bid").otherwise("unsold").alias("outcome"), F.when(sold, realized).when(bid_only, bid).alias("price"))


def in_band(ends: Column, now: Column, before_hours: int = 12, after_days: int = 14, keep_unreadable: bool = False) -> Column:
    """Whether a date text lies in the band around now. One feed drops what cannot be read, the other keeps it."""
    at = F.try_to_timestamp(ends)
    inside = (at >= now - F.expr(f"interval {before_hours} hours")) & (at <= now + F.expr(f"interval {after_days} days"))
    return F.coalesce(inside, F.lit(keep_unreadable))


def shares_token(a: Column, b: Column, least: int = 3) -> Column:
    """Whether two labels share a word of `least` letters or more; a label without such words is no mismatch."""

    return share_token(label_tokens(a, least), label_tokens(b, least))


def label_tokens(x: Column, least: int = 3) -> Column:
    """A label's words of `least` letters or more; none of null."""
    return F.filter(F.transform(F.split(F.lower(F.coalesce(x, F.lit(""))), r"\s+"), lambda t: F.btrim(t, F.lit("."))), lambda t: F.length(t) >= least)


def share_token(a: Column, b: Column) -> Column:
    """shares_token for labels that are cut into words already, as where each meets very many others."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def best_gallery(rows: DataFrame) -> DataFrame:
    """(artist, tier, gallery): the lowest tier above 0, the first listed of equals; 0 and empty without one. rows: artist, gallery, tier, pos."""
    real = F.col("tier") > 0
    out = rows.groupBy("artist").agg(F.min(F.when(real, F.struct("tier", "pos", "gallery"))).alias("best"))
    return out.select("artist", F.coalesce("best.tier", F.lit(0)).alias("tier"), F.coalesce("best.gallery", F.lit("")).alias("gallery"))


def append_new(bag: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """bag and the rows of more whose key it lacks, one for each key, so that the first list wins."""
    return bag.unionByName(more.dropDuplicates([key]).join(bag.select(key).distinct(), key, "left_anti").select(bag.columns))


def with_band(sales: DataFrame, house: Column, favourites: Column, art: Column) -> DataFrame:
    """sales with `band`: favourite houses 0, an art signal 1, the rest 2. To be ordered by band, then end, unknown ends last."""
    return sales.withColumn("band", F.when(F.coalesce(house.rlike(favourites) if isinstance(favourites, str) else favourites, F.lit(False)), 0).when(art, 1).otherwise(2))


def name_occurrences(records: DataFrame, hedge: str = r"(?i)attributed|after|circle|copy|follower|manner|school|studio|style") -> DataFrame:
    """(key, by_id, records): how often an outside id of nine digits, else a name, occurs; hedged attributions do not count. records: name, outside_id, hedge."""
    own = records.filter(~F.coalesce(F.col("hedge").rlike(hedge), F.lit(False)))
    valid = F.coalesce(F.col("outside_id").rlike(r"^\d{9}$"), F.lit(False))
    key = F.when(valid, F.col("outside_id")).otherwise(F.lower(F.trim("name")))
    return own.select(key.alias("key"), valid.alias("by_id")).filter("key is not null and key <> ''").groupBy("key", "by_id").agg(F.count("*").alias("records"))


def set_status(rows: DataFrame, where: Column, status: str, column: str = "status") -> DataFrame:
    """rows with the status of those that meet the condition replaced; a condition that is null is not met."""
    return rows.withColumn(column, F.when(where, F.lit(status)).otherwise(F.col(column)))


def truncated(rows: DataFrame, **most: int) -> DataFrame:
    """rows with texts cut to so many code points before they are written."""
    return rows.withColumns({name: F.substring(F.col(name), 1, n) for name, n in most.items()})


def append_ledger(events: DataFrame, path: str, day: str = "ts") -> None:
    """Appends events to the ledger below path, a folder for each day; nothing written before is touched."""
    events.withColumn("day", F.to_date(day)).write.mode("append").partitionBy("day").parquet(path)


def run_log(runs: DataFrame) -> DataFrame:
    """One row a run from its started and finished records: run_id, started, finished (null while it runs), stats. runs: run_id, at, kind, stats."""
    done = F.col("kind") == "finished"
    return runs.groupBy("run_id").agg(F.min(F.when(F.col("kind") == "started", F.col("at"))).alias("started"), F.max(F.when(done, F.col("at"))).alias("finished"), F.max_by("stats", F.when(done, F.col("at"))).alias("stats"))


def screen_lots(lots: DataFrame, profiles: DataFrame, least_density: float = 0.02) -> DataFrame:
    """lots with `density`, `stage` and `why`: where each lot leaves the funnel, or that it is a candidate.

    In order: sales of mills (famous names claimed as originals), lots that the density rule does not screen, copies and prints by title, large editions, artists who are not significant. lots: lot, auction, title, detail, auction_title, auction_house, artist; profiles: artist, standing, collections, tier, ceiling. Shares and claims are aggregated a sale and joined back; a sale of very many lots is split by the adaptive skew join.
    """
    of_sale = art_density(lots).join(mills(lots), "auction").select("auction", "density", "mill")
    rows = lots.join(of_sale, "auction").join(profiles, "artist", "left")
    why = c.significance(F.col("artist"), F.col("standing"), F.col("collections"), F.col("tier"), F.col("ceiling"))
    passes = c.passes_density(F.col("title"), F.col("detail"), F.col("density"), F.col("auction_title"), F.col("auction_house"), least_density)
    stage = F.when(F.col("mill"), "mill").when(~passes, "density").when(c.skip_lot(F.col("title")), "skipped").when(c.mass_edition(F.col("title")), "edition").when(why == "", "insignificant").otherwise("candidate")
    return rows.withColumns({"stage": stage, "why": F.when(stage == "candidate", why).otherwise("")}).select(*lots.columns, "density", "stage", "why")


def market_row(claims: DataFrame, market: DataFrame, canonical: DataFrame) -> DataFrame:
    """claims with the market's row for their claim, else for the canonical name that the claim is a variant of. claims: claim; market: artist_key, tier, high; canonical: claim, canonical."""
    names = market.columns
    direct = market.select(*[F.col(n).alias(f"_d_{n}") for n in names])
    other = market.select(*[F.col(n).alias(f"_o_{n}") for n in names])
    out = claims.join(canonical, "claim", "left").join(direct, F.col("claim") == F.col("_d_artist_key"), "left")
    out = out.join(other, F.col("_d_artist_key").isNull() & (F.col("canonical") == F.col("_o_artist_key")), "left")
    return out.select(*claims.columns, "canonical", *[F.coalesce(f"_d_{n}", f"_o_{n}").alias(n) for n in names])


def deep_flags(lots: DataFrame, market: DataFrame, canonical: DataFrame, standing: DataFrame) -> DataFrame:
    """(lot, artist_key, reason) of flagged lots: `market` where the estimate's range makes the bid look low, else `institution` for a strong standing at a small bid. lots: lot, claim, bid; standing: canonical, standing. Distinct claims are resolved once."""
    rows = lots.join(market_row(lots.select("claim").distinct(), market, canonical), "claim", "left").join(standing, "canonical", "left")
    reason = F.when(c.flag_lot(F.col("tier"), F.col("high"), F.col("bid")), "market").when(c.flag_institution(F.col("standing"), F.col("bid")), "institution")
    return rows.select("lot", F.coalesce("artist_key", "canonical").alias("artist_key"), reason.alias("reason")).filter("reason is not null")


def harvested_prices(lots: DataFrame, harvested: DataFrame, stores: list[DataFrame], recorded: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(lot, artist, outcome, price) of closed sales not harvested yet: claims resolved in the stores, unknown names and lots on record left out. Equal lots count once. lots: lot, sale, claim, realized, bid, bids.

    Where lots are of items of a catalogue, names has the claims (item, claim) and lots have item instead: claims are then resolved once for the catalogue and lots move by short keys, first by sale, then by item. lot may be a struct.
    """
    todo = lots.join(harvested.select("sale").distinct(), "sale", "left_anti").join(recorded.select("lot").distinct(), "lot", "left_anti").distinct()  # by sale already, so equal lots meet without a shuffle
    known = resolve_cascade(todo if names is None else names, stores).select("claim", F.col("key").alias("artist"))
    key = "claim" if names is None else "item"
    if names is not None:
        known = names.select("item", "claim").distinct().join(known, "claim").select("item", "artist")
    result = outcome(F.col("realized"), F.col("bid"), F.col("bids"))
    return todo.select("lot", key, result.alias("_r")).select("lot", key, "_r.outcome", "_r.price").join(known, key).select("lot", "artist", "outcome", "price")


def significance_queue(names: DataFrame, budget: int) -> DataFrame:
    """names with `why` and `state`: firm, significant (by what is known locally), ask (the best `budget` of the rest) or deferred to a later run, never dropped. The best are those that triage takes for real artists, then those with the highest price it has heard of, then by name.

    names: name, standing, collections, tier, ceiling, known (triage's guess), heard (its price); triage ranks and proves nothing.
    """
    why = c.significance(F.col("name"), F.col("standing"), F.col("collections"), F.col("tier"), F.col("ceiling"))
    rows = names.withColumn("why", why).withColumn("state", F.when(c.is_firm(F.col("name")), "firm").when(F.col("why") != "", "significant"))
    order = [F.desc(F.coalesce("known", F.lit(False))), F.desc(F.coalesce("heard", F.lit(0.0))), F.col("name")]
    asked = rows.filter("state is null").orderBy(*order).limit(budget).select("name", F.lit("ask").alias("_ask"))
    return rows.join(asked, "name", "left").withColumn("state", F.coalesce("state", "_ask", F.lit("deferred"))).drop("_ask")


def significance_answers(queue: DataFrame, answers: DataFrame) -> DataFrame:
    """queue with the answers of those asked merged in: significant with the answer's reason, or not; a name that was asked and got no answer is deferred. answers: name, why (empty: nothing was found)."""
    told = answers.groupBy("name").agg(F.max(F.coalesce("why", F.lit(""))).alias("_told"))
    rows = queue.join(told, "name", "left")
    asked = F.col("state") == "ask"
    state = F.when(asked & F.col("_told").isNull(), "deferred").when(asked & (F.col("_told") != ""), "significant").when(asked, "insignificant").otherwise(F.col("state"))
    return rows.withColumns({"state": state, "why": F.when(asked, F.coalesce("_told", F.lit(""))).otherwise(F.col("why"))}).drop("_told")


def grown(feed: DataFrame, held: DataFrame, key: str, growth: int = 5) -> DataFrame:
    """(key, held, seen) of keys of which the feed has `growth` rows more than are held, at least. feed: key. held: key, held."""
    seen = feed.groupBy(key).agg(F.count("*").alias("seen"))
    return seen.join(held, key).filter(F.col("seen") >= F.col("held") + growth).select(key, "held", "seen")


def seen_ids(ids: DataFrame, most: int, key: str = "id", bins: int = 1024) -> DataFrame:
    """The `most` largest different ids: the memory that a watch-list scan keeps between runs. Ids grow with time, so an id that is still live does not roll off.

    The smallest id to keep is found by histograms: each pass counts the ids in `bins` ranges of equal width and looks on in the one in which `most` is reached, so seven passes do for any whole numbers, and no task orders the ids.
    """
    own = ids.select(key).filter(F.col(key).isNotNull()).distinct()
    low, high, n = own.agg(F.min(key), F.max(key), F.count("*")).first()
    if n <= most:
        return own
    wanted = most
    while high > low:
        width = (high - low) // bins + 1
        at = F.expr(f"(cast(`{key}` as decimal(20, 0)) - ({low})) div {width}")  # the difference of two whole numbers may be none
        counts = sorted(((int(r["at"]), r["count"]) for r in own.filter(F.col(key).between(low, high)).groupBy(at.alias("at")).count().collect()), reverse=True)
        for bin_, count in counts:
            if count >= wanted:
                break
            wanted -= count
        low, high = low + bin_ * width, min(high, low + (bin_ + 1) * width - 1)
    return own.filter(F.col(key) >= low)


def priority_queue(rows: DataFrame, most: int) -> DataFrame:
    """The next `most` lots of a stage: highest priority, then the longest untouched. rows: lot, priority, updated_at."""
    return rows.orderBy(F.desc("priority"), "updated_at", "lot").limit(most)


def later_photos(photos: DataFrame, scanned: DataFrame) -> DataFrame:
    """(sale, photos) of sales that have more photos than when they were scanned. photos: sale, url; scanned: sale, photo_count."""
    now = photos.groupBy("sale").agg(F.count_distinct("url").alias("photos"))
    return now.join(scanned, "sale").filter(F.col("photos") > F.col("photo_count")).select("sale", "photos")


def kept_in_order(rows: DataFrame, members: DataFrame, key: str, order: str = "pos") -> DataFrame:
    """rows whose key is a member, in their own order, numbered anew from 1 within each list."""
    kept = rows.join(members.select(key).distinct(), key, "left_semi")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("list").orderBy(order, key)))
