"""The every-lot funnel past its first gate: screening, signatures read from pictures, the significance gate, judgements and what takes a flag back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesignal.functions import classify as c
from salesignal.functions.keys import text_or_empty
from salesignal.functions.names import clean_signature
from salesignal.operators.select import art_density, mills

#: Promise from which a lot goes on, and that of a lot with a person's name; words of reproductions; editions of very many.
PROMISE, NAMED_PROMISE = 5.0, 3.0
POSTER = r"(?i)\b(poster|repro(duction)?|giclee|giclée|offset lithograph|photo.?mechanical|seriolithograph|collector plate|figurine|commemorative)\b"
EDITION = r"\b\d{1,6}\s*/\s*(\d{3,6})\b"


def is_named(artist: Column) -> Column:
    """Two words or more: a person that can be looked up."""
    return F.size(F.split(F.trim(text_or_empty(artist)), r"\s+")) >= 2


def entered(lots: DataFrame, least_density: float = 0.02) -> DataFrame:
    """lots with stage (blocked: of a mill; junk: by the density rule; s1) and s1_priority (1 for unambiguous art, which is screened first). lots: lot, auction, title, detail, auction_title, auction_house."""
    of_sale = art_density(lots).join(mills(lots), "auction").select("auction", "density", "mill")
    rows = lots.join(of_sale, "auction")
    passes = c.passes_density(F.col("title"), F.col("detail"), F.col("density"), F.col("auction_title"), F.col("auction_house"), least_density)
    stage = F.when(F.col("mill"), "blocked").when(passes, "s1").otherwise("junk")
    return rows.withColumns({"stage": stage, "s1_priority": c.strong_art(F.col("title"), F.col("detail")).cast("int")}).drop("density", "mill")


def screened(lots: DataFrame, replies: DataFrame, known: DataFrame, promise: float = PROMISE, named_promise: float = NAMED_PROMISE) -> DataFrame:
    """lots of stage s1 with a reply go to s3 or are done; lots without one stay and are tried again.

    A lot goes on when its promise is high enough, when the authority knows its artist, or, with a lower bar, when it names a person; never when it is said to be no art. replies: lot, is_art, artist, promise. known: artist. Adds artist, promise and `why`.
    """
    rows = lots.join(replies.select("lot", "is_art", F.trim(text_or_empty(F.col("artist"))).alias("artist"), "promise", F.lit(True).alias("_told")), "lot", "left")
    rows = rows.join(known.select("artist", F.lit(True).alias("_known")).distinct(), "artist", "left")
    goes = (F.col("promise") >= promise) | F.col("_known").isNotNull() | (is_named(F.col("artist")) & (F.col("promise") >= named_promise))
    goes = F.coalesce(goes, F.lit(False)) & F.coalesce(F.col("is_art"), F.lit(True))
    mine = (F.col("stage") == "s1") & F.col("_told").isNotNull()
    return rows.withColumns({"stage": F.when(mine & goes, "s3").when(mine, "done").otherwise(F.col("stage")), "why": F.when(mine & ~goes, "screened out")}).drop("is_art", "_told", "_known")


def rescued(lots: DataFrame, signatures: DataFrame, budget: int) -> DataFrame:
    """lots with the artist of those s3 lots that name nobody read from their picture: the `budget` most promising ones of unambiguous art are looked at, and a legible signature that cleans to a name is taken. signatures: lot, signature, legible."""
    wanted = lots.filter((F.col("stage") == "s3") & ~is_named(F.col("artist")) & F.col("img").isNotNull() & c.strong_art(F.col("title"), F.col("detail")))
    looked = wanted.orderBy(F.desc(F.coalesce("promise", F.lit(0.0))), "lot").limit(budget).select("lot")
    read = signatures.filter("legible").select("lot", clean_signature(F.col("signature")).alias("_name")).filter("_name <> ''").join(looked, "lot", "left_semi")
    return lots.join(read, "lot", "left").withColumn("artist", F.coalesce("_name", "artist")).drop("_name")


def gated(lots: DataFrame, profiles: DataFrame) -> DataFrame:
    """lots with s3 lots that cannot be flagged done: those that name nobody, and those whose artist is known not to be significant. A lot whose artist is undetermined stays in s3, marked deferred; lots of unknown profiles are judged. profiles: artist, significant, deferred, why, museums, gallery_tier."""
    rows = lots.join(profiles.select("artist", "significant", "deferred", F.col("why").alias("_why"), "museums", "gallery_tier", F.lit(True).alias("_profile")), "artist", "left")
    s3 = F.col("stage") == "s3"
    nobody = s3 & ~is_named(F.col("artist"))
    later = s3 & ~nobody & F.coalesce("deferred", F.lit(False))
    low = s3 & ~nobody & ~later & F.col("_profile").isNotNull() & ~F.coalesce("significant", F.lit(False))
    why = F.when(nobody, "no identifiable artist name").when(low, F.concat(F.lit("artist not significant: "), F.coalesce(F.nullif("_why", F.lit("")), F.lit("no museum, gallery or auction record")))).when(later, "deferred").otherwise(F.col("why"))
    return rows.withColumns({"why": why, "stage": F.when(nobody | low, "done").otherwise(F.col("stage"))}).drop("_why", "_profile", "deferred")


def judged(lots: DataFrame, judgements: DataFrame, views: DataFrame, least_edition: int = 500) -> DataFrame:
    """lots with flagged: s3 lots (not deferred) with a judgement are done, and flagged if it says yes and nothing takes that back: an artist who is not significant, a reproduction whose artist no museum or gallery of tiers 1 to 3 has, an edition of least_edition or more, a picture that does not match the listing. judgements: lot, flag. views: lot, matches."""
    rows = lots.join(judgements.select("lot", "flag"), "lot", "left").join(views.select("lot", "matches"), "lot", "left")
    mine = (F.col("stage") == "s3") & F.col("flag").isNotNull() & ~F.coalesce(F.col("why") == "deferred", F.lit(False))
    title = text_or_empty(F.col("title"))
    yes = F.upper("flag").startswith("Y")
    kept = F.coalesce(F.col("museums") != "", F.lit(False)) | F.coalesce(F.col("gallery_tier").between(1, 3), F.lit(False))
    taken = F.when(~F.coalesce("significant", F.lit(True)), "artist not significant").when(title.rlike(POSTER) & ~kept, "reproduction").when(F.coalesce(F.regexp_extract(title, EDITION, 1).try_cast("int") >= least_edition, F.lit(False)), "mass edition").when(~F.coalesce("matches", F.lit(True)), "picture does not match")
    why = F.when(mine & ~yes, "judged no").when(mine, F.coalesce(taken, F.lit("flagged"))).otherwise(F.col("why"))
    flagged = mine & yes & taken.isNull()
    return rows.withColumns({"why": why, "flagged": F.coalesce(flagged, F.lit(False)), "stage": F.when(mine, "done").otherwise(F.col("stage"))}).drop("flag", "matches", "museums", "gallery_tier", "significant")


def funnel(lots: DataFrame, replies: DataFrame, known: DataFrame, signatures: DataFrame, profiles: DataFrame, judgements: DataFrame, views: DataFrame, rescue_budget: int = 40) -> DataFrame:
    """All stages of one cycle: lot, auction, stage, s1_priority, artist, promise, flagged, why."""
    rows = judged(gated(rescued(screened(entered(lots), replies, known), signatures, rescue_budget), profiles), judgements, views)
    return rows.select("lot", "auction", "stage", "s1_priority", "artist", "promise", "flagged", "why")
