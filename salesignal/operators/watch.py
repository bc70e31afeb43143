"""Sales named after a person: who it is, what is known of them, and which notices are due."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesignal.functions.names import location_for, named_estate_person
from salesignal.session import checkpointed

#: Verdicts that make a person notable, and confidences that are enough for it.
NOTABLE, SURE = ("collector", "artist", "dealer", "curator", "academic"), ("high", "medium")
#: Days before a sale's last day from which a reminder is due, and hours between two runs.
CLOSING_DAYS, RUN_HOURS = 2, 24


def is_notable(verdict: Column, confidence: Column) -> Column:
    return F.coalesce(F.lower(verdict).isin(*NOTABLE) & F.lower(confidence).isin(*SURE), F.lit(False))


def worth_keeping(verdict: Column, confidence: Column) -> Column:
    """An unknown verdict of low confidence says no more than that the search failed; it is asked again."""
    return ~F.coalesce((F.lower(verdict) == "unknown") & (F.lower(confidence) == "low"), F.lit(False))


def named_sales(polls: DataFrame, identities: DataFrame) -> DataFrame:
    """polls of sales named after somebody, with person, place, researchable, verdict, notable and verdict_key: what was known of that person at that house when the sale was polled.

    polls: sale, at, title, house, location, ends (date). identities: person, house, verdict, confidence, checked_at; the last that is worth keeping counts for each. A name of one word cannot be researched (surname_only); one without a verdict is pending. Distinct titles are read once.
    """
    # kept before it is filtered, so that the long rule is not computed for the filter and the result
    titles = checkpointed(polls.select("title").distinct().withColumn("person", named_estate_person(F.col("title")))).filter("person is not null")
    kept = identities.filter(worth_keeping(F.col("verdict"), F.col("confidence"))).groupBy("person", "house").agg(F.max_by(F.struct("verdict", "confidence", "checked_at"), F.struct("checked_at", "verdict", "confidence")).alias("known"))
    rows = polls.join(titles, "title").withColumn("house", F.coalesce("house", F.lit(""))).join(kept, ["person", "house"], "left")
    known = F.coalesce(F.col("known.checked_at") <= F.col("at"), F.lit(False))
    verdict, researchable = F.when(known, F.lower("known.verdict")), F.size(F.split("person", " ")) >= 2
    return rows.select(
        *polls.columns, "person", location_for(F.col("location"), F.col("title")).alias("place"), researchable.alias("researchable"), verdict.alias("verdict"),
        (known & is_notable(F.col("known.verdict"), F.col("known.confidence"))).alias("notable"), F.coalesce(verdict, F.when(~researchable, "surname_only"), F.lit("pending")).alias("verdict_key"),
    )


def _due(ends: Column) -> Column:
    return F.date_sub(ends, CLOSING_DAYS).cast("timestamp")


def notices(rows: DataFrame, until: Column) -> DataFrame:
    """(sale, at, notice, verdict_key): first for a sale's first poll; changed where the verdict differs from the one sent last; closing once for a notable sale in its last days.

    rows: sale, at, verdict_key, notable, ends; one for each sale and time. All polls of a sale but those that repeat the verdict are sent, so the verdict sent last is that of the poll before. The reminder goes out with the first poll in the last days that sends nothing else, or, where no poll comes, at the next run of a day on which it is due, RUN_HOURS after a poll at least, `until` at most. Two windows over one ordering of a sale's polls, and one group a sale.
    """
    own = Window.partitionBy("sale").orderBy("at")
    before, following, n = F.lag("verdict_key").over(own), F.lead("at").over(own), F.row_number().over(own)
    read = rows.withColumns({"_n": n, "_before": before, "_next": following})
    news = F.when(F.col("_n") == 1, "first").when(~F.col("verdict_key").eqNullSafe(F.col("_before")), "changed")
    read = read.withColumn("notice", news)
    due, notable = _due(F.col("ends")), F.coalesce(F.col("notable") & F.col("ends").isNotNull(), F.lit(False))
    polled = F.when(notable & F.col("notice").isNull() & (F.col("at") >= due), F.col("at"))
    run = F.greatest(due, F.col("at") + F.expr(f"interval {RUN_HOURS} hours"))
    waited = F.when(notable & (run <= until) & (F.col("_next").isNull() | (run < F.col("_next"))) & (run < F.date_add("ends", 1).cast("timestamp")), run)
    read = read.withColumn("_closing", F.coalesce(polled, waited))
    closing = read.filter("_closing is not null").groupBy("sale").agg(F.min(F.struct("_closing", "verdict_key")).alias("c")).select("sale", F.col("c._closing").alias("at"), F.lit("closing").alias("notice"), "c.verdict_key")
    return read.filter("notice is not null").select("sale", "at", "notice", "verdict_key").unionByName(closing)


def mail_order(rows: DataFrame) -> DataFrame:
    """rows with `band` and `new`: notable sales first, then those nobody has looked into, then the rest; within a band new ones lead, the soonest end first. To be ordered by band, new (descending), ends, sale."""
    band = F.when(F.col("notable"), 0).when(F.col("verdict").isNull(), 1).otherwise(2)
    return rows.withColumns({"band": band, "new": F.col("notice") == "first"})


class Watched:
    """What a stream keeps of a sale between polls: the verdict sent last, whether it was notable, its last day, when it was polled, and whether the reminder is out."""

    def __init__(self, verdict: str | None = None, notable: bool = False, ends: date | None = None, at: datetime | None = None, reminded: bool = False):
        self.verdict, self.notable, self.ends, self.at, self.reminded = verdict, notable, ends, at, reminded

    def packed(self) -> tuple:
        return self.verdict, self.notable, self.ends, self.at, self.reminded

    def due(self) -> datetime | None:
        """When the reminder goes out if no poll comes before; None where none will."""
        if self.at is None or self.reminded or not self.notable or self.ends is None:
            return None
        last = datetime.combine(self.ends, time())
        run = max(last - timedelta(days=CLOSING_DAYS), self.at + timedelta(hours=RUN_HOURS))
        return run if run < last + timedelta(days=1) else None

    def waited(self, now: datetime, included: bool = False) -> list[tuple[datetime, str, str | None]]:
        """The reminder, if it was due before now."""
        run = self.due()
        if run is None or run > now or run == now and not included:
            return []
        self.reminded = True
        return [(run, "closing", self.verdict)]

    def polled(self, at: datetime, verdict: str | None, notable: bool, ends: date | None) -> list[tuple[datetime, str, str | None]]:
        """Notices of one poll, with what was due before it."""
        out = self.waited(at)
        if self.at is None:
            out.append((at, "first", verdict))
        elif verdict != self.verdict:
            out.append((at, "changed", verdict))
        elif notable and ends is not None and not self.reminded and at >= datetime.combine(ends, time()) - timedelta(days=CLOSING_DAYS):
            self.reminded = True
            out.append((at, "closing", verdict))
        self.verdict, self.notable, self.ends, self.at = verdict, bool(notable), ends, at
        return out
