"""Join keys. The families differ on purpose; each keeps its own name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First-name abbreviations of older listings.
ABBREVIATIONS = {
    "wm": "william", "chas": "charles", "jas": "james", "thos": "thomas", "geo": "george", "jno": "john", "benj": "benjamin", "saml": "samuel",
    "robt": "robert", "richd": "richard", "edwd": "edward", "jos": "joseph", "fredk": "frederick", "alex": "alexander", "hy": "henry", "eliz": "elizabeth",
}
GENERATION = r"(?i)\b(?:jr|sr|ii|iii|iv)\b\.?"
COMPANY_WORDS = "llc|inc|ltd|co|company|corp"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def artist_key(name: Column) -> Column:
    """Lower case; runs of anything but a-z and space become one space."""
    return squeezed(F.regexp_replace(F.lower(text_or_empty(name)), "[^a-z ]+", " "))


def intel_key(name: Column) -> Column:
    """Lower case; anything but a-z and space is deleted, so O'Keeffe is one word here."""
    return squeezed(F.regexp_replace(F.lower(text_or_empty(name)), "[^a-z ]+", ""))


def charity_key(name: Column) -> Column:
    """artist_key without generation suffixes."""
    return squeezed(F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(name)), GENERATION, " "), "[^a-z ]+", " "))


def slug(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(name)), GENERATION, " "), "[^a-z0-9 ]+", " ")
    return F.regexp_replace(squeezed(bare), " ", "-")


def words(key: Column) -> Column:
    return F.filter(F.split(key, r"\s+"), lambda w: w != "")


def sorted_key(key: Column) -> Column:
    """The words of a key in order: any order of the same words gives the same key."""
    return F.array_join(F.array_sort(words(key)), " ")


def expanded_key(key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.array_join(F.transform(words(key), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def lookup_keys(name: Column) -> Column:
    """Keys of a name by priority: as it is, expanded, sorted, both. A name of one word has none."""
    key = artist_key(name)
    wide = expanded_key(key)
    keys = F.array_distinct(F.array(key, wide, sorted_key(key), sorted_key(wide)))
    return F.when(F.size(words(key)) >= 2, keys).otherwise(F.expr("cast(array() as array<string>)"))


def house_key(name: Column) -> Column:
    """Lower-case words without trailing company words; empty when nothing else is left."""
    bare = squeezed(F.regexp_replace(F.lower(text_or_empty(name)), "[^a-z0-9 ]+", " "))
    return F.regexp_replace(bare, f"(^| )({COMPANY_WORDS})( ({COMPANY_WORDS}))*$", "")


def gallery_key(name: Column) -> Column:
    return squeezed(F.regexp_replace(F.lower(text_or_empty(name)), "[^a-z0-9 ]", ""))


def platform_key(platform: Column, ext_id: Column) -> Column:
    return F.concat_ws(":", platform, ext_id.cast("string"))


def synthetic_price_key(*parts: Column) -> Column:
    """synth: and 20 digits of SHA-1 over the parts; a missing part counts as the word None."""
    return F.concat(F.lit("synth:"), F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])), 1, 20))


def houses_match(a: Column, b: Column) -> Column:
    """Equal keys, or the one with fewer characters (4 at least) is a run of whole words of the other."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    inside = F.concat(F.lit(" "), long, F.lit(" ")).contains(F.concat(F.lit(" "), short, F.lit(" ")))
    return (a != "") & (b != "") & ((a == b) | ((F.length(short) >= 4) & inside))
