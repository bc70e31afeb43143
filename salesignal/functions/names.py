"""Names in free text: cleaning, claims in listings, people that sales are named after."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesignal.functions.keys import squeezed, text_or_empty

# What marks a catalogue name as no person.
NO_PERSON = (
    r"(?i)unidentified|unknown|anonymous|^after |, after$|copy after|manufactor|manufactur| & co| co\.|company|corporation| inc\b| ltd\b|publisher|printing house|"
    r"gallery|museum|church|university|association|school|center|centre|foundation|society|committee|council|institute|studio\b|press\b|archives"
)
# Parts between commas that qualify a person and belong to no name.
NATIONALITIES = (
    "african[- ]?american|american|british|english|french|german|dutch|spanish|italian|irish|scottish|welsh|swedish|norwegian|danish|russian|polish|austrian|swiss|belgian|greek|portuguese|"
    "mexican|canadian|cuban|brazilian|haitian|jamaican|trinidadian|puerto rican|nigerian|ghanaian|ethiopian|kenyan|senegalese|malian|congolese|liberian|south african|egyptian|moroccan|japanese|"
    "chinese|korean|indian|filipino|vietnamese|thai|indonesian|australian|israeli|iranian|turkish|lebanese"
)
TITLES = (
    "dr|gen(?:eral)?|col(?:onel)?|capt(?:ain)?|maj(?:or)?|lt|rev(?:erend)?|bishop|elder|deacon|pastor|rabbi|sir|dame|madam|hon|mrs|mr|miss|ms|judge|senator|congressman|congresswoman|governor|mayor|"
    "professor|prof|sgt|sergeant|pvt|private|admiral|commander"
)
QUALIFIER = rf"(?i)^(?:{NATIONALITIES})$|^(?:{TITLES})\.?$"
# Words at the ends of a capitalised phrase that describe a work and name no one.
GENRE_WORDS = "framed wall art print signed original vintage antique large small oil watercolor canvas painting limited edition made earth lot estate collection".split()
CAPITALISED = r"\b([A-Z][a-z]{2,}(?:[,-]?\s+[A-Z][a-z.]{1,})+)"
BY_LINE = r"[\"“”']\s*,?\s*by\s+([A-Z][\w.'-]+(?:\s+[A-Z][\w.'-]+){0,3})"
PERSON_PATTERNS = (
    r"(?i:collection|estate|property|residence|home)\s+(?i:of)\s+(?i:the\s+)?(?i:late\s+)?(?i:(?:dr|mr|mrs|ms|prof)\.?\s+)?([A-Z][A-Za-z.'-]+(?:\s+(?:(?i:and)\s+|&\s+)?[A-Z][A-Za-z.'-]+){0,4})",
    r"(?i:\bthe\s+)([A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+){0,2})\s+(?i:collection\b)",
)
NAME_THEN_ESTATE = r"([A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+){0,2})\s+(?i:estate\b)"
# Words that make a phrase no person's name, and words of sale titles that stand before "estate".
NO_NAME = (
    "art fine estate estates jewelry jewellery antique antiques auction auctions moving downsizing lifetime private personal entire amazing huge online tag vintage collector collectors collection "
    "collections midcentury mid-century modern century furniture coin coins stamp stamps record records book books toy toys tool tools gun guns car cars"
).split()
TITLE_WORDS = (
    "club country living prominent luxury luxurious major star treasures treasure heritage preserve royal palm yacht prestigious upscale exclusive premier grand classic quality complete full final "
    "beautiful stunning waterfront lakefront lakeside ranch farm warehouse storage local large spectacular incredible packed loaded real multi big sale sales wonderful absolute timed online reserve "
    "unreserved consignment january february march april may june july august september october november december ave avenue street st rd road blvd boulevard court ct lane ln drive hwy highway person "
    "inhome in at on va nc sc ga fl tx ca ny pa oh mi il tn ky az wa mo wi mn"
).split()
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".replace(" ", "|")
TITLE_PLACE = rf"\b([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)?),?\s+({STATES})\b"
SIGNATURE_NOISE = r"(?i)\b(signed|sgd|illegible|indistinct|lower right|lower left|upper right|upper left|verso|recto|dated|circa|ca|no\.?|titled)\b"


def _stripped(c: Column, marks: str) -> Column:
    return F.regexp_replace(c, rf"^[{marks}]+|[{marks}]+$", "")


def clean_person_name(raw: Column) -> Column:
    """`Last, First, Suffix, 1838-1921 (painter)` in reading order; null for institutions, names with digits, and single words."""
    s = F.regexp_replace(text_or_empty(raw), r"\(.*?\)|\[.*?\]", " ")
    s = F.split(s, r",\s*(?:b\.|d\.|ca\.|circa|active|fl\.|\d)", 2)[0]
    s = _stripped(F.regexp_replace(s, r"\s+", " "), " ,;")
    parts = F.filter(F.transform(F.split(s, ","), lambda p: F.trim(p)), lambda p: p != "")
    parts = F.concat(F.slice(parts, 1, 1), F.filter(F.slice(parts, 2, 99), lambda p: ~p.rlike(QUALIFIER)))
    name = F.when(F.size(parts) >= 2, F.array_join(F.concat(F.slice(parts, 2, 1), F.slice(parts, 1, 1), F.slice(parts, 3, 99)), " ")).otherwise(F.array_join(parts, " "))
    bad = (s == "") | s.rlike(NO_PERSON) | s.rlike(r"\d")
    return F.when(~bad & (F.length(name) >= 5) & name.contains(" "), name)


def _trim_words(words: Column, junk: Iterable[str]) -> Column:
    """An array of words without junk at either end."""
    own = F.array(*[F.lit(w) for w in junk])
    good = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: F.when(~F.array_contains(own, F.lower(F.coalesce(F.try_element_at(words, i), F.lit("")))) & F.try_element_at(words, i).isNotNull(), i)), lambda i: i.isNotNull())
    return F.when(F.size(good) > 0, F.slice(words, F.array_min(good), F.array_max(good) - F.array_min(good) + 1)).otherwise(F.expr("cast(array() as array<string>)"))


def _first(candidates: Column) -> Column:
    return F.try_element_at(candidates, F.lit(1))


def listing_artist_claim(text: Column) -> Column:
    """The first capitalised phrase of two words or more once genre words are trimmed from its ends; four words at most."""
    phrases = F.regexp_extract_all(text_or_empty(text), F.lit(CAPITALISED), F.lit(1))
    claims = F.transform(phrases, lambda p: _trim_words(F.filter(F.split(p, r"[\s,-]+"), lambda w: w != ""), GENRE_WORDS))
    return F.array_join(F.slice(_first(F.filter(claims, lambda c: F.size(c) >= 2)), 1, 4), " ")


def claim_from_title(title: Column) -> Column:
    """The name after `"Title" by`, else the listing's claim."""
    by = F.regexp_extract(text_or_empty(title), BY_LINE, 1)
    return F.when(by != "", by).otherwise(listing_artist_claim(title))


def named_estate_person(title: Column) -> Column:
    """Whom a sale is named after: three patterns in turn, the first name left when junk is trimmed from its ends and none stands inside."""
    junk = sorted({*NO_NAME, *TITLE_WORDS})
    own = F.array(*[F.lit(w) for w in junk])
    t = text_or_empty(title)
    found = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in (*PERSON_PATTERNS, NAME_THEN_ESTATE)])

    def name(raw: Column) -> Column:
        s = F.regexp_replace(_stripped(squeezed(raw), " .,'&\\-"), r"^(?:Late|The)\s+", "")
        return _trim_words(F.filter(F.split(s, " "), lambda w: w != ""), junk)

    names = F.filter(F.transform(found, name), lambda w: (F.size(w) > 0) & ~F.exists(w, lambda x: F.array_contains(own, F.lower(x))))
    good = F.filter(F.transform(names, lambda w: F.struct(F.size(w).alias("n"), F.array_join(w, " ").alias("name"))), lambda x: (F.length(x["name"]) >= 4) & ~((x["n"] == 1) & (F.upper(x["name"]) == x["name"])))
    return _first(good)["name"]


def extract_names(title: Column, description: Column) -> Column:
    """Up to three different candidate names of people in title and description (600 characters of it, without tags)."""
    plain = F.substring(F.regexp_replace(text_or_empty(description), r"<[^>]+>", " "), 1, 600)
    text = F.concat(text_or_empty(title), F.lit("\n"), plain)
    own = F.array(*[F.lit(w) for w in NO_NAME])
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in PERSON_PATTERNS])
    names = F.transform(found, lambda r: _stripped(squeezed(r), " .,'&\\-"))
    good = F.filter(names, lambda s: (F.length(s) >= 4) & ~F.exists(F.split(s, " "), lambda w: F.array_contains(own, F.lower(w))))
    return F.slice(F.array_distinct(good), 1, 3)


def location_for(location: Column, title: Column) -> Column:
    city, state = (F.regexp_extract(text_or_empty(title), TITLE_PLACE, i) for i in (1, 2))
    return F.when(text_or_empty(location) != "", location).when(city != "", F.concat_ws(", ", city, state)).otherwise("the United States (exact city unknown)")


def clean_signature(raw: Column) -> Column:
    """A transcribed signature as a name, or empty: two to four name-like words, one of three letters at least."""
    s = F.regexp_replace(text_or_empty(raw), SIGNATURE_NOISE, " ")
    for pattern in ("[\"“”'`]", r"\(.*?\)", "[0-9]", r"[^A-Za-z.\-' ]"):
        s = F.regexp_replace(s, pattern, " ")
    tokens = F.filter(F.split(_stripped(squeezed(s), " .\\-'"), " "), lambda t: (F.length(t) > 1) | t.endswith("."))
    able = F.size(tokens).between(2, 4) & F.exists(tokens, lambda t: F.length(_stripped(t, ".")) >= 3)
    shown = F.transform(tokens, lambda t: F.when(F.length(t) > 2, F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 99)))).otherwise(F.upper(t)))
    return F.when(able, F.array_join(shown, " ")).otherwise("")
