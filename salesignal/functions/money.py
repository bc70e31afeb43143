"""Prices, currencies, sizes and years in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesignal.functions.keys import text_or_empty

# Rough dollars per unit, and the marks of each currency.
RATES = {"USD": 1.0, "GBP": 1.27, "EUR": 1.08, "JPY": 0.0067, "CHF": 1.13, "HKD": 0.128, "CNY": 0.14, "CAD": 0.73, "AUD": 0.66, "SGD": 0.74}
MARKS = {
    "HK$": "HKD", "HKD": "HKD", "CA$": "CAD", "C$": "CAD", "CAD": "CAD", "AU$": "AUD", "A$": "AUD", "AUD": "AUD", "S$": "SGD", "SGD": "SGD", "US$": "USD", "USD": "USD",
    "£": "GBP", "GBP": "GBP", "€": "EUR", "EUR": "EUR", "CHF": "CHF", "RMB": "CNY", "CN¥": "CNY", "CNY": "CNY", "JP¥": "JPY", "JPY": "JPY", "¥": "JPY", "$": "USD",
}
FRACTIONS = {"¼": 0.25, "½": 0.5, "¾": 0.75, "⅓": 1 / 3, "⅔": 2 / 3, "⅛": 0.125}
SIZE = r"(\d+(?:\.\d+)?(?:\s+\d+\s*/\s*\d+)?|\d+\s*[¼½¾⅓⅔⅛])\s*[x×by]\s*(\d+(?:\.\d+)?(?:\s+\d+\s*/\s*\d+)?|\d+\s*[¼½¾⅓⅔⅛])(?:\s*[x×by]\s*\d+(?:\.\d+)?)?"


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def parse_price(text: Column) -> Column:
    """The first number of a text, without dollar signs and thousands commas; null unless above 0."""
    run = F.regexp_extract(F.regexp_replace(text_or_empty(text), r"\$", ""), r"([\d,]+(?:\.\d{1,2})?)", 1)
    return _positive(F.regexp_replace(run, ",", "").try_cast("double"))


#: Marks from the longest on, of equally long ones in the order listed.
RANKED = sorted(MARKS, key=lambda mark: -len(mark))


def detect_currency(text: Column) -> Column:
    """The longest mark found decides, of equally long ones the first listed; dollars where there is none. One pattern finds the marks of a text, so only those that are there are ranked."""
    found = F.regexp_extract_all(F.upper(text_or_empty(text)), F.lit("(" + "|".join(m.replace("$", r"\$") for m in RANKED) + ")"), F.lit(1))
    place = F.create_map(*[F.lit(x) for i, m in enumerate(RANKED, 1) for x in (m, i)])
    best = F.array_min(F.transform(found, lambda m: F.try_element_at(place, m)))
    return F.when(best.isNotNull(), F.element_at(F.array(*[F.lit(MARKS[m]) for m in RANKED]), best)).otherwise("USD")


def extract_amount(text: Column) -> Column:
    """The longest run of digits, the first of equals, read in the American or European way."""
    runs = F.regexp_extract_all(F.replace(text_or_empty(text), F.lit(" "), F.lit("")), F.lit(r"(\d[\d.,]*\d|\d)"), F.lit(1))
    longest = F.aggregate(runs, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    # bound once: the reading names it a dozen times
    return F.element_at(F.transform(F.array(longest), _read_amount), 1)


def _read_amount(s: Column) -> Column:
    comma, dot = s.contains(","), s.contains(".")
    # one separator with one or two digits after it is a decimal point
    decimal = s.rlike(r"^\d+[.,]\d{1,2}$")
    european = F.length(F.substring_index(s, ",", -1)) < F.length(F.substring_index(s, ".", -1))
    plain = (
        F.when(comma & dot & european, F.translate(F.translate(s, ".", ""), ",", "."))
        .when(comma & dot, F.translate(s, ",", ""))
        .when(comma & decimal, F.translate(s, ",", "."))
        .when(comma, F.translate(s, ",", ""))
        .when(dot & ~decimal, F.translate(s, ".", ""))
        .otherwise(s)
    )
    return _positive(plain.try_cast("double"))


def parse_money(text: Column) -> Column:
    """struct(native, currency, usd); the dollars are rough and rounded to cents, half even."""
    rates = F.create_map(*[F.lit(x) for pair in RATES.items() for x in pair])

    def priced(x: Column) -> Column:
        return F.struct(x["native"].alias("native"), F.when(x["native"].isNotNull(), x["code"]).alias("currency"), F.bround(x["native"] * rates[x["code"]], 2).alias("usd"))

    return F.element_at(F.transform(F.array(F.struct(extract_amount(text).alias("native"), detect_currency(text).alias("code"))), priced), 1)


def mixed_number(token: Column) -> Column:
    """24, 24.5, 24 1/2 and 24½ as a number, else null."""
    t = token
    for glyph, value in FRACTIONS.items():
        t = F.replace(t, F.lit(glyph), F.lit(f" {value}"))
    t = F.trim(t)
    whole = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)(?:\s+(\d+)\s*/\s*(\d+))?$", 1).try_cast("double")
    over, under = (F.regexp_extract(t, r"^(\d+(?:\.\d+)?)(?:\s+(\d+)\s*/\s*(\d+))?$", i).try_cast("double") for i in (2, 3))
    glyphs = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)\s+(\d*\.\d+)$", 1).try_cast("double") + F.regexp_extract(t, r"^(\d+(?:\.\d+)?)\s+(\d*\.\d+)$", 2).try_cast("double")
    return F.coalesce(whole + F.coalesce(F.try_divide(over, under), F.lit(0.0)), glyphs)


def parse_dimensions(text: Column) -> Column:
    """struct(width, height, area) in inches: the first size given in inches, else the first size, centimetres converted; null unless both sides are 0.5 to 600."""
    around = rf"(?is)(.{{0,4}}?){SIZE}(?=(.{{0,12}}))"
    t = text_or_empty(text)
    sizes = F.transform(
        F.arrays_zip(*[F.regexp_extract_all(t, F.lit(around), F.lit(i)).alias(f"g{i}") for i in (1, 2, 3, 4)]),
        lambda m: F.struct(mixed_number(m["g2"]).alias("w"), mixed_number(m["g3"]).alias("h"), F.lower(m["g1"]).alias("head"), F.lower(m["g4"]).alias("tail")),
    )
    marked = F.transform(
        F.filter(sizes, lambda m: (m["w"] > 0) & (m["h"] > 0)),
        lambda m: F.struct(
            (~(m["tail"].contains("cm") | m["head"].contains("cm") | m["tail"].contains("centim")) & (m["tail"].contains('"') | m["tail"].contains("in") | m["head"].rlike("[hw]$"))).alias("inch"),
            (m["tail"].contains("cm") | m["head"].contains("cm") | m["tail"].contains("centim")).alias("cm"), m["w"].alias("w"), m["h"].alias("h"),
        ),
    )
    best = F.coalesce(F.try_element_at(F.filter(marked, lambda m: m["inch"]), F.lit(1)), F.try_element_at(marked, F.lit(1)))
    unit = F.when(best["cm"] & ~best["inch"], 2.54).otherwise(1.0)
    w, h = best["w"] / unit, best["h"] / unit
    good = w.between(0.5, 600) & h.between(0.5, 600)
    return F.when(good, F.struct(F.bround(w, 1).alias("width"), F.bround(h, 1).alias("height"), F.bround(w * h, 1).alias("area")))


def parse_work_year(*texts: Column) -> Column:
    """A year in parentheses in any of the texts, else the first free-standing one from 1850 to 2035."""
    own = [F.regexp_extract(text_or_empty(t), r"(?i)\((?:c(?:irca)?\.?\s*)?((?:18|19|20)\d{2})\)", 1).try_cast("int") for t in texts]
    free = [F.try_element_at(F.filter(F.transform(F.regexp_extract_all(text_or_empty(t), F.lit(r"(?<!\d)((?:18|19|20)\d{2})(?!\d)"), F.lit(1)), lambda y: y.cast("int")), lambda y: y.between(1850, 2035)), F.lit(1)) for t in texts]
    return F.coalesce(*own, *free)


def year_of(value: Column) -> Column:
    """The first run of three or four digits, signed, from 1000 to 2030."""
    y = F.regexp_extract(text_or_empty(value), r"(-?\d{3,4})", 1).try_cast("int")
    return F.when(y.between(1000, 2030), y)


def sane_usd(v: Column) -> Column:
    """Amounts from 0 to 100 mean thousands; what is no number is 0."""
    x = F.coalesce(v.try_cast("double"), F.lit(0.0))
    return F.when((x > 0) & (x < 100), x * 1000).otherwise(x)


def fmv_label(single: Column, low: Column, high: Column) -> Column:
    return F.coalesce(F.when(single > 0, F.format_string("$%,.0f", single)), F.when((low > 0) & (high > 0), F.format_string("$%,.0f–%,.0f", low, high)))
