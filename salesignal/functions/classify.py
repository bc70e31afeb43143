"""Classes, gates and scores of lots, works, artists and galleries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesignal.functions.keys import text_or_empty

# Patterns of work classes and media, in the order in which they are tried.
EDITION = r"(?i)print|giclee|giclée|litho|serigraph|etching|engraving|poster|reproduction|offset|\b\d{1,4}\s*/\s*\d{1,4}\b"
EDITION_MARK = r"(?<![A-Za-z])(?:LE|L\.E\.?|AP|A\.P\.?)(?![A-Za-z])"
UNIQUE = r"(?i)\boil\b|watercolor|watercolour|acrylic|gouache|pastel|charcoal|mixed media|on canvas|on board|on panel|bronze|carving|sculpture"
MEDIA = (
    ("print", r"(?i)\b(print|lithograph|litho|serigraph|screen ?print|silk ?screen|etching|engraving|aquatint|woodcut|linocut|giclee|giclée|offset|edition of|\b\d{1,4}\s*/\s*\d{1,4}\b)"),
    ("sculpture", r"(?i)\b(sculpture|bronze|cast|carv|marble|terracotta|maquette|welded|patina)"),
    ("photograph", r"(?i)\b(photograph|gelatin silver|c-?print|chromogenic|platinum print|albumen|daguerreo|type c)"),
    ("painting", r"(?i)\b(oil|acrylic|tempera|enamel|encaustic|alkyd)\b|on canvas|on panel|on board|on masonite"),
    ("work_on_paper", r"(?i)\b(watercolou?r|gouache|pastel|charcoal|graphite|pen and ink|\bink\b|drawing|crayon|conté|conte)\b|on paper"),
    ("textile", r"(?i)\b(tapestry|textile|needlework|embroider|quilt|weaving)"),
)
BIG_HOUSES = ("christie", "sotheby", "phillips")
SKIPPED = ("print*", "giclee*", "poster*", "reproduction*", "etching*", "litho*", "limited edition", "attributed to", "after", "manner of", "school of", "style of", "circle of", "follower of")
SKIP_MARK = r"(?<![A-Za-z])(?:LE|L\.E\.?)(?![A-Za-z])"
ART_SALE = r"(?i)fine art|gallery|galleries|estate|antique|painting|artwork|art auction|collection|artist|decorative arts|americana|folk art"
STRONG_ART = (
    "oil on canvas|oil on board|oil on panel|oil painting|acrylic on|acrylic painting|watercolor|watercolour|gouache|tempera|lithograph|serigraph|silkscreen|screenprint|etching|engraving|"
    "woodblock|woodcut|linocut|aquatint|monotype|monoprint|giclee|giclée|pastel on|pastel drawing|charcoal drawing|mixed media on|collage on|signed lower|signed upper|signed and numbered|"
    "artist proof|artist's proof|sculpture|bronze sculpture|marble sculpture|original painting|framed painting|oil sketch|still life|landscape painting|portrait painting|abstract painting|"
    "folk art|outsider art|works on paper|limited edition print|fine art|hand colored|hand-colored|plein air|canvas board|stretched canvas|art glass"
)
ATTRIBUTION = (
    r"(?i)\(\s*(?:b\.\s*)?1[6-9]\d{2}\s*[-–]\s*(?:1[6-9]|20)?\d{0,2}\s*\)|\battributed to\b|\bafter [A-Z]|\bmanner of\b|\bschool of\b|\bcircle of\b|\bfollower of\b|\billus(?:trated)? by\b|"
    r",\s*(?:American|French|British|German|Italian|Dutch|Spanish|Mexican|Canadian|Russian|Japanese|Chinese)\s*,"
)
HARD_NEGATIVE = (
    "vehicle|truck|tractor|trailer|mower|atv|utv|forklift|firearm|ammo|ammunition|rifle|pistol|shotgun|tool|drill|saw |wrench|socket set|compressor|appliance|refrigerator|washer|dryer|hvac|"
    "gift card|coupon|pallet of|shelf of|box lot of hardware"
)
LIQUIDATION = (
    "liquidation|overstock|unclaimed|returned parcel|returns auction|online return|amazon return|shelf pull|surplus|freight|truckload|box lot auction|bin store|wholesale|pallet|closeout|"
    "dollar store|flea market|storage unit|self storage|mini storage"
)
BLUE_CHIP = (
    r"(?i)\b(van gogh|monet|manet|picasso|dali|renoir|rembrandt|matisse|degas|cezanne|c[ée]zanne|gauguin|chagall|modigliani|klimt|schiele|kandinsky|miro|mir[óo]|magritte|warhol|basquiat|haring|"
    r"pollock|rothko|de kooning|lichtenstein|banksy|kahlo|vermeer|caravaggio|goya|toulouse.?lautrec|munch|hockney|kusama)\b"
)
FIRMS = (
    "currier|ives|precious moments|goebel|hummel|lladro|royal doulton|wedgwood|lenox|franklin mint|bradford exchange|disney|warner bros|hallmark|department 56|swarovski|tiffany studios|roseville|"
    r"weller|van briggle|fenton| inc| llc| ltd| co\.|& sons|& co|company|studios|pottery|porcelain works|manufactory|foundry|mint"
)
GALLERY_TIERS = (
    "gagosian|hauser & wirth|hauser and wirth|david zwirner|zwirner|pace gallery|pace|white cube|thaddaeus ropac|ropac|lévy gorvy|levy gorvy|gladstone|marian goodman|sprüth magers|spruth magers|victoria miro",
    "jack shainman|james cohan|perrotin|casey kaplan|kavi gupta|blum & poe|blum and poe|lehmann maupin|lisson|matthew marks|sean kelly|regen projects|goodman gallery|kasmin|petzel|andrew kreps|anton kern|"
    "luhring augustine|paula cooper|salon 94|tanya bonakdar",
    r"p·p·o·w|ppow|p\.p\.o\.w|denny dimin|denny gallery|anna zorina|various small fires|vsf|nicelle beauchene|jack hanley|kate werble|night gallery|the hole|steve turner|de boer|shulamit nazarian|"
    "charles moffett|half gallery",
)
NO_GALLERY = "auction|benefit|phillips|christie|sotheby|bonhams|freeman|heritage|swann|museum|artadia|biennial|fair|foundation"
MARKET_FLOOR, FLAG_RATIO, FLAG_HIGH, INSTITUTION_BID = 2000.0, 8.0, 400.0, 100.0


def work_class(title: Column, marks: bool = True) -> Column:
    """edition, unique or unknown; edition wins. Without marks the upper-case edition tokens are not looked at, as in enriched comparables."""
    t = text_or_empty(title)
    edition = t.rlike(EDITION) | t.rlike(EDITION_MARK) if marks else t.rlike(EDITION)
    return F.when(edition, "edition").when(t.rlike(UNIQUE), "unique").otherwise("unknown")


def medium_category(*texts: Column) -> Column:
    blob = F.lower(F.concat_ws(" ", *[text_or_empty(t) for t in texts]))
    out = F.lit("other")
    for name, pattern in reversed(MEDIA):
        out = F.when(blob.rlike(pattern), name).otherwise(out)
    return out


def venue_tier(house: Column) -> Column:
    return F.when(F.lower(text_or_empty(house)).rlike("|".join(BIG_HOUSES)), "big3").otherwise("mid")


def skip_pattern(terms: Sequence[str] = SKIPPED) -> str:
    """Terms that end in * match beginnings of words, others whole words; case does not matter."""
    return "(?i)" + "|".join(rf"\b\Q{t[:-1]}\E\w*" if t.endswith("*") else rf"\b\Q{t}\E\b" for t in terms)


def skip_lot(title: Column, terms: Sequence[str] = SKIPPED) -> Column:
    t = text_or_empty(title)
    return t.rlike(skip_pattern(terms)) | t.rlike(SKIP_MARK)


def is_art_sale(title: Column, house: Column) -> Column:
    return F.concat_ws(" ", text_or_empty(title), text_or_empty(house)).rlike(ART_SALE)


def strong_art(title: Column, detail: Column) -> Column:
    """Unambiguous vocabulary in the title or the first 300 characters of the detail, or an attribution in the title."""
    t, d = text_or_empty(title), F.substring(text_or_empty(detail), 1, 300)
    return F.lower(t).rlike(STRONG_ART) | t.rlike(ATTRIBUTION) | F.lower(d).rlike(STRONG_ART)


def passes_density(title: Column, detail: Column, density: Column, auction_title: Column, auction_house: Column, least: float = 0.02) -> Column:
    """Whether a lot is screened: empty and non-art lots never, explicit art always, lots of liquidations never, the rest where the sale's share of art is `least` or more."""
    t = F.lower(text_or_empty(title))
    liquidation = F.lower(F.concat_ws(" ", text_or_empty(auction_title), text_or_empty(auction_house))).rlike(LIQUIDATION)
    return F.when(F.trim(t) == "", False).when(t.rlike(HARD_NEGATIVE), False).when(strong_art(title, detail), True).when(liquidation, False).otherwise(F.coalesce(density >= least, F.lit(False)))


def is_firm(name: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.lower(text_or_empty(name))), F.lit(" ")).rlike(FIRMS)


def gallery_tier(name: Column) -> Column:
    """1 to 3 by known names, 0 for none and for what is no gallery."""
    n = F.lower(text_or_empty(name))
    out = F.lit(0)
    for tier, names in reversed(list(enumerate(GALLERY_TIERS, 1))):
        out = F.when(n.rlike(names), tier).otherwise(out)
    return F.when(n.rlike(NO_GALLERY), 0).otherwise(out)


def score_tier(score: Column) -> Column:
    return F.when(score >= 7.5, "A").when(score >= 5.0, "B").otherwise("C")


def checker_tier(amount: Column, market_hits: Column, historical_hits: Column, results: Column) -> Column:
    some = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    return F.when(amount >= MARKET_FLOOR, "strong").when((amount > 0) | some(market_hits) | some(historical_hits), "listed").when(results > 0, "minor").otherwise("none")


def standing(papers: Column, museums: Column, awards: Column) -> Column:
    """strong: papers, three major museums or an award; listed: one museum; else null, which is neutral."""
    return F.when((F.coalesce(papers, F.lit(0)) > 0) | (museums >= 3) | (F.coalesce(awards, F.lit(0)) > 0), "strong").when(museums >= 1, "listed")


def is_suspect(price: Column, outcome: Column, ceiling: Column, least_ceiling: float = 10_000, most_price: float = 500, share: float = 0.01) -> Column:
    """A sale far beneath a strong market."""
    return F.coalesce(outcome.isin("sold", "final_bid") & (price > 0) & (ceiling >= least_ceiling) & (price < most_price) & (price < ceiling * share), F.lit(False))


def flag_lot(tier: Column, high: Column, bid: Column) -> Column:
    return F.coalesce(tier.isin("strong", "listed") & (high >= FLAG_HIGH), F.lit(False)) & (bid.isNull() | (bid <= 0) | (high >= bid * FLAG_RATIO))


def flag_institution(standing: Column, bid: Column) -> Column:
    return F.coalesce(standing == "strong", F.lit(False)) & (bid.isNull() | (bid <= INSTITUTION_BID))


def significance(name: Column, standing: Column, collections: Column, tier: Column, ceiling: Column) -> Column:
    """Reasons joined by ` + `; empty: not significant. Firms never are."""
    museum = F.when(standing == "strong", "museum").when(standing.isNotNull(), "listed").when(collections > 0, "museum (collections)")
    why = F.concat_ws(" + ", museum, F.when(tier.between(1, 3), F.concat(F.lit("gallery T"), tier.cast("string"))), F.when(ceiling >= MARKET_FLOOR, F.format_string("auction $%,.0f", ceiling)))
    return F.when(is_firm(name), "").otherwise(why)


def mass_edition(text: Column, least: int = 500) -> Column:
    return F.coalesce(F.regexp_extract(text_or_empty(text), r"\b\d{1,5}\s*/\s*(\d{2,6})\b", 1).try_cast("int") >= least, F.lit(False))


def escalates(uncertain: Column, signed: Column, labelled: Column, promise: Column) -> Column:
    """What cannot be read counts as promising."""
    return (F.coalesce(uncertain, F.lit(0)) == 1) | (F.coalesce(signed, F.lit(0)) == 1) | (F.coalesce(labelled, F.lit(0)) == 1) | F.coalesce(promise.try_cast("double") >= 5.0, F.lit(True))


def parse_tile(text: Column) -> Column:
    """struct(high_bid, realized, bids, estimate) from a tile's text."""
    number = lambda p: F.regexp_replace(F.regexp_extract(text_or_empty(text), p, 1), ",", "").try_cast("double")
    estimate = F.regexp_extract(text_or_empty(text), r"(?i)([\d,.]+\s*-\s*[\d,.]+\s*USD)", 1)
    return F.struct(
        number(r"(?i)(?:High Bid|Current Bid)[:\s]*([\d,.]+)\s*USD").alias("high_bid"),
        number(r"(?i)Price Realized[:\s]*([\d,.]+)\s*USD").alias("realized"),
        F.regexp_extract(text_or_empty(text), r"(?i)(\d+)\s+Bids?", 1).try_cast("int").alias("bids"),
        F.when(estimate != "", estimate).alias("estimate"),
    )


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), "<[^>]+>", " ")


def json_object(text: Column) -> Column:
    """The text from the first opening to the last closing brace; null without one."""
    found = F.regexp_extract(text_or_empty(text), r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def sale_id(ref: Column) -> Column:
    """The last all-digit segment of a sale's address, or the number itself; null for other hosts."""
    last = F.try_element_at(F.filter(F.split(ref, r"[/?#]"), lambda s: s.rlike(r"^\d+$")), F.lit(-1))
    return F.when(ref.rlike(r"^\d+$") | ref.contains("estatesales.net"), last.try_cast("bigint"))


def keyword_score(text: Column, keywords: Sequence[str]) -> Column:
    hits = sum((F.lower(text_or_empty(text)).contains(k).cast("int") for k in keywords), F.lit(0))
    return F.least(F.lit(100), hits * 12)


def call_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Dollars of a model call; a model without a price costs 5 and 25 a million tokens."""
    return (tokens_in * F.coalesce(price_in, F.lit(5.0)) + tokens_out * F.coalesce(price_out, F.lit(25.0))) / 1e6
