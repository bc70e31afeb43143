"""Secret scan: three fixed patterns, and random-looking tokens by a battery of randomness tests. Spans, tokens and the ordinary language that every class of tokens is measured by, all by column expressions."""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesignal.llm.common import let, stored

# The base patterns, in the order of their kinds, and the least length of what they must hold.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}+"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Candidates of the battery: runs of so many characters that encodings use.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}+"
SHORTEST = 20
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings by alphabet; the first that has all of a token's characters is inferred.
ENCODINGS = (
    ("digits", DIGITS),
    ("hex", DIGITS + "abcdef"),
    ("HEX", DIGITS + "ABCDEF"),
    ("lower", LOWER),
    ("UPPER", UPPER),
    ("base32", UPPER + "234567"),
    ("base36", DIGITS + LOWER),
    ("BASE36", DIGITS + UPPER),
    ("letters", UPPER + LOWER),
    ("base62", UPPER + LOWER + DIGITS),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
    ("base66", UPPER + LOWER + DIGITS + "+/-_"),
)
#: Share of reported tokens that may be ordinary ones, and bits that a reported token must be able to hold.
RATE, LEAST_BITS = 0.05, 80.0
#: p-values are counted in bins of a quarter nat, the last for all beyond.
BINS = 400
#: Pieces of so many letters at most have the tests' sums written out.
SHORT = 32
#: Sign that stands for an alphabet's first letter.
PLACE = 48


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


SPAN = "struct<at:int,order:int,until:int,kind:string,what:string>"


#: Elements of an array that are summed up in one go; an array grows by copying, so a long one is summed block by block.
RUN = 128


def running(values: Column, combine) -> Column:
    """combine over each beginning of an array (of whole numbers, none of them null): running sums or maxima. Time is in proportion to the array's length up to about a million elements."""

    def scanned(part: Column) -> Column:
        def add(done: Column, x: Column) -> Column:
            last = F.try_element_at(done, F.lit(-1))
            return F.concat(done, F.array(F.when(last.isNull(), x).otherwise(combine(last, x))))

        return F.aggregate(part, _none("int"), add)

    def joined_blocks(blocks: Column) -> Column:
        ends = scanned(F.transform(blocks, lambda b: F.element_at(b, -1)))

        def lifted(e: Column) -> Column:
            return F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: combine(F.get(e, i - 1), x)))))

        return let(ends, lifted)

    def cut(v: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int"))
        return let(F.transform(places, lambda i: scanned(F.slice(v, i * RUN + 1, RUN))), joined_blocks)

    return let(values, lambda v: F.when(F.size(v) == 0, _none("int")).otherwise(cut(v)))


def matches(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as spans in code points, end exclusive, with the group's text; those whose group is shorter than least are left out after matching.

    Between the matches lie the pieces that split gives for the same pattern, so running sums of both lengths are the offsets. Texts without a match skip all this.
    """
    order = KINDS.index(kind)

    def placed(found: Column) -> Column:
        sizes = F.transform(found, lambda m: F.length(m["before"]) + F.length(m["all"]))

        def spans(until: Column) -> Column:
            each = F.transform(found, lambda m, i: F.struct((F.get(until, i) - F.length(m["all"])).alias("at"), F.lit(order).alias("order"), F.get(until, i).alias("until"), F.lit(kind).alias("kind"), m["own"].alias("what")))
            return F.filter(each, lambda s: F.length(s["what"]) >= least) if least else each

        return let(running(sizes, lambda x, y: x + y), spans)

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # split gives one piece more than there are matches: what comes after the last
    found = F.filter(F.arrays_zip(whole.alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("own"), F.split(text, pattern, -1).alias("before")), lambda m: m["all"].isNotNull())
    return F.when(text.rlike(pattern), let(found, placed)).otherwise(_none(SPAN))


def apart_from(tokens: Column, spans: Column) -> Column:
    """The tokens that no span overlaps; spans in order. For each token the spans that begin before its end are found by halving, and the largest end among them is known."""

    def free(at: Column) -> Column:
        def among(until: Column) -> Column:
            def before(end: Column) -> Column:
                """How many spans begin before `end`."""
                steps = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])
                return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.coalesce(F.get(at, n + step - 1) < end, F.lit(False)), n + step).otherwise(n))

            return F.filter(tokens, lambda t: ~let(before(t["until"]), lambda n: (n > 0) & F.coalesce(F.get(until, n - 1) > t["at"], F.lit(False))))

        return let(running(F.transform(spans, lambda s: s["until"]), F.greatest), among)

    return F.when((F.size(spans) == 0) | (F.size(tokens) == 0), tokens).otherwise(let(F.transform(spans, lambda s: s["at"]), free))


def upper_tail(z: Column) -> Column:
    """P(N > z) by the logistic approximation 1.5976 z + 0.070566 z**3; at least 1e-300."""
    y = F.least(F.lit(600.0), F.greatest(F.lit(-600.0), z * 1.5976 + z * z * z * 0.070566))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(y))


def battery(token: Column, alphabet: Column) -> Column:
    """p-value of a token under `independent, uniform over its alphabet`: chi-squared for the symbols' counts, the runs test for high and low symbols, the lag-1 serial correlation; combined by Fisher's method."""
    zero = F.lit(0.0)

    def codes(c: Column) -> Column:
        return F.transform(F.filter(F.split(c["token"], ""), lambda x: x != ""), lambda x: F.position(x, c["alphabet"]).cast("double") - 1)

    def squares(c: Column) -> Column:
        counts = F.transform(F.filter(F.split(c["alphabet"], ""), lambda x: x != ""), lambda x: c["n"] - F.length(F.replace(c["token"], x, F.lit(""))))
        return F.aggregate(counts, zero, lambda a, x: a + x * x)

    def walked(c: Column) -> Column:
        """One walk over the codes: runs of high and low symbols, products with the neighbour, squares."""
        start = F.struct(F.lit(None).cast("double").alias("last"), zero.alias("runs"), zero.alias("cross"), zero.alias("square"))

        def walk(s: Column, x: Column) -> Column:
            changed = s["last"].isNull() | ((s["last"] >= c["k"] / 2) != (x >= c["k"] / 2))
            d = x - c["mean"]
            return F.struct(x.alias("last"), (s["runs"] + F.when(changed, 1.0).otherwise(0.0)).alias("runs"), (s["cross"] + F.coalesce((s["last"] - c["mean"]) * d, zero)).alias("cross"), (s["square"] + d * d).alias("square"))

        return F.aggregate(c["codes"], start, walk)

    def scores(c: Column) -> Column:
        n, k, w, product = c["n"], c["k"], c["walk"], c["product"]
        chi = (c["squares"] * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
        spread = F.sqrt(F.greatest(F.lit(1e-9), product * (product - n) / (n * n * (n - 1))))
        runs = F.when(product == 0, F.lit(8.0)).otherwise((F.abs(w["runs"] - product / n - 1) - 0.5) / spread)
        serial = F.when(w["square"] == 0, F.lit(8.0)).otherwise(F.abs((w["cross"] / w["square"] + 1 / n) * F.sqrt(n)))
        return F.array(F.struct(chi.alias("z"), F.lit(1).alias("sides")), F.struct(runs.alias("z"), F.lit(2).alias("sides")), F.struct(serial.alias("z"), F.lit(2).alias("sides")))

    def fisher(z: Column) -> Column:
        nats = F.aggregate(z, zero, lambda a, x: a - F.ln(F.greatest(F.lit(1e-300), F.least(F.lit(1.0), upper_tail(x["z"]) * x["sides"]))))
        return let(nats, lambda x: F.exp(-F.least(x, F.lit(700.0))) * (1 + x + x * x / 2))

    # each step is bound to a name: expressions in lambdas are computed again wherever they stand
    def step(c: Column, value, name: str, then) -> Column:
        return let(c.withField(name, value(c)), then)

    first = F.struct(token.alias("token"), alphabet.alias("alphabet"), F.length(token).cast("double").alias("n"), F.length(alphabet).cast("double").alias("k"))
    high = lambda c: F.aggregate(c["codes"], zero, lambda a, x: a + F.when(x >= c["k"] / 2, 1.0).otherwise(0.0))
    steps = (("codes", codes), ("squares", squares), ("mean", lambda c: F.aggregate(c["codes"], zero, lambda a, x: a + x) / c["n"]), ("product", lambda c: let(high(c), lambda h: 2 * h * (c["n"] - h))), ("walk", walked))

    def rest(c: Column, i: int = 0) -> Column:
        return step(c, steps[i][1], steps[i][0], lambda d: rest(d, i + 1)) if i < len(steps) else let(scores(c), fisher)

    return let(first, lambda c: rest(c))


def _alphabet(token: Column) -> tuple[Column, Column]:
    """(number of the inferred encoding, its alphabet)."""
    which, letters = F.lit(len(ENCODINGS) - 1), F.lit(ENCODINGS[-1][1])
    for i, (_, alphabet) in reversed(list(enumerate(ENCODINGS[:-1]))):
        fits = F.length(F.translate(token, alphabet, "")) == 0
        which, letters = F.when(fits, i).otherwise(which), F.when(fits, alphabet).otherwise(letters)
    return which, letters


def _bin(token: Column, letters: Column) -> Column:
    nats = -F.ln(F.greatest(F.lit(1e-300), battery(token, letters)))
    return F.least(F.lit(BINS), F.greatest(F.lit(0), F.floor(nats * 4))).cast("int")


def _scored(spans: Column) -> Column:
    """Candidates in their stratum (encoding and half doubling of length), with the bin of -ln p."""

    def one(s: Column) -> Column:
        which, letters = _alphabet(s["what"])

        def inferred(e: Column) -> Column:
            bits = F.length(s["what"]) * F.log2(F.length(e["letters"]).cast("double"))
            stratum = e["which"] * 64 + F.floor(F.log2(F.length(s["what"]).cast("double")) * 2 + 1e-9).cast("int")
            return F.struct(s["at"].alias("at"), s["until"].alias("until"), stratum.alias("stratum"), _bin(s["what"], e["letters"]).alias("bin"), (bits >= LEAST_BITS).alias("able"))

        return let(F.struct(which.alias("which"), letters.alias("letters")), inferred)

    return F.transform(spans, one)


def _spelling(which: int) -> tuple[bool, str, str, int]:
    """How an encoding spells ordinary language: whether with capitals, what stands between words, the place (a sign from PLACE on) of each of LOWER, DIGITS, UPPER and that separator, and the alphabet's size."""
    _, alphabet = ENCODINGS[which]
    both = "a" in alphabet and "Z" in alphabet
    gap = next((c for c in "-/" if c in alphabet), "")
    signs = LOWER + DIGITS + (UPPER if both else "") + gap
    places = "".join(chr(PLACE + alphabet.index(c if c in alphabet else alphabet[i % len(alphabet)])) for i, c in enumerate(signs))
    return both, gap, places, len(alphabet)


def spelled(plain: Column, both: bool, gap: str, places: str) -> Column:
    """A text's ordinary language as an identifier of an encoding would spell it: words run together, with capitals where the alphabet has both cases, with its own separator where it has one; letters that the alphabet lacks are replaced by the alphabet's letter of the same place, counted round. plain holds ASCII only. The letters are told by their places (see _spelling)."""
    words = F.lower(plain)
    if both:
        words = F.array_join(F.transform(F.split(plain, r"[\x00-\x20]"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1 << 30)))), " ")
    if gap:
        words = F.regexp_replace(words, "[^A-Za-z0-9]+", gap)
    signs = LOWER + DIGITS + (UPPER if both else "") + gap
    # signs that have no place are taken out
    return F.translate(words, signs + "".join(chr(c) for c in range(128) if chr(c) not in signs), places)


def pieces(letters: Column, n: int) -> Column:
    """Pieces of n letters that cover a text without a gap: end to end from its beginning, and what is left over by one that ends with the text. Texts of fewer letters have none."""
    size = F.length(letters)
    last = F.when((size > n) & (size % n > 0), F.array(F.right(letters, F.lit(n)))).otherwise(_none("string"))
    return F.concat(F.regexp_extract_all(letters, F.lit(f".{{{n}}}"), F.lit(0)), last)


def _plus(terms: list[str]) -> Column:
    """A sum of SQL terms, halved again and again, so that it does not nest deeply."""

    def summed(own: list[str]) -> str:
        half = len(own) // 2
        return f"({summed(own[:half])} + {summed(own[half:])})" if half else own[0]

    return F.expr(summed(terms))


def short_sums(longest: int) -> dict[str, Column]:
    """The sums that the tests take over a piece of `longest` letters at most, written out letter by letter (see short_letters): compiled, they take a small part of the time that lambdas would take."""
    x = [f"x{i}" for i in range(longest)]
    own = [f"greatest({a}, 0)" for a in x]
    near = list(zip(x[:-1], x[1:], strict=True))
    return {
        # the squares of the symbols' counts: every letter with itself, and twice each pair of equal letters
        "squares": F.col("n") + 2 * _plus([f"int({a} = {b})" for i, a in enumerate(x) for b in x[:i]]),
        "highs": _plus([f"int(2 * {a} >= k)" for a in x]),
        "changes": _plus([f"int((2 * {a} >= k) <> (2 * {b} >= k) and {b} >= 0)" for a, b in near]),
        "total": _plus(own),
        "square": _plus([f"{a} * {a}" for a in own]),
        "cross": _plus([f"{a} * {b}" for a, b in zip(own[:-1], own[1:], strict=True)]),
    }


def short_letters(longest: int) -> list[Column]:
    """A column for each letter's place; beyond a piece's end numbers below 0 that are all different, so that they equal nothing."""
    return [F.expr(f"coalesce(ascii(get(letters, {i})) - {PLACE}, {-1 - i})").alias(f"x{i}") for i in range(longest)]


def long_sums() -> dict[str, Column]:
    """short_sums for pieces of any length, by lambdas."""
    zero, n = F.lit(0).cast("long"), F.col("n")
    codes = F.transform("letters", lambda x: F.ascii(x) - PLACE)
    added = lambda values: F.aggregate(values, zero, lambda a, x: a + x)
    near = lambda c, each: F.zip_with(F.slice(c, 1, n - 1), F.slice(c, 2, n - 1), each)
    high = lambda x: 2 * x >= F.col("k")

    def alike(s: Column, x: Column) -> Column:
        """One walk over the ordered letters: how many like the last, and the counts' squares."""
        run = F.when(s["last"] == x, s["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(x.alias("last"), run.alias("run"), (s["squares"] + 2 * run - 1).alias("squares"))

    start = F.struct(F.lit(-1).alias("last"), zero.alias("run"), zero.alias("squares"))
    return {
        "squares": F.aggregate(F.sort_array(codes), start, alike)["squares"],
        "highs": added(F.transform(codes, lambda x: high(x).cast("int"))),
        "changes": let(codes, lambda c: added(near(c, lambda a, b: (high(a) != high(b)).cast("int")))),
        "total": added(codes),
        "square": added(F.transform(codes, lambda x: x * x)),
        "cross": let(codes, lambda c: added(near(c, lambda a, b: a * b))),
    }


def _sum_bins(sums: DataFrame) -> DataFrame:
    """(spelling, n, bin) from the tests' sums, as in battery and _bin."""
    n, k, product = F.col("n").cast("double"), F.col("k"), F.col("product")
    chi = (F.col("squares") * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
    spread = F.sqrt(F.greatest(F.lit(1e-9), product * (product - n) / (n * n * (n - 1))))
    runs = F.when(product == 0, F.lit(8.0)).otherwise((F.abs(F.col("changes") - product / n) - 0.5) / spread)
    serial = F.when(F.col("square") == 0, F.lit(8.0)).otherwise(F.abs((F.col("cross") / F.col("square") + 1 / n) * F.sqrt(n)))
    # about the mean, the squares' sum is the sum of squares less n times the mean's
    mean = F.col("total") / n
    centred = sums.select("spelling", "n", "k", "squares", "changes", (2 * F.col("highs") * (n - F.col("highs"))).alias("product"), ((F.col("square") * n - F.col("total") * F.col("total")) / n).alias("square"), (F.col("cross") - mean * (2 * F.col("total") - F.col("ends")) + (n - 1) * mean * mean).alias("cross"))
    z = centred.select("spelling", "n", chi.alias("chi"), runs.alias("runs"), serial.alias("serial"))
    tail = lambda name, sides: -F.ln(F.greatest(F.lit(1e-300), F.least(F.lit(1.0), upper_tail(F.col(name)) * sides)))
    nats, x = F.col("nats"), F.least(F.col("nats"), F.lit(700.0))
    p = z.select("spelling", "n", (tail("chi", 1) + tail("runs", 2) + tail("serial", 2)).alias("nats")).select("spelling", "n", (F.exp(-x) * (1 + nats + nats * nats / 2)).alias("p"))
    return p.select("spelling", "n", F.least(F.lit(BINS), F.greatest(F.lit(0), F.floor(-F.ln(F.greatest(F.lit(1e-300), F.col("p"))) * 4))).cast("int").alias("bin"))


def least_length(stratum: int) -> int:
    """The shortest token of a stratum."""
    return max(SHORTEST, math.ceil(2 ** (stratum % 64 / 2) - 1e-6))


def ordinary_counts(docs: DataFrame, strata: list[int], text: str = "text") -> DataFrame:
    """(stratum, bin, n): how random ordinary language looks to the battery, in each stratum. Every text is spelled whole in the stratum's encoding and cut without a gap into pieces as short as the stratum's tokens can be (see spelled, pieces); all of them are counted. Encodings that spell alike are counted once."""
    classes: dict[tuple, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for s in strata:
        classes[_spelling(s // 64)][least_length(s)].append(s)
    spellings = list(classes.items())
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    plain = docs.select(F.when(F.length(body) == F.octet_length(body), body).otherwise(F.regexp_replace(body, r"[^\x00-\x7F]+", "\x7f")).alias("plain"))
    # the lambda keeps what is written out letter by letter from being compiled into one method with its neighbours, which would be too long for the JVM
    k = let(F.col("k"), lambda k: k.cast("double")).alias("k")
    ends = F.ascii(F.left("piece", F.lit(1))) + F.ascii(F.right("piece", F.lit(1))) - 2 * PLACE

    def of_lengths(lengths: list[int]) -> DataFrame:
        texts = F.array(*[F.struct(F.lit(i).alias("spelling"), F.lit(k).alias("k"), spelled(F.col("plain"), *how).alias("letters")) for i, ((*how, k), own) in enumerate(spellings) if set(own) & set(lengths)])

        def cut(n: int) -> Column:
            asked = F.col("x.spelling").isin([i for i, (_, own) in enumerate(spellings) if n in own])
            each = F.transform(pieces(F.col("x.letters"), n), lambda p: F.struct(F.lit(n).alias("n"), p.alias("piece")))
            return F.when(asked, each).otherwise(_none("struct<n:int,piece:string>"))

        rows = plain.select(F.explode(texts).alias("x")).select("x.spelling", "x.k", F.explode(F.concat(*map(cut, lengths))).alias("y"))
        rows = rows.select("spelling", "k", "y.n", "y.piece").select("spelling", "k", "n", ends.alias("ends"), F.split("piece", "").alias("letters"))
        if max(lengths) <= SHORT:
            rows, sums = rows.select("spelling", "k", "n", "ends", *short_letters(max(lengths))), short_sums(max(lengths))
        else:
            sums = long_sums()
        return _sum_bins(rows.select("spelling", k, "n", "ends", *[c.alias(name) for name, c in sums.items()]))

    lengths = sorted({n for _, own in spellings for n in own})
    parts = [own for own in ([n for n in lengths if n <= SHORT], [n for n in lengths if n > SHORT]) if own]
    counts = reduce(DataFrame.unionAll, map(of_lengths, parts)).groupBy("spelling", "n", "bin").count()
    alike = F.create_map(*[x for i, (_, own) in enumerate(spellings) for n in own for x in (F.lit(f"{i} {n}"), F.array(*map(F.lit, own[n])))])
    return counts.select(F.explode(F.element_at(alike, F.concat_ws(" ", F.col("spelling").cast("string"), F.col("n").cast("string")))).alias("stratum"), "bin", F.col("count").alias("n"))


def discoveries(candidates: list[tuple[int, int, int]], ordinary: list[tuple[int, int, int]], rate: float = RATE) -> dict[int, int]:
    """By stratum the last bin that is reported, -1 for none, from (stratum, bin, number) of all candidates and of all ordinary pieces.

    The null hypothesis is that a token is ordinary. Its p-value is the share of ordinary pieces (counting one more) that look as random as it does or more; Benjamini and Hochberg's procedure over the stratum's candidates reports the largest set in which `rate` at most are expected to be ordinary.
    """
    by: tuple[dict, dict] = (defaultdict(dict), defaultdict(dict))
    for held, rows in zip(by, (candidates, ordinary), strict=True):
        for stratum, b, n in rows:
            held[stratum][b] = n
    out = {}
    for stratum, bins in by[0].items():
        null = by[1][stratum]
        total, pieces = sum(bins.values()), sum(null.values())
        found = looks = 0
        out[stratum] = -1
        for b in range(BINS + 1):
            found += bins.get(b, 0)
            looks += null.get(b, 0)
            if found and total * (1 + looks) / (1 + pieces) <= rate * found:
                out[stratum] = b
    return out


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """A row for each row of docs: doc_id, base and random, both arrays of (at, order, until, kind, what or null).

    base: every match of the three patterns in the whole text. random: tokens outside base spans that look more random than ordinary language does. Each token is tested under the alphabet it seems to be in. What the battery says of ordinary tokens is counted on the table's own language, all of it, spelled in the same alphabet and cut as short as the length class allows (see ordinary_counts, discoveries); within encoding and length class at most `rate` of the reported tokens are expected to be ordinary. A token too short to hold LEAST_BITS is never reported. The counts that this needs are 401 bins for each of at most 13 * 62 classes.

    Null texts count as empty and give empty arrays; repeated rows each get a row; other columns are ignored.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = F.array_sort(F.concat(matches(body, ASSIGN, "assign", 2, LEAST["assign"]), matches(body, ACCESS, "access", 0, LEAST["access"]), matches(body, HEX, "hex")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), base.alias("base"), _scored(matches(body, CANDIDATE, "random")).alias("tokens"))
    rows = stored(rows.select("doc_id", "base", apart_from(F.col("tokens"), F.col("base")).alias("tokens")), "secrets")
    counts = [tuple(r) for r in rows.select(F.explode("tokens").alias("t")).groupBy("t.stratum", "t.bin").count().collect()]
    strata = sorted({c[0] for c in counts})
    ordinary = [tuple(r) for r in ordinary_counts(docs, strata, text).collect()] if strata else []
    cuts = discoveries(counts, ordinary, rate)
    cut = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair]) if cuts else F.expr("cast(map() as map<int,int>)")
    kept = F.filter("tokens", lambda t: t["able"] & (t["bin"] <= F.try_element_at(cut, t["stratum"])))
    order = F.lit(KINDS.index("random"))
    random = F.transform(kept, lambda t: F.struct(t["at"].alias("at"), order.alias("order"), t["until"].alias("until"), F.lit("random").alias("kind"), F.lit(None).cast("string").alias("what")))
    return rows.select("doc_id", "base", random.alias("random"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["until"].cast("string"))), ",")


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text with every span replaced by <kind>; overlapping spans become one, named by the first."""
    spans = secret_scan(docs, doc_id, text).select(F.col("doc_id").alias("_doc"), F.array_sort(F.concat("base", "random")).alias("_spans")).dropDuplicates(["_doc"])
    both = docs.join(spans, F.col(doc_id) == F.col("_doc"), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    body = F.coalesce(F.col(text), F.lit(""))

    def cut(s: Column, x: Column) -> Column:
        gap = F.substring(body, s["at"] + 1, F.greatest(x["at"] - s["at"], F.lit(0)))
        named = F.concat(s["out"], gap, F.lit("<"), x["kind"], F.lit(">"))
        return F.struct(F.greatest(x["until"], s["at"]).alias("at"), F.when(x["at"] < s["at"], s["out"]).otherwise(named).alias("out"))

    done = let(F.aggregate(F.coalesce("_spans", _none(SPAN)), start, cut), lambda s: F.concat(s["out"], F.substring(body, s["at"] + 1, F.length(body))))
    return both.select(F.col(doc_id).alias("doc_id"), F.when(F.size(F.coalesce("_spans", _none(SPAN))) > 0, done).otherwise(F.col(text)).alias("text"))
