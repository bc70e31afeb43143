"""Line dedup by content-defined chunks of lines. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesignal.llm.common import dealt_join, let, salted_join, stored

#: Lines that the rolling hash covers, and lines in a chunk on average.
WINDOW, LINES = 2, 3
LOW = (1 << 32) - 1


def chunk_codes(lines: Column, window: int = WINDOW, average: int = LINES) -> Column:
    """Chunks of an array of lines as whole numbers: first line (from 1) * 2**32 + number of lines.

    A chunk ends after a line where the rolling hash of the last `window` lines is the least among those of `average` lines around it (the first of equal ones), and at the end. So a chunk has more than (average - 1) / 2 lines, two at least, except in a shorter text. Nothing outside these lines counts, so an inserted or removed line moves only the boundaries next to it.
    """
    near = max(1, (average - 1) // 2)

    def bounded(h: Column) -> Column:
        n = F.size(h)

        def rolled(i: Column) -> Column:
            out = F.element_at(h, i)
            for back in range(1, window):
                out = out.bitwiseXOR(F.when(i > back, F.shiftleft(F.element_at(h, F.greatest(i - back, F.lit(1))), 7 * back)).otherwise(F.lit(0)))
            return out

        def least(r: Column, i: Column) -> Column:
            out = (i > near) & (i < n - near)
            for d in range(1, near + 1):
                out = out & (F.get(r, i - 1) < F.get(r, i - 1 - d)) & (F.get(r, i - 1) <= F.get(r, i - 1 + d))
            return out

        places = F.sequence(F.lit(1), n)
        ends = let(F.transform(places, rolled), lambda r: F.filter(places, lambda i: (i == n) | least(r, i)))
        return let(ends, lambda e: F.transform(F.arrays_zip(F.concat(F.array(F.lit(0)), F.slice(e, 1, F.size(e) - 1)).alias("a"), e.alias("b")), lambda x: F.shiftleft((x["a"] + 1).cast("long"), 32).bitwiseOR((x["b"] - x["a"]).cast("long"))))

    return let(F.transform(lines, lambda line: F.xxhash64(line)), bounded)


def first_line(code: Column) -> Column:
    return F.shiftright(code, 32).cast("int")


def n_lines(code: Column) -> Column:
    return code.bitwiseAND(F.lit(LOW)).cast("int")


def _text(lines: Column, code: Column) -> Column:
    return F.array_join(F.slice(lines, first_line(code), n_lines(code)), "\n")


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)


def _row_key(doc_id: str, text: str) -> list[Column]:
    """What tells rows apart: doc_id, and hash and length of the text, since rows with one doc_id may differ."""
    return [F.col(doc_id).alias("_doc"), F.xxhash64(F.col(text).cast("string")).alias("_hash"), F.octet_length(F.col(text).cast("string")).alias("_bytes")]


ROW = ["_doc", "_hash", "_bytes"]


NO_CODES = "cast(array() as array<bigint>)"


def _code(first: Column, n: Column) -> Column:
    return F.shiftleft(first.cast("long"), 32).bitwiseOR(n.cast("long"))


def _agreeing(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common from their beginnings on."""
    places = F.filter(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda i: ~F.coalesce(F.get(a, i).eqNullSafe(F.get(b, i)) & (i < F.size(a)), F.lit(False)))
    return F.element_at(places, 1)


def repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, average: int = LINES) -> DataFrame:
    """(_doc, _hash, _bytes, _removed, _beside): codes of each row's chunks of two lines or more that occur elsewhere and are not their text's first occurrence, by doc_id, row and line; and codes of the lines next to these chunks that, byte for byte and without a gap, stand next to the first occurrence, too.

    A repeated passage seldom begins and ends where chunks do; the lines beside its chunks belong to the chunk that reaches over its edge and, as a boundary hangs on the lines around it, to the next, so two chunks on each side are compared line by line. Hashes and lengths of all chunks are counted first, in rows of 56 bytes; only chunks that then seem repeated are cut out of the texts, each with its neighbours, and they are grouped by their bytes, so a chance meeting of hashes removes nothing. Counts and first places are grouped in the tasks before they are shuffled, and the rows of a very common chunk are dealt over several tasks.
    """
    rows = docs.select(*_row_key(doc_id, text), F.col(text).cast("string").alias("text")).filter("_doc is not null and text is not null")
    lines = _lines("text")

    def described(x: Column, codes: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            before, after = (sum((F.coalesce(n_lines(F.get(codes, i + d)), F.lit(0)) for d in places), F.lit(0)) for places in ((-1, -2), (1, 2)))
            return let(_text(x, c), lambda t: F.struct(c.alias("code"), F.xxhash64(t).alias("hash"), F.octet_length(t).alias("size"), before.alias("before"), after.alias("after")))

        return F.filter(F.transform(codes, one), lambda c: n_lines(c["code"]) > 1)

    hashed = let(lines, lambda x: let(chunk_codes(x, window, average), lambda codes: described(x, codes)))
    chunks = stored(rows.select(*ROW, F.explode(hashed).alias("c")).select(*ROW, "c.*"), "chunks")
    total = chunks.count()
    again = stored(chunks.groupBy("hash", "size").agg(F.count("*").alias("_n")).filter("_n > 1"), "again")
    asked = salted_join(chunks, again.withColumn("n", F.col("_n")), ["hash", "size"], total).groupBy(*ROW).agg(F.collect_set(F.struct("code", "hash", "size", "n", "before", "after")).alias("asked"))

    def cut(x: Column) -> Column:
        def each(chunks: Column) -> Column:
            def one(c: Column, i: Column) -> Column:
                first, n = first_line(c["code"]), n_lines(c["code"])
                last, following = F.get(chunks, i - 1), F.get(chunks, i + 1)
                # beside a chunk that is as common there is nothing to compare: it goes along and is looked at itself
                before = F.when(F.coalesce((first_line(last["code"]) + n_lines(last["code"]) == first) & (last["n"] >= c["n"]), F.lit(False)), 0).otherwise(c["before"])
                after = F.when(F.coalesce((first_line(following["code"]) == first + n) & (following["n"] >= c["n"]), F.lit(False)), 0).otherwise(c["after"])
                # what stands before is held from its last line on, as it is compared
                return F.struct(*[c[f].alias(f) for f in ("code", "hash", "size", "n")], _text(x, c["code"]).alias("chunk"), F.reverse(F.slice(x, first - before, before)).alias("before"), F.slice(x, first + n, after).alias("after"))

            return F.transform(chunks, one)

        return let(F.array_sort("asked"), each)

    # chunks are cut out before they become rows, so that none of these rows holds the whole text
    met = rows.join(asked, ROW).select(*ROW, F.explode(let(lines, cut)).alias("c"))
    seen = stored(met.select(*ROW, "c.*"), "repeated")
    place = F.struct(*ROW, "code")
    groups = seen.groupBy("hash", "size", "n", "chunk").agg(F.min(F.struct(place.alias("place"), "before", "after")).alias("first"), F.count("*").alias("met")).filter("met > 1").withColumn("_n", F.col("n"))
    later = dealt_join(seen, groups, ["hash", "size", "n", "chunk"], F.col("n"), total).filter(place != F.col("first.place"))
    first, n = first_line(F.col("code")), n_lines(F.col("code"))
    later = later.select(*ROW, "code", _agreeing(F.col("before"), F.col("first.before")).alias("b"), _agreeing(F.col("after"), F.col("first.after")).alias("a"), first.alias("at"), n.alias("lines"))
    beside = F.filter(F.array(_code(F.col("at") - F.col("b"), F.col("b")), _code(F.col("at") + F.col("lines"), F.col("a"))), lambda c: n_lines(c) > 0)
    return later.groupBy(*ROW).agg(F.collect_set("code").alias("_removed"), F.array_distinct(F.flatten(F.collect_list(beside))).alias("_beside"))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, average: int = LINES) -> DataFrame:
    """docs with the text cleaned, and n_lines, n_chunks, removed_chunks, removed_lines.

    Of equal chunks of two lines or more in the whole table the first stays, and so do the lines next to it; of a later one, lines beside it that are those beside the first go with it (they count in removed_lines). A null text is no line and stays null; an empty one is a line without characters. Rows without doc_id stay as they are and count nowhere. Rows that repeat doc_id and text are one document; rows with one doc_id and different texts are different ones, in order of the texts' hashes. Columns of docs with those names are replaced, all others kept.
    """
    removed = repeated_chunks(docs, doc_id, text, window, average)
    private = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    own = docs.toDF(*private.values())
    own = own.select("*", *_row_key(private[doc_id], private[text])).join(removed, ROW, "left")
    body = F.col(private[text]).cast("string")
    gone, beside = (F.coalesce(c, F.expr(NO_CODES)) for c in ("_removed", "_beside"))

    def cleaned(x: Column) -> Column:
        def kept(codes: Column) -> Column:
            def without(lost: Column) -> Column:
                stay = F.array_except(F.sequence(F.lit(1), F.size(x)), lost)
                return F.struct(F.size(x).cast("long").alias("n_lines"), F.size(codes).cast("long").alias("n_chunks"), F.size(F.array_intersect(codes, gone)).cast("long").alias("removed_chunks"), F.size(lost).cast("long").alias("removed_lines"), F.array_join(F.transform(stay, lambda i: F.element_at(x, i)), "\n").alias("text"))

            # lines next to two chunks may be named twice
            each = F.transform(F.concat(gone, beside), lambda c: F.sequence(first_line(c), first_line(c) + n_lines(c) - 1))
            return let(F.array_distinct(F.flatten(each)), without)

        return let(chunk_codes(x, window, average), kept)

    c = F.col("_clean")
    out = own.withColumn("_clean", let(_lines(private[text]), cleaned))
    new = {n: F.when(body.isNull(), F.lit(0).cast("long")).otherwise(c[n]).alias(n) for n in ("n_lines", "n_chunks", "removed_chunks", "removed_lines")}
    clean = F.when(body.isNull() | (c["removed_chunks"] == 0), body).otherwise(c["text"]).alias(text)
    return out.select(*[clean if name == text else F.col(i).alias(name) for name, i in private.items() if name == text or name not in new], *new.values())
