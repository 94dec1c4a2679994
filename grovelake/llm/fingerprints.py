"""Document fingerprints by a homomorphic multiset hash (native DataFrame functions only).

A paragraph (a line of the text) is hashed to a wide vector; a document's fingerprint is the sum of its paragraphs' vectors, each
lane modulo a power of two. So the order of paragraphs doesn't matter, and a paragraph is inserted or deleted by adding or
subtracting its vector, without the rest of the text. The vector has two parts: SUM_LANES lanes hold the full range of 32 bits, for
equality; NEAR_LANES lanes of 16 bits get one small signed number from each sentence of the paragraph, at a place and
with a sign that the sentence's hash chooses. Products of those lanes estimate how much text two documents share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_or_numbered, let

SUM_LANES, NEAR_LANES = 16, 128


def _bits(digest: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(digest, first, digits), 16, 10).cast("long")


def paragraph_lanes(paragraph: Column) -> Column:
    """array<long>: the full-range lanes of one paragraph, four from each of a few digests."""
    digests = [F.md5(F.concat(F.lit(f"{i}:"), paragraph)) for i in range(SUM_LANES // 4)]
    return F.array(*(_bits(d, 8 * k + 1, 8) for d in digests for k in range(4)))


def sum_lanes(text: Column) -> Column:
    """array<long>: the sum of all paragraphs' full-range lanes, modulo 2**32."""
    zero = F.array(*[F.lit(0).cast("long")] * SUM_LANES)
    step = lambda acc, p: F.zip_with(acc, paragraph_lanes(p), lambda a, b: (a + b) % (1 << 32))
    return F.aggregate(F.split(text, "\n", -1), zero, step)


def sentences(text: Column) -> Column:
    """Parts of the paragraphs that end with '. '; empty ones have no weight."""
    return F.filter(F.flatten(F.transform(F.split(text, "\n", -1), lambda p: F.split(p, r"\. ", -1))), lambda s: s != "")


def near_entry(sentence: Column) -> Column:
    """struct<lane, value>: a place, and the root of the sentence's length, quartered, with a sign."""
    size = F.greatest(F.lit(1), F.round(F.sqrt(F.length(sentence)) * 4).cast("int"))
    return let(F.md5(sentence), lambda d: F.struct((_bits(d, 1, 4) % NEAR_LANES).cast("int").alias("lane"), F.when(_bits(d, 5, 1) >= 8, size).otherwise(-size).alias("value")))


def _signed(lane: Column) -> Column:
    """The number nearest 0 that is equal to a lane modulo 2**16."""
    return F.pmod(lane + 32768, F.lit(65536)) - 32768


def _hex(lanes: Column, power: int) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(F.pmod(x, F.lit(1 << power)))), power // 4, "0")), "")


def fingerprint_text(sums: Column, near: Column) -> Column:
    return F.concat(_hex(sums, 32), F.lit(":"), _hex(near, 16))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The lanes of a with those of b inserted (sign 1) or deleted (-1), before they are reduced."""
    return F.zip_with(a, b, lambda x, y: x + sign * y)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two vectors of signed near lanes: shared length over that of the longer; 1 if both are empty."""
    norm = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v * v)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, v: s + v)
    most = F.greatest(norm(a), norm(b))
    return F.when(most == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot.cast("double") / most)))


def near_lanes(text: Column) -> Column:
    """array<long>: the sum of all sentences' entries, as signed numbers modulo 2**16."""
    zero = F.array_repeat(F.lit(0).cast("long"), NEAR_LANES)

    def step(acc: Column, e: Column) -> Column:
        at = e["lane"]
        return F.concat(F.slice(acc, F.lit(1), at), F.array(F.element_at(acc, at + 1) + e["value"]), F.slice(acc, at + 2, F.lit(NEAR_LANES)))

    return F.aggregate(F.transform(sentences(text), near_entry), zero, step, lambda acc: F.transform(acc, _signed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and fingerprint.

    Null counts as empty; an empty text is one empty paragraph. Texts of any length are read whole, in the row. Repeated rows stay, with
    equal fingerprints; an empty table stays empty; other columns, one named fingerprint too, are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), fingerprint_text(sum_lanes(text), near_lanes(text)).alias("fingerprint"))


def _first_at_least(marks: Column, n: int, value: Column) -> Column:
    """The place (from 0) of the first of n ascending marks that is at least value, by bisection."""
    start = F.struct(F.lit(0).alias("low"), F.lit(n - 1).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        above = F.element_at(marks, middle + 1) >= value
        return F.struct(F.when(above | (s["low"] >= s["high"]), s["low"]).otherwise(middle + 1).alias("low"), F.when(above & (s["low"] < s["high"]), middle).otherwise(s["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, n.bit_length()))), start, halve)["low"]


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = 1024, even_slices: int = 4096, wide_rows: int = 32768) -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    row's, in descending order of id; after the last row comes the first, and a single row is its own next. Null counts as
    empty; null ids come last. Rows that repeat an id come in the order of their texts, descending. An empty table gives an
    empty result; other columns are ignored.

    Texts of any length are read whole. They are shuffled once, by slices of the order of ids: of about slice_rows rows each up
    to even_slices; beyond, slices grow to wide_rows rows and then their number grows with the table. The largest id of
    a slice is also dealt to the slice above, whose smallest id it follows; each row meets the next in a window.
    """
    rows, plain = keyed_or_numbered(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), "_id", "_text")
    n_rows = rows.count()
    up = F.col("_rk") if plain else F.when(F.col("_id").isNull(), F.col("_rk") - n_rows).otherwise(F.col("_rk"))
    rows = rows.select("_id", "_text", up.alias("_up"))
    n = max(1, min(even_slices, n_rows // slice_rows), n_rows // wide_rows)
    found = rows.agg(F.percentile_approx("_up", [(i + 1) / n for i in range(n)], min(20 * n, 1 << 22)), F.max("_up")).first()
    marks = sorted({*(found[0] or []), found[1] or 0})
    n = len(marks)
    bound = F.split(F.lit(",".join(map(str, marks))), ",").cast("array<bigint>")
    sliced = rows.withColumn("_slice", _first_at_least(bound, n, F.col("_up")))
    here, above = F.struct(F.col("_slice").alias("g"), F.lit(False).alias("guest")), F.struct(((F.col("_slice") + 1) % n).alias("g"), F.lit(True).alias("guest"))
    last = F.element_at(bound, F.col("_slice") + 1) == F.col("_up")
    dealt = sliced.select("_id", "_text", "_up", F.explode(F.when(last, F.array(here, above)).otherwise(F.array(here))).alias("p"))
    dealt = dealt.select("_id", "_text", "_up", "p.g", "p.guest").repartition("g")
    summed = dealt.select("*", sum_lanes(F.col("_text")).alias("sums"), near_lanes(F.col("_text")).alias("near"))
    order = Window.partitionBy("g").orderBy("guest", F.desc("_up"))
    met = summed.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("_text", "sums", "near"))).where("not guest")
    edited = F.expr("concat(left(_text, n - cast(floor(n / 2) as int)), left(next__text, cast(floor(n / 2) as int)))")
    both = met.withColumn("n", F.length("_text")).withColumn("_edited", edited)
    out = both.select("_id", "n", "sums", "near", "next_sums", "next_near", F.sha2(F.encode("_edited", "utf-8"), 256).alias("sha"), sum_lanes(F.col("_edited")).alias("sums_e"), near_lanes(F.col("_edited")).alias("near_e"))
    like = lambda x, y: F.when((F.col(f"sums{x}") == F.col(y[0])) & (F.col(f"near{x}") == F.col(y[1])), 1.0).otherwise(likeness(F.col(f"near{x}"), F.col(y[1])))
    return out.select(
        F.col("_id").alias(id_col), F.col("n").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"),
        fingerprint_text(F.col("sums"), F.col("near")).alias("fingerprint"), fingerprint_text(F.col("sums_e"), F.col("near_e")).alias("edited_fingerprint"),
        like("", ("sums_e", "near_e")).alias("near_edited"), like("", ("next_sums", "next_near")).alias("near_next"),
    )
