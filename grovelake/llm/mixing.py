"""Mixing sources to target weights by capped water-filling (native DataFrame functions only).

Target of a source: its weight's share of the budget, clamped at max_epochs times the source's size; what the clamp
cuts off is dealt again to the others in proportion to their weights until no source is above its clamp. Each round
is one aggregate over the table of sources and brings two numbers to the driver.

Sampling: a source of target t and size s is taken floor(t / s) times whole; the rest of t is one more repetition of
the documents that come first in an order seeded by a hash of the id, the last of them in part, so that the words
taken add up to the rounded target. The prefix sums behind that order are made in two steps, over slices of the hash and
within a slice, so that a source with a third of all rows is spread over as many tasks as there are slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keyed, numbered, stored


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(row_id: Column, seed: str) -> Column:
    """A seeded number below 2**32 for each id; the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(row_id.cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("long")


def water_fill(sources: DataFrame, budget: float, max_epochs: int) -> DataFrame:
    """sources (size, weight, ...) with target: min(max_epochs * size, level * weight) with the one level that spends the budget."""
    level = None
    while True:
        full = F.lit(False) if level is None else F.lit(level) * F.col("weight") > F.col("size") * max_epochs
        spent, weight = sources.agg(F.sum(F.when(full, F.col("size") * max_epochs).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        now = (budget - (spent or 0)) / weight if weight else level or 0.0
        if now == level:
            break
        level = now
    return sources.withColumn("target", F.least((F.col("size") * max_epochs).cast("double"), F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (3, 1, 2), budget: float = 1.5, max_epochs: int = 2, seed: str = "mix", slices: int = 1024) -> DataFrame:
    """One row per input row: id, size, source, source_size, target, copies (whole repetitions), taken (words).

    The sources, by code point and null last, weigh `weights`, repeating; together they share budget times all sizes.
    A null source is a source of its own, apart from the empty string. Null and empty texts have size 0 and are
    taken 0 words (copies of the whole part only). A source of size 0 has target 0. Repeated rows are rows of their
    own. An empty table gives an empty result; other columns are ignored.
    """
    sized = stored(
        docs.select(
            F.col(id_col).alias("_id"), F.col(source_col).isNull().alias("_none"), F.coalesce(source_col, F.lit("")).alias("_src"), word_count(F.col(text_col)).alias("size"), draw(F.col(id_col), seed).alias("_u")
        ).withColumn("_slice", F.floor(F.col("_u") * slices / F.lit(2**32)).cast("int")),
        "sized",
    )
    parts = stored(sized.groupBy("_none", "_src", "_slice").agg(F.sum("size").alias("_part")), "slices")
    sources = numbered(parts.groupBy("_none", "_src").agg(F.sum("_part").alias("size")), [F.col("_none"), F.col("_src")], "_place")
    sources = stored(sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights)).cast("int") + 1)), "sources")
    total = sources.agg(F.sum("size")).first()[0] or 0
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    filled = water_fill(sources, budget * total, max_epochs).select("_none", "_src", F.col("size").alias("source_size"), "target").withColumn("_whole", whole)
    filled = filled.withColumn("_cut", F.round(F.col("target")).cast("long") - F.col("_whole") * F.col("source_size"))
    key = ["_none", "_src", "_slice"]
    along = Window.partitionBy("_none", "_src").orderBy("_slice")
    started = parts.withColumn("_start", F.sum("_part").over(along) - F.col("_part")).join(filled, ["_none", "_src"])
    within = Window.partitionBy(*key).orderBy("_u", "_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.join(started, key).withColumn("_before", F.col("_start") + F.sum("size").over(within) - F.col("size"))
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_cut") - F.col("_before")))
    halfway = (F.col("size") > 0) & (2 * more >= F.col("size"))
    return placed.select(
        F.col("_id").alias(id_col), F.when(~F.col("_none"), F.col("_src")).alias(source_col), "size", "source_size", "target",
        (F.col("_whole") + halfway.cast("long")).alias("copies"), (F.col("_whole") * F.col("size") + more).alias("taken"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each row of docs, all columns, as many times as mix says in copies.

    A document is a copy or none here: the one of each source that the mix takes in part is rounded to the nearer.
    """
    rows = keyed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source"), F.struct("*").alias("_row")), "_id", "_text")
    copies = stored(mix(rows.select("_rk", "_text", "_source"), "_rk", "_text", "_source", **how).where("copies > 0").select("_rk", "copies"), "copies")
    # The ids grow with the corpus: this join is a shuffle at every size.
    return rows.join(copies.hint("merge"), "_rk").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_row.*")
