"""Exact dedup by deterministic block naming (native DataFrame functions only).

A text is cut into blocks of a fixed number of bytes. Equal blocks get the same integer name and different
blocks different ones; then adjacent names are paired, equal pairs named alike, and so on until each document has
a single name. Its level and name are a collision-free identity: no step trusts a hash.

The integers that name a block (or a pair) are the row key and the position of its first occurrence in sorted
order, so names do not depend on the number of partitions, and naming pre-aggregates: a block that a third of
all documents hold travels once per map task. A 64-bit hash only routes blocks to reducers; each reducer compares
the smallest and the largest block of a hash, and where they differ, those hashes are named again by the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_RUN, keyed, let, stored


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_RUN, " ")


def _cut(raw: Column, block_bytes: int) -> Column:
    last = F.greatest(F.lit(0), F.ceil(F.length(raw) / block_bytes).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * block_bytes + 1, F.lit(block_bytes)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096, hash_bits: int = 64) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their whole normalised texts are. Null counts as empty; empty texts form one group. Rows
    that repeat an id are rows of their own: of equal texts exactly one row is kept, that with the smallest id (null
    ids last, ties in any way, as such rows are alike). An empty table gives an empty result; other columns are ignored.
    hash_bits below 64 is for tests that force two blocks onto one hash.
    """
    rows = keyed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text")
    return _identified(rows, block_bytes, hash_bits).select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """The rows of docs, all columns, of which exact_dedup says kept."""
    rows = keyed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct("*").alias("_row")), "_id", "_text")
    kept = stored(_identified(rows.select("_rk", "_id", "_text"), block_bytes, 64).where("kept").select("_rk"), "kept")
    # The ids grow with the corpus: this join is a shuffle at every size.
    return rows.join(kept.hint("merge"), "_rk", "left_semi").select("_row.*")


def _identified(rows: DataFrame, block_bytes: int, hash_bits: int) -> DataFrame:
    """_rk, _id, keep_id, group_size, kept, text_sha256 of each of rows (_rk, _id, _text)."""
    raw = F.encode(normalised(F.col("_text")), "utf-8")
    route = lambda b: F.shiftrightunsigned(F.xxhash64(b), 64 - hash_bits)
    known = stored(
        rows.select("_rk", "_id", let(raw, lambda b: F.struct(F.sha2(b, 256).alias("sha"), F.transform(_cut(b, block_bytes), route).alias("hs"))).alias("s")).select("_rk", "_id", "s.sha", "s.hs"),
        "blocks",
    )
    blocks = rows.select("_rk", F.posexplode(let(raw, lambda b: _cut(b, block_bytes))).alias("pos", "block")).withColumn("h", route(F.col("block")))
    first = F.min(F.struct("_rk", "pos"))
    names = stored(blocks.groupBy("h").agg(first.alias("name"), (F.min("block") != F.max("block")).alias("clash")), "names")
    at = known.select("_rk", F.size("hs").alias("n"), F.posexplode("hs").alias("pos", "h"))
    clash = names.where("clash").select("h")
    now = at.join(names.where("not clash").select("h", "name"), "h").select("_rk", "n", "pos", "name")
    if not clash.isEmpty():
        apart = blocks.join(clash, "h", "left_semi")
        own = apart.join(apart.groupBy("h", "block").agg(first.alias("name")), ["h", "block"]).select("_rk", "pos", "name")
        now = now.unionByName(own.join(known.select("_rk", F.size("hs").alias("n")), "_rk").select("_rk", "n", "pos", "name"))
    now = stored(now, "level")
    named, level = None, 0
    while True:
        done = now.where("n = 1").select("_rk", F.lit(level).alias("level"), "name")
        named = done if named is None else named.unionByName(done)
        rest = now.where("n > 1")
        if rest.isEmpty():
            break
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = rest.groupBy("_rk", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(side(0).alias("a"), side(1).alias("b"))
        pairs = stored(pairs.select("_rk", "n", "pos", "a", F.coalesce("b", F.struct(F.lit(-1).cast("long").alias("_rk"), F.lit(-1).alias("pos"))).alias("b")), "pairs")
        fresh = pairs.groupBy("a", "b").agg(first.alias("name"))
        now = stored(pairs.join(fresh, ["a", "b"]).select("_rk", "n", "pos", "name"), "level")
        level += 1
    groups = stored(named.join(known.select("_rk", "_id"), "_rk").groupBy("level", "name").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_rk")).alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    return (
        named.join(groups, ["level", "name"])
        .join(known.select("_rk", "_id", "sha"), "_rk")
        .select("_rk", "_id", F.col("best._id").alias("keep_id"), "group_size", (F.col("_rk") == F.col("best._rk")).alias("kept"), F.col("sha").alias("text_sha256"))
    )
