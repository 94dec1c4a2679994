"""Cache tables: key/value overlays, fingerprints, existing objects, local chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlay(base: DataFrame, pending: DataFrame) -> DataFrame:
    """key, value of base (key, value) with pending (key, op Set or Del, value, seq) over it; the last seq of a key holds."""
    last = pending.groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("_p"))
    both = base.join(last, "key", "full_outer").where(F.col("_p").isNull() | (F.col("_p.op") != "Del"))
    return both.select("key", F.when(F.col("_p").isNull(), F.col("value")).otherwise(F.col("_p.value")).alias("value"))


def prefix_scan(entries: DataFrame, prefix: str) -> DataFrame:
    """Entries whose key begins with prefix, by key; the range is one that Parquet's statistics can prune."""
    bound = F.col("key") >= prefix
    return entries.where(bound & F.startswith("key", F.lit(prefix))).orderBy("key")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """table with changes over it; of rows with equal keys that with the latest `at` stays."""
    rest = [c for c in table.columns if c not in keys]
    rows = table.unionByName(changes)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_v")).select(*keys, *(F.col(f"_v.{c}").alias(c) for c in rest))


def uploads(files: DataFrame, fingerprints: DataFrame, stored: DataFrame) -> DataFrame:
    """files (store, path, fingerprint) with object_id where neither reading nor upload is needed, else null.

    A file is skipped if its cached fingerprint (store, path, fingerprint, object_id) is the present one and the cached object is
    fully stored (object_id).
    """
    known = fingerprints.select("store", "path", F.col("fingerprint").alias("_was"), F.col("object_id").alias("_id"))
    full = stored.select(F.col("object_id").alias("_id")).distinct().withColumn("_full", F.lit(True))
    met = files.join(known, ["store", "path"], "left").join(full, "_id", "left")
    skip = F.coalesce((F.col("fingerprint") == F.col("_was")) & F.col("_full"), F.lit(False))
    return met.withColumn("object_id", F.when(skip, F.col("_id"))).drop("_was", "_id", "_full")


def unknown(candidates: DataFrame, known: DataFrame, key: str = "object_id") -> DataFrame:
    """Each candidate once, without those that are known."""
    return candidates.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def local_candidates(wanted: DataFrame, local_chunks: DataFrame, most: int = 256) -> DataFrame:
    """chunk_id, path, offset, length, nth: up to `most` places, in path and offset order, where each wanted chunk may stand."""
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy("path", "offset"))
    return wanted.select("chunk_id").distinct().join(local_chunks, "chunk_id").withColumn("nth", rank).where(F.col("nth") <= most)


def verified(candidates: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, stale): for each chunk the first candidate whose bytes in files (path, content) have its hash; those that don't."""
    read = candidates.join(files.select("path", "content"), "path", "left").withColumn("bytes", F.expr("substring(content, cast(offset as int) + 1, cast(length as int))")).drop("content")
    good = F.coalesce(F.sha2("bytes", 256) == F.col("chunk_id"), F.lit(False))
    found = read.where(good).groupBy("chunk_id").agg(F.min_by(F.struct("path", "offset", "bytes"), "nth").alias("_f")).select("chunk_id", "_f.*")
    return found, read.where(~good).select("chunk_id", "path", "offset", "length")


def without_paths(table: DataFrame, invalid: DataFrame) -> DataFrame:
    """table without the rows at or below the invalid paths."""
    from .edit import ancestors

    hit = table.select("path").distinct().select("path", F.explode(ancestors(F.col("path"), True)).alias("_at"))
    return table.join(hit.join(invalid.select(F.col("path").alias("_at")), "_at").select("path").distinct(), "path", "left_anti")
