"""Edits of sorted lists and of trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon
from ..functions.text import names_of
from . import chunks, trees, walk


def ancestors(path: Column, own: bool = False) -> Column:
    """The paths above a path, nearest last, without the root; with `own` also the path itself."""
    names = names_of(path)
    last = F.size(names) if own else F.size(names) - 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda k: F.array_join(F.slice(names, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def list_modify(elements: DataFrame, modifications: DataFrame, key: str = "key") -> DataFrame:
    """elements with modifications (key, op Set or Remove, and the elements' other columns) applied.

    Keep, insert, replace or delete; a removal of what isn't there does nothing. A key that is modified twice is an error.
    """
    if not modifications.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("a key is modified more than once")
    rest = [c for c in elements.columns if c != key]
    old = elements.select(key, F.struct(*rest).alias("_old"))
    new = modifications.select(key, "op", F.struct(*rest).alias("_new"))
    both = old.join(new, key, "full_outer").where(~F.coalesce(F.col("op") == "Remove", F.lit(False)))
    return both.select(key, F.when(F.col("op") == "Set", F.col("_new")).otherwise(F.col("_old")).alias("_v")).select(key, "_v.*")


def directory_modify(objects: DataFrame, roots: DataFrame, modifications: DataFrame, max_items: int = canon.MAX_DIRECTORY) -> tuple[DataFrame, DataFrame]:
    """(list, object_id) of directories after modifications of their lists, and their Directory objects.

    roots: list, object_id. modifications: list, name, op (Set or Remove), kind, size, executable, target_id.
    """
    rest = ["kind", "size", "executable", "target_id"]
    now = walk.list_directory(objects, roots).select(F.struct("list", "name").alias("key"), *rest)
    changed = list_modify(now, modifications.select(F.struct("list", "name").alias("key"), "op", *rest))
    return trees.directories(changed.select("key.list", "key.name", *rest), roots.select("list"), max_items)


def file_modify(objects: DataFrame, roots: DataFrame, modifications: DataFrame, max_items: int = canon.MAX_FILE) -> tuple[DataFrame, DataFrame]:
    """(list, size, object_id) of files after modifications of their chunks, and their File objects.

    roots: list, object_id. modifications: list, offset, op (Set or Remove), size, chunk_id; a chunk is named by the place of its first
    byte in the file as it was, so places don't move while several are changed. Where none begins, Set inserts one.
    """
    parts = trees.positions(walk.list_file(objects, roots).select("list", "at", "size", F.col("target_id").alias("chunk_id")), ["list"], ["at"], "offset", weight="size")
    changed = list_modify(parts.select(F.struct("list", "offset").alias("key"), "size", "chunk_id"), modifications.select(F.struct("list", "offset").alias("key"), "op", "size", "chunk_id"))
    rows = trees.positions(changed.select("key.list", "key.offset", "size", "chunk_id"), ["list"], ["offset"])
    ids, nodes = chunks.file_ids(rows.withColumnRenamed("list", "_list"), roots.select(F.col("list").alias("_list")), "_list", max_items)
    return ids.withColumnRenamed("_list", "list"), nodes


def file_modify_within(files: DataFrame, most: int, max_items: int = canon.MAX_FILE) -> DataFrame:
    """(list, size, object_id) of files after modifications, as by file_modify, each made within its row: nothing is shuffled or stored.

    files: list, object_id, objects (array of object_id, json; those of the file), modifications (array of offset, op, size,
    chunk_id). `most` bounds the parts of a file before and after; more are an error, as is a chunk that is modified twice.
    """
    mods = F.col("modifications")

    def placed(parts: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0).cast("long"), lambda s, x: s + x["size"])
        return F.transform(parts, lambda p, i: F.struct(before(i).alias("offset"), p["size"].alias("size"), p["chunk_id"].alias("chunk_id")))

    old = canon.let(walk.parts_within(F.col("object_id"), F.col("objects"), most, max_items), placed)
    kept = F.filter(old, lambda p: ~F.exists(mods, lambda m: m["offset"] == p["offset"]))
    new = F.transform(F.filter(mods, lambda m: m["op"] == "Set"), lambda m: F.struct(m["offset"].alias("offset"), m["size"].alias("size"), m["chunk_id"].alias("chunk_id")))
    twice = F.size(F.array_distinct(F.transform(mods, lambda m: m["offset"]))) < F.size(mods)
    changed = F.when(twice, F.raise_error(F.lit("a chunk is modified more than once"))).otherwise(F.array_sort(F.concat(kept, new)))
    return files.select("list", chunks.file_within(changed, most, max_items).alias("_file")).select("list", "_file.size", "_file.object_id")


def branches_modify(objects: DataFrame, roots: DataFrame, modifications: DataFrame, max_items: int = canon.MAX_BRANCHES) -> tuple[DataFrame, DataFrame]:
    """(list, object_id) of lists of branches after modifications (list, name, op, commit_id), and their Branches objects.

    A list that no branch is left in has no row.
    """
    now = walk.list_branches(objects, roots).select(F.struct("list", "name").alias("key"), F.col("target_id").alias("commit_id"))
    changed = list_modify(now, modifications.select(F.struct("list", "name").alias("key"), "op", "commit_id"))
    return trees.branch_lists(changed.select("key.list", "key.name", "commit_id"), max_items)


def overlap_pairs(paths: DataFrame) -> DataFrame:
    """outer, inner: the pairs of which the first holds the second or, as equal paths given twice, is it.

    Each path meets its own ancestors by equality, so the join is linear in paths and depth.
    """
    counted = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    above = counted.select(F.col("path").alias("inner"), F.explode(ancestors(F.col("path"))).alias("outer"))
    held = above.join(counted.select(F.col("path").alias("outer")), "outer").select("outer", "inner")
    return held.unionByName(counted.where("n > 1").select(F.col("path").alias("outer"), F.col("path").alias("inner")))


def tree_modify(files: DataFrame, modifications: DataFrame) -> DataFrame:
    """files (path, size, executable, target_id) after modifications (path, op Set or Remove, and those columns).

    Set replaces whatever stands at the path, a directory too, and a file in the way of a directory on the way there; Remove takes
    the path and all below it. Paths of modifications may not overlap, nor be the root.
    """
    if not modifications.where(F.size(names_of(F.col("path"))) == 0).isEmpty():
        raise ValueError("the root can't be modified")
    if not overlap_pairs(modifications).isEmpty():
        raise ValueError("modified paths overlap")
    changed = modifications.select(F.col("path").alias("_hit"))
    within = files.select("path", F.explode(ancestors(F.col("path"), True)).alias("_hit")).join(changed, "_hit").select("path").distinct()
    in_way = modifications.where("op = 'Set'").select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    kept = files.join(within, "path", "left_anti").join(in_way, "path", "left_anti")
    return kept.unionByName(modifications.where("op = 'Set'").select(*files.columns))
