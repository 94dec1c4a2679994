"""Bounded-fanout lists: folding leaves into nodes, and directories from the deepest to the root.

A list of n leaves becomes ceil(n / max) nodes, these become leaves of the next level, until one node is left. The place of a
leaf in its list decides its node, so each level is one group-by on (list, place div max), whose groups hold `max` rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canon


#: Entries of one directory, from which on its level is dealt over many tasks.
HUGE = 1_000_000


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as written once to a table in the folder that all executors share, and read back; the table goes when the driver ends."""
    spark = df.sparkSession
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
            sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='grovelake-')}")
        named = sc._jsc.sc().getCheckpointDir().get()
    path = f"{named.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = sc._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def positions(df: DataFrame, lists: list[str], order: list[str], to: str = "ix", weight: str | None = None) -> DataFrame:
    """df with the place of each row in its list. A list of any size is dealt over many tasks.

    Rows are range-partitioned by list and order; the counts of each (partition, list) give what stands before. weight: a
    column of whole numbers; then the place is the sum of those before, as of bytes.
    """
    placed = cut_lineage(df.repartitionByRange(*lists, *order).withColumn("_part", F.spark_partition_id()))
    size = F.lit(1) if weight is None else F.col(weight)
    counts = placed.groupBy(*lists, "_part").agg(F.sum(size).alias("_n"))
    before = counts.select(*lists, "_part", (F.sum("_n").over(Window.partitionBy(*lists).orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.sum(size).over(Window.partitionBy(*lists, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - size
    joined = placed.withColumn("_here", within).join(before, [*lists, "_part"])
    return joined.withColumn(to, (F.col("_before") + F.col("_here")).cast("long")).drop("_part", "_here", "_before")


def fold(leaves: DataFrame, lists: DataFrame, wrap: Callable[[Column], Column], nested: Callable[[DataFrame], Column], max_items: int, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(list, size, object_id) of every list, and all nodes (object_id, json).

    leaves: list, ix (0, 1, ...), item (JSON), first, last, size. lists: every list, so that one without leaves gives the
    empty object. wrap makes a node's JSON of its items, nested the item that stands for a node in the level above.
    most: the number of leaves of the longest list, counted if it isn't known. A list's own number tells at which level it
    ends, so no list is ever brought to one task.
    """
    level = leaves.select("list", F.col("ix").cast("long").alias("ix"), "item", "first", "last", F.col("size").cast("long").alias("size"))
    counts = None
    if most is None or most > max_items:
        counts = cut_lineage(level.groupBy("list").agg(F.count(F.lit(1)).alias("_n")))
        most = counts.agg(F.max("_n")).first()[0] or 0
    roots = nodes = None
    reach = max_items
    while True:
        at = F.struct("ix", "item")
        made = level.groupBy("list", F.floor(F.col("ix") / max_items).alias("ix")).agg(
            F.transform(F.array_sort(F.collect_list(at)), lambda x: x["item"]).alias("items"), F.min_by("first", "ix").alias("first"), F.max_by("last", "ix").alias("last"), F.sum("size").alias("size")
        )
        made = made.withColumn("json", wrap(F.col("items"))).withColumn("object_id", canon.text_id(F.col("json"))).drop("items")
        if most <= reach:
            done, rest = made, None
        else:
            counted = cut_lineage(made.join(counts, "list"))
            made, done, rest = counted, counted.where(F.col("_n") <= reach), counted.where(F.col("_n") > reach)
        done = done.select("list", "size", "object_id", "json")
        roots = done if roots is None else roots.unionByName(done)
        nodes = made.select("object_id", "json") if nodes is None else nodes.unionByName(made.select("object_id", "json"))
        if rest is None:
            break
        level = rest.select("list", "ix", nested(rest).alias("item"), "first", "last", "size")
        reach *= max_items
    empty = wrap(F.array().cast("array<string>"))
    bare = lists.distinct().join(roots.select("list"), "list", "left_anti").select("list", F.lit(0).cast("long").alias("size"), canon.text_id(empty).alias("object_id"), empty.alias("json"))
    roots = roots.unionByName(bare)
    nodes = nodes.unionByName(bare.select("object_id", "json")).distinct()
    return roots.select("list", "size", "object_id"), nodes


def directories(entries: DataFrame, lists: DataFrame, max_items: int = canon.MAX_DIRECTORY, spread: bool = False, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(list, object_id) of one level of directories, and their Directory objects.

    entries: list, kind (File or Directory), name, size, executable, target_id. Names are in byte order. spread deals
    the entries of one directory over many tasks where directories may be huge. most: as for fold.
    """
    if spread:
        placed = positions(entries, ["list"], ["name"])
    else:
        placed = entries.withColumn("ix", F.row_number().over(Window.partitionBy("list").orderBy("name")) - 1)
    item = F.when(F.col("kind") == "Directory", canon.directory_entry(F.col("name"), F.col("target_id"))).otherwise(canon.file_entry(F.col("name"), F.col("size"), F.col("executable"), F.col("target_id")))
    leaves = placed.select("list", "ix", item.alias("item"), F.col("name").alias("first"), F.col("name").alias("last"), F.lit(0).alias("size"))
    roots, nodes = fold(leaves, lists, canon.directory_object, lambda r: canon.partial_directory(r["first"], r["last"], r["object_id"]), max_items, most)
    return roots.select("list", "object_id"), nodes


def branch_lists(branches: DataFrame, max_items: int = canon.MAX_BRANCHES) -> tuple[DataFrame, DataFrame]:
    """(list, object_id) of lists of branches (list, name, commit_id), and their Branches objects; lists of any length."""
    placed = positions(branches, ["list"], ["name"])
    leaves = placed.select("list", "ix", canon.branch(F.col("name"), F.col("commit_id")).alias("item"), F.col("name").alias("first"), F.col("name").alias("last"), F.lit(0).alias("size"))
    roots, nodes = fold(leaves, branches.select("list"), canon.branches_object, lambda r: canon.branches_entry(r["first"], r["last"], r["object_id"]), max_items)
    return roots.select("list", "object_id"), nodes


def tree(files: DataFrame, dirs: DataFrame | None = None, max_items: int = canon.MAX_DIRECTORY, skip: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, object_id) of every directory, the root at '', and all Directory objects.

    files: path, size, executable, target_id, paths normalised; they are stored once, as every level reads them. dirs: path,
    directories that may be empty. The levels are folded from the deepest up; a directory's id depends on the ids of
    what it holds. One job counts the entries of all directories: a level with one of more than HUGE entries deals them over many
    tasks. skip: (path, object_id) of directories that are known and have no rows below them.
    """
    spark = files.sparkSession
    holder = F.regexp_replace("path", "/?[^/]*$", "")
    own = files.select(holder.alias("list"), F.lit("File").alias("kind"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.col("size").cast("long").alias("size"), "executable", "target_id")
    own = cut_lineage(own)
    paths = own.select(F.col("list").alias("path")).distinct().unionByName(spark.createDataFrame([("",)], "path string"))
    if dirs is not None:
        paths = paths.unionByName(dirs.select("path"))
    if skip is not None:
        paths = paths.unionByName(skip.select(holder.alias("path")))
    names = F.filter(F.split("path", "/", -1), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(0), F.size(names)), lambda k: F.array_join(F.slice(names, 1, k), "/"))
    paths = cut_lineage(paths.distinct().select(F.explode(above).alias("path")).distinct().withColumn("depth", F.size(names)))
    below = paths.unionByName(skip.select("path", F.size(names).alias("depth"))) if skip is not None else paths
    held = own.select("list", F.when(F.col("list") == "", 0).otherwise(F.size(F.split("list", "/", -1))).alias("depth"))
    held = held.unionByName(below.where("depth > 0").select(holder.alias("list"), (F.col("depth") - 1).alias("depth")))
    sizes = held.groupBy("list", "depth").agg(F.count(F.lit(1)).alias("n")).unionByName(paths.select(F.col("path").alias("list"), "depth", F.lit(0).alias("n")))
    longest = {r.depth: r.n for r in sizes.groupBy("depth").agg(F.max("n").alias("n")).collect()}  # a row for each depth of the tree
    deepest = max(longest)
    found = skip.select("path", "object_id") if skip is not None else None
    objects = None
    for depth in range(deepest, -1, -1):
        here = paths.where(F.col("depth") == depth).select(F.col("path").alias("list"))
        entries = own.join(here, "list", "left_semi")
        if found is not None:
            below = found.where(F.col("path") != "").select(holder.alias("list"), F.lit("Directory").alias("kind"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("boolean").alias("executable"), F.col("object_id").alias("target_id"))
            entries = entries.unionByName(below.join(here, "list", "left_semi"))
        most = longest.get(depth, 0)
        ids, nodes = directories(entries, here, max_items, spread=most > HUGE, most=most)
        ids = cut_lineage(ids.select(F.col("list").alias("path"), "object_id"))
        found = ids if found is None else found.unionByName(ids)
        objects = nodes if objects is None else objects.unionByName(nodes)
    return found, objects.distinct()
