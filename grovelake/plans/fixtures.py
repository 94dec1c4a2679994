"""The driver's tables read as files, trees, snapshots, histories and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chunks, trees


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_of(row_id: Column) -> Column:
    return F.concat_ws("/", "lang", "source", F.concat(F.lpad(row_id.cast("string"), 8, "0"), F.lit(".txt")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, content, size, executable: each document as a file lang/source/id.txt."""
    docs = table(spark, sf_dir, "documents")
    content = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return docs.select("doc_id", path_of(F.col("doc_id")).alias("path"), content.alias("content"), F.length(content).cast("long").alias("size"), (F.col("doc_id") % 7 == 0).alias("executable"))


def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, ix, offset, size, chunk_id."""
    return chunks.chunk_contents(files(spark, sf_dir), "content", ["doc_id", "path"]).drop("bytes")


def file_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, size, executable, target_id (the File object)."""
    rows = files(spark, sf_dir).drop("size")
    return chunks.whole_file_ids(rows, "content", ["doc_id", "path", "executable"]).select("doc_id", "path", "size", "executable", F.col("object_id").alias("target_id"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """side, path, kind, target_id, size, executable of three versions of the tree, changed by doc_id % 20; without roots.

    Contents have ids of their own kind here: SHA-256 of the text, with a letter behind it where it was edited.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    rule = F.col("doc_id") % 20
    base = F.when(rule < 17, F.struct(F.lit("").alias("edit"), F.lit(False).alias("flip"), F.lit(False).alias("dir")))
    v = lambda edit="", flip=False, dir=False: F.struct(F.lit(edit).alias("edit"), F.lit(flip).alias("flip"), F.lit(dir).alias("dir"))
    odd = F.struct(F.lit("B").alias("edit"), (F.col("doc_id") % 40 == 39).alias("flip"), F.lit(False).alias("dir"))
    none = F.lit(None).cast(v_type := "struct<edit:string,flip:boolean,dir:boolean>")
    theirs = {1: v("A"), 3: v("E"), 4: v("A"), 5: none, 7: none, 8: v(flip=True), 10: v("A"), 11: none, 12: v("A", dir=True), 13: v("A", dir=True), 14: v(flip=True), 15: v("A", dir=True), 17: v("A"), 18: v("A"), 19: v("A")}
    ours = {2: v("B"), 3: v("E"), 4: v("B"), 6: none, 7: none, 9: v(flip=True), 10: v(flip=True), 11: v("B"), 13: v("B"), 14: v(flip=True), 15: v("B", dir=True), 17: none, 18: v("A"), 19: odd}
    pick = lambda cases: F.coalesce(*(F.when(rule == k, c) for k, c in cases.items() if c is not none), F.when(~rule.isin([k for k, c in cases.items() if c is none]), base))
    sides = F.array(*(F.struct(F.lit(n).alias("side"), c.cast(v_type).alias("v")) for n, c in (("base", base), ("theirs", pick(theirs)), ("ours", pick(ours)))))
    rows = docs.select("doc_id", "lang", "source", "text", F.explode(sides).alias("s")).where("s.v is not null")
    text = F.concat("text", F.when(F.col("s.v.edit") != "", F.concat(F.lit("\n"), "s.v.edit")).otherwise(""))
    at = F.concat(path_of(F.col("doc_id")), F.when(F.col("s.v.dir"), "/inner.txt").otherwise(""))
    file_rows = rows.select("s.side", at.alias("path"), F.lit("File").alias("kind"), F.sha2(F.encode(text, "utf-8"), 256).alias("target_id"), F.length(F.encode(text, "utf-8")).cast("long").alias("size"), ((F.col("doc_id") % 7 == 0) != F.col("s.v.flip")).alias("executable"))
    file_rows = trees.cut_lineage(file_rows)
    # Ids of directories: one fold for all three sides, each below a directory named like the side.
    sided = file_rows.select(F.concat_ws("/", "side", "path").alias("path"), "size", "executable", "target_id")
    places = docs.select(F.explode(F.array(*map(F.lit, ("base", "theirs", "ours")))).alias("side"), "lang", "source").distinct().select(F.concat_ws("/", "side", "lang", "source").alias("path"))
    dirs, _ = trees.tree(sided, places)
    split = dirs.select(F.split("path", "/", 2).alias("p"), "object_id").where(F.size("p") == 2)
    dir_rows = split.select(F.col("p")[0].alias("side"), F.col("p")[1].alias("path"), F.lit("Directory").alias("kind"), F.col("object_id").alias("target_id"), F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("boolean").alias("executable"))
    return file_rows.unionByName(dir_rows)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n, commit_id, parents (ids): a history over orders; each follows the one before, every tenth has the fifth before as well."""
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    name = lambda c: F.when(c >= 1, F.sha2(F.concat(F.lit("commit-"), c.cast("string")), 256))
    placed = trees.positions(order.withColumn("_all", F.lit(0)), ["_all"], ["o_orderkey"], "n").withColumn("n", F.col("n") + 1)
    parents = F.array_compact(F.array(name(F.col("n") - 1), F.when(F.col("n") % 10 == 0, name(F.col("n") - 5))))
    return placed.select("n", name(F.col("n")).alias("commit_id"), parents.alias("parents"), F.col("o_custkey").alias("author"), F.col("o_orderpriority").alias("message"))


def sync_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store, repo_url, branch, base_commit, repo_dir, slot of nations as stores and regions as repositories."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    both = n.join(r, n.n_regionkey == r.r_regionkey)
    dirs = F.array(*map(F.lit, ("/a", "/a/b/c", "/a/b", "/z", "/a/b/c/d")))
    return both.select(F.col("n_name").alias("store"), F.col("r_name").alias("repo_url"), (F.col("n_nationkey") % 2).cast("string").alias("branch"), (F.col("n_nationkey") % 3).cast("string").alias("base_commit"), F.element_at(dirs, (F.col("n_nationkey") % 5 + 1).cast("int")).alias("repo_dir"))


def directory_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the files of one directory ''."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.lit("").alias("list"), F.lit("File").alias("kind"), F.col("c_name").alias("name"), F.col("c_custkey").alias("size"), (F.col("c_custkey") % 7 == 0).alias("executable"), F.sha2(F.encode("c_name", "utf-8"), 256).alias("target_id"))


def order_rows(spark: SparkSession, sf_dir: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """list (order), parts (array of size, chunk_id) of each order of up to `most` lines, in one row; and (list) of those with more, or None.

    Lines are dealt out once, as numbers; ids of chunks are made where the lines of an order have met.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("line"))
    longer = trees.cut_lineage(line.groupBy(F.col("l_orderkey").alias("list")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("list"))
    longer = None if longer.isEmpty() else longer
    if longer is not None:
        line = line.join(longer, F.col("l_orderkey").eqNullSafe(F.col("list")), "left_anti")
    by = Window.partitionBy("l_orderkey").orderBy("line")
    met = line.select("l_orderkey", F.row_number().over(by).alias("n"), F.collect_list("line").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("lines")).where("n = 1")
    part = lambda x: F.struct(x["l_quantity"].cast("long").alias("size"), F.sha2(F.encode(F.concat_ws(":", x["l_partkey"].cast("string"), x["l_suppkey"].cast("string")), "utf-8"), 256).alias("chunk_id"))
    return met.select(F.col("l_orderkey").alias("list"), F.transform("lines", part).alias("parts")), longer


def order_parts(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """list (order), ix, size, chunk_id: the lines of each order, or of those in `only` (list), as the chunks of a file."""
    line = table(spark, sf_dir, "lineitem")
    if only is not None:
        line = line.join(only, F.col("l_orderkey").eqNullSafe(F.col("list")), "left_semi")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    return line.select(F.col("l_orderkey").alias("list"), rank.alias("ix"), F.col("l_quantity").cast("long").alias("size"), F.sha2(F.encode(F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")), "utf-8"), 256).alias("chunk_id"))


