"""A file store in a file system: a data source for its entries, contents by Spark's reader, and a sink for planned actions.

The folder must be one that all executors see. Stores in other file systems (s3://, hdfs://, ...) are listed and read by Spark's own
reader; they have neither modes nor empty directories, and no sink.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import fingerprint
from ..operators.edit import ancestors
from .hadoop_fs import Folder, is_local, uri
from .ignore import DEFAULT_IGNORES, IGNORE_FILES, rules_table, visible

ENTRY_SCHEMA = "path string, kind string, size bigint, executable boolean, mtime timestamp"


class _Part(InputPartition):
    def __init__(self, root: str, below: str, deep: bool):
        self.root, self.below, self.deep = root, below, deep


class _EntryReader(DataSourceReader):
    """One partition for the entries at the top and one for each directory there; links and special files are passed over."""

    def __init__(self, options: dict):
        self.root = options["path"]

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise ValueError(f"not a directory: {self.root}")
        tops = [e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False)]
        return [_Part(self.root, "", False), *(_Part(self.root, t, True) for t in sorted(tops))]

    def read(self, part: _Part) -> Iterator[tuple]:
        from datetime import datetime, timezone

        todo = [part.below]
        while todo:
            here = todo.pop()
            for e in sorted(os.scandir(os.path.join(part.root, here)), key=lambda e: e.name.encode("utf-8", "surrogateescape")):
                path = f"{here}/{e.name}" if here else e.name
                at = e.stat(follow_symlinks=False)
                when = datetime.fromtimestamp(at.st_mtime_ns // 1_000_000 / 1000, timezone.utc).replace(tzinfo=None)
                if e.is_dir(follow_symlinks=False):
                    yield path, "Directory", None, None, when
                    if part.deep:
                        todo.append(path)
                elif e.is_file(follow_symlinks=False):
                    yield path, "File", at.st_size, bool(at.st_mode & 0o111), when


class StoreEntries(DataSource):
    """spark.read.format("store_entries").load(folder): path, kind, size, executable, mtime of all below a folder, empty directories too."""

    @classmethod
    def name(cls) -> str:
        return "store_entries"

    def schema(self) -> str:
        return ENTRY_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _EntryReader(self.options)


def entries(spark: SparkSession, folder: str, global_ignores: tuple[str, ...] = DEFAULT_IGNORES) -> DataFrame:
    """path, kind, size, executable, fingerprint of a store, what its ignore rules hide left out."""
    if is_local(folder):
        spark.dataSource.register(StoreEntries)
        found = spark.read.format("store_entries").load(uri(folder).removeprefix("file://")).distinct()
    else:
        found = remote_entries(spark, folder)
    rules = found.where(F.col("kind") == "File").where(F.regexp_extract("path", "[^/]*$", 0).isin(*IGNORE_FILES)).select("path").collect()
    texts: dict[str, list[str]] = {}
    rule_files = Folder(spark, folder)
    for path in sorted((r.path for r in rules), key=lambda p: IGNORE_FILES.index(p.rpartition("/")[2])):
        texts.setdefault(path.rpartition("/")[0], []).append(rule_files.read(path))
    shown = visible(found, rules_table(spark, [(d, "\n".join(t)) for d, t in texts.items()], global_ignores))
    print_ = F.when(F.col("kind") == "File", fingerprint(F.unix_millis("mtime"), F.col("size"), F.col("executable")))
    return shown.select("path", "kind", "size", "executable", print_.alias("fingerprint"))


def _below(folder: str) -> Column:
    """The path of a file below a store, from the address that Spark's reader gives."""
    return F.url_decode(F.replace("path", F.lit(uri(folder) + "/"), F.lit("")))


def remote_entries(spark: SparkSession, folder: str) -> DataFrame:
    """path, kind, size, executable, mtime of a store that Spark's reader alone can reach: its files, and the directories they imply.

    Listing is Spark's, in parallel from many folders on; contents aren't read. Spark's reader passes over names that begin
    with a dot or underline, so such files are not part of a store there.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri(folder))
    files = read.select(_below(folder).alias("path"), F.lit("File").alias("kind"), F.col("length").alias("size"), F.lit(False).alias("executable"), F.col("modificationTime").alias("mtime"))
    none = lambda kind: F.lit(None).cast(kind)
    dirs = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return files.unionByName(dirs.select("path", F.lit("Directory").alias("kind"), none("long").alias("size"), none("boolean").alias("executable"), none("timestamp").alias("mtime")))


#: Bytes of contents in one batch; a longer file is a batch by itself.
BATCH_BYTES = 32 << 20


def contents(spark: SparkSession, folder: str, paths: DataFrame | None = None) -> DataFrame:
    """path, content of the files below a folder; of paths only, where given. Paths that aren't files have no row.

    Local files are read where their paths are, as Spark's reader passes over names that begin with a dot or underline.
    """
    if not is_local(folder):
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri(folder))
        out = read.select(_below(folder).alias("path"), "content")
        return out if paths is None else out.join(paths.select("path"), "path", "left_semi")
    root = uri(folder).removeprefix("file://")
    if paths is None:
        spark.dataSource.register(StoreEntries)
        paths = spark.read.format("store_entries").load(root).where("kind = 'File'").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found, size = [], [], 0
            for path in batch.column(0).to_pylist():
                full = os.path.join(root, path)
                if not os.path.isfile(full):
                    continue
                with open(full, "rb") as f:
                    found.append(f.read())
                names.append(path)
                size += len(found[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.binary())], names=["path", "content"])
                    names, found, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.binary())], names=["path", "content"])

    return paths.select("path").mapInArrow(run, "path string, content binary")


def apply(plan: DataFrame, folder: str, files: DataFrame) -> DataFrame:
    """Do a plan (path, step, action, target_id, executable) in a folder; files: target_id, content. Returns path, action as done.

    First all removals, the deepest last to be needed, then directories from the top, then files (each written beside its place
    and renamed) and modes. Each phase is repeatable, so a task that is run again does no harm.
    """
    import shutil

    if not is_local(folder):
        raise ValueError(f"only folders of the local file system can be written to: {folder}")
    folder = uri(folder).removeprefix("file://")

    def removed(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                full = os.path.join(folder, path)
                if os.path.isdir(full) and not os.path.islink(full):
                    shutil.rmtree(full, ignore_errors=True)
                elif os.path.lexists(full):
                    os.remove(full)
            yield batch

    def made(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                os.makedirs(os.path.join(folder, path), exist_ok=True)
            yield batch

    def written(batches):
        for batch in batches:
            for row in batch.to_pylist():
                full = os.path.join(folder, row["path"])
                if row["action"] == "download":
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    beside = os.path.join(os.path.dirname(full), f".part-{os.getpid()}-{os.path.basename(full)}")
                    with open(beside, "wb") as f:
                        f.write(row["content"] or b"")
                    os.replace(beside, full)
                mode = os.stat(full).st_mode
                bits = stat.S_IXUSR | stat.S_IXGRP | stat.S_IXOTH
                os.chmod(full, mode | bits if row["executable"] else mode & ~bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["path", "action"])

    two = "path string, action string"
    doing = plan.select("path", "action")
    n = [doing.where("action = 'rm'").mapInArrow(removed, two).count(), doing.where("action = 'mkdir'").mapInArrow(made, two).count()]
    late = plan.where("action in ('download', 'chmod')").join(files, "target_id", "left").select("path", "action", "executable", "content").mapInArrow(written, two)
    n.append(late.count())
    return plan.sparkSession.createDataFrame(list(zip(("rm", "mkdir", "write"), n)), "phase string, n long")
