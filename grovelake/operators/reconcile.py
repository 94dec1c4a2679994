"""Bringing a store to the state of a repository directory: the plan, its rendering, and staging of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import names_of
from .edit import ancestors


def plan(repo: DataFrame, store: DataFrame) -> DataFrame:
    """path, step, action (rm, mkdir, download, chmod), target_id, executable; to be done by names along the path, then step.

    repo: path, kind, target_id, executable. store: path, kind, executable, fingerprint, cached_fingerprint, cached_id. One
    full outer join on the path; a file is left alone where its cached fingerprint is the present one and the cached id that of
    the repository. What lies below a directory that is removed has no row of its own.
    """
    r = repo.select("path", F.struct("kind", "target_id", "executable").alias("r"))
    s = store.select("path", F.struct("kind", "executable", ((F.col("fingerprint") == F.col("cached_fingerprint"))).alias("known"), F.col("cached_id").alias("id")).alias("s"))
    both = r.join(s, "path", "full_outer")
    rk, sk = F.col("r.kind"), F.col("s.kind")
    act = lambda step, name: F.struct(F.lit(step).alias("step"), F.lit(name).alias("action"))
    rm, mkdir, download, chmod = act(0, "rm"), act(1, "mkdir"), act(1, "download"), act(1, "chmod")
    same = F.coalesce(F.col("s.known") & (F.col("s.id") == F.col("r.target_id")), F.lit(False))
    none = F.array().cast("array<struct<step:int,action:string>>")
    actions = (
        F.when(rk.isNull(), F.array(rm))
        .when(sk.isNull(), F.when(rk == "Directory", F.array(mkdir)).otherwise(F.array(download)))
        .when((rk == "Directory") & (sk == "Directory"), none)
        .when(rk == "Directory", F.array(rm, mkdir))
        .when(sk == "Directory", F.array(rm, download))
        .when(same, F.when(F.col("r.executable") != F.col("s.executable"), F.array(chmod)).otherwise(none))
        .otherwise(F.array(rm, download))
    )
    gone = both.where((sk == "Directory") & (rk.isNull() | (rk == "File"))).select(F.col("path").alias("_above"))
    covered = both.where(rk.isNull()).select("path", F.explode(ancestors(F.col("path"))).alias("_above")).join(gone, "_above").select("path").distinct()
    rows = both.join(covered, "path", "left_anti").select("path", F.explode(actions).alias("a"), "r.target_id", "r.executable")
    fetched = F.col("a.action") == "download"
    return rows.select("path", "a.step", "a.action", F.when(fetched, F.col("target_id")).alias("target_id"), F.when(fetched | (F.col("a.action") == "chmod"), F.col("executable")).alias("executable"))


def root_actions(kind: str | None) -> list[str]:
    """What is done at the root of a download before its entries: by what stands there, None for nothing."""
    return {"Directory": [], None: ["mkdir"], "File": ["rm", "mkdir"]}[kind]


def rendered(steps: DataFrame) -> DataFrame:
    """steps with `line`, as shown to a user."""
    mode = F.when(F.col("executable"), "+x").otherwise("-x")
    line = (
        F.when(F.col("action") == "download", F.concat(F.lit("download "), "path", F.lit(" <- "), "target_id", F.when(F.col("executable"), "+x").otherwise("")))
        .when(F.col("action") == "chmod", F.concat(F.lit("chmod "), mode, F.lit(" "), "path"))
        .otherwise(F.concat_ws(" ", "action", "path"))
    )
    return steps.withColumn("line", line)


def in_order(steps: DataFrame) -> DataFrame:
    """steps sorted as they are to be done: by the names along the path, then step."""
    return steps.orderBy(names_of(F.col("path")), "step")


def chunks_to_stage(downloads: DataFrame, file_chunks: DataFrame, staged: DataFrame) -> DataFrame:
    """chunk_id, size of the chunks of files to download (target_id) that aren't staged (chunk_id), each once.

    file_chunks: file_id, size, chunk_id.
    """
    needed = downloads.select(F.col("target_id").alias("file_id")).where("file_id is not null").distinct().join(file_chunks, "file_id")
    return needed.select("chunk_id", "size").distinct().join(staged, "chunk_id", "left_anti")


def read_staged(wanted: DataFrame, staged: DataFrame, objects: DataFrame) -> DataFrame:
    """wanted (chunk_id, ...) with bytes from the stage (chunk_id, bytes), or else from objects (object_id, bytes)."""
    got = wanted.join(staged.select("chunk_id", F.col("bytes").alias("_near")), "chunk_id", "left").join(objects.select(F.col("object_id").alias("chunk_id"), F.col("bytes").alias("_far")), "chunk_id", "left")
    return got.withColumn("bytes", F.coalesce("_near", "_far")).drop("_near", "_far")
