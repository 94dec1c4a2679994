"""Merging directories and commits of a repository, and syncing stores with it."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import caches, chunks, merge, reconcile, sync, trees, walk
from . import file_store
from .hadoop_fs import Folder, uri
from .repository import PathError, Repository
from .sync_state import StateFile, SyncState


def scanned(repo: Repository, directory: str) -> DataFrame:
    """path, kind, size, executable, target_id below a directory, the directory itself left out."""
    return trees.cut_lineage(walk.scan(repo.structures(), repo.spark.createDataFrame([(directory,)], "object_id string")).where("path <> ''"))


def _whole(wanted: DataFrame, parts: DataFrame) -> DataFrame:
    """target_id, content of wanted (list) from the bytes of their parts (list, at, bytes)."""
    data = parts.groupBy("list").agg(F.array_sort(F.collect_list(F.struct("at", "bytes"))).alias("p"))
    whole = data.select(F.col("list").alias("target_id"), F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["bytes"])).alias("content"))
    return whole.unionByName(wanted.join(data, "list", "left_anti").select(F.col("list").alias("target_id"), F.lit(b"").alias("content")))


def _wanted(ids: DataFrame) -> DataFrame:
    return ids.select(F.col("target_id").alias("list"), F.col("target_id").alias("object_id")).where("list is not null").distinct()


def file_contents(repo: Repository, ids: DataFrame) -> DataFrame:
    """target_id, content of files (target_id), each once."""
    wanted = _wanted(ids)
    parts = walk.list_file(repo.structures(), wanted).join(repo.objects().select(F.col("object_id").alias("target_id"), "bytes"), "target_id")
    return _whole(wanted, parts)


class Stage:
    """Chunks of a download, fetched before anything in the store changes; what was fetched before an interruption is kept."""

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.files = spark, Folder(spark, place)

    def chunks(self) -> DataFrame:
        """chunk_id, bytes."""
        schema = "chunk_id string, bytes binary"
        if not self.files.exists("chunks"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.files.uri}/chunks")

    def fetch(self, repo: Repository, parts: DataFrame, ids: DataFrame) -> None:
        """Stage the chunks of files (target_id) that aren't yet; parts: list, size, target_id of their chunks."""
        rows = parts.select(F.col("list").alias("file_id"), "size", F.col("target_id").alias("chunk_id"))
        missing = reconcile.chunks_to_stage(ids, rows, self.chunks().select("chunk_id"))
        data = missing.join(repo.objects().select(F.col("object_id").alias("chunk_id"), "bytes"), "chunk_id").select("chunk_id", "bytes")
        data.write.mode("append").parquet(f"{self.files.uri}/chunks")

    def contents(self, repo: Repository, parts: DataFrame, ids: DataFrame) -> DataFrame:
        """target_id, content of files: from the stage, or from the repository where a chunk isn't there."""
        read = reconcile.read_staged(parts.withColumnRenamed("target_id", "chunk_id"), self.chunks().dropDuplicates(["chunk_id"]), repo.objects())
        return _whole(_wanted(ids), read.select("list", "at", "bytes"))

    def clear(self) -> None:
        self.files.delete_all()


class FingerprintCache:
    """store, path, fingerprint, object_id, at: files as they were last read or written, in a folder of versions."""

    SCHEMA = "store string, path string, fingerprint string, object_id string, at string"

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.files = spark, Folder(spark, place)

    def table(self) -> DataFrame:
        now = self.files.read("current")
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.files.uri}/{now}") if now else self.spark.createDataFrame([], self.SCHEMA)

    def upsert(self, rows: DataFrame) -> None:
        """Put rows (store, path, fingerprint, object_id) over the table; the new version is complete before it is the current one."""
        new = f"version-{uuid.uuid4().hex}"
        now = rows.withColumn("at", F.lit(datetime.now(timezone.utc).isoformat()))
        caches.upsert(self.table(), now, ["store", "path"], "at").write.parquet(f"{self.files.uri}/{new}")
        self.files.replace("current", new)


def store_files(repo: Repository, files: DataFrame) -> DataFrame:
    """path, size, target_id of files (path, content), their chunks and objects written."""
    cut = trees.cut_lineage(chunks.chunk_contents(files, "content", ["path"]))
    repo.write(cut.select(F.col("chunk_id").alias("object_id"), "bytes"))
    ids, nodes = chunks.file_ids(cut.drop("bytes"), files.select("path"), "path")
    repo.write_structures(nodes)
    return trees.cut_lineage(ids.select("path", "size", F.col("object_id").alias("target_id")))


def upload(repo: Repository, folder: str, cache: FingerprintCache | None = None) -> str:
    """Store the files below a folder; the id of its directory. Files whose fingerprints the cache knows aren't read."""
    entries = trees.cut_lineage(file_store.entries(repo.spark, folder))
    files = entries.where("kind = 'File'")
    known = None
    if cache:
        named = files.select(F.lit(uri(folder)).alias("store"), "path", "fingerprint", "size", "executable")
        # Chunks are written before the objects that name them, so a file's object stands for all of it.
        known = trees.cut_lineage(caches.uploads(named, cache.table(), repo.objects().select("object_id")))
    todo = files if known is None else known.where("object_id is null")
    ids = store_files(repo, file_store.contents(repo.spark, folder, todo))
    placed = todo.select("path", "executable").join(ids, "path").select("path", "size", "executable", "target_id")
    if known is not None:
        cache.upsert(known.where("object_id is null").join(ids, "path").select("store", "path", "fingerprint", F.col("target_id").alias("object_id")))
        placed = placed.unionByName(known.where("object_id is not null").select("path", "size", "executable", F.col("object_id").alias("target_id")))
    dirs, nodes = trees.tree(placed, entries.where("kind = 'Directory'").select("path"))
    repo.write_structures(nodes)
    return dirs.where("path = ''").first().object_id


def graft(repo: Repository, root: str, path: str, directory: str) -> str:
    """The root directory with another directory at a path; what stood there goes. The root's own path replaces all of it."""
    path = "/".join(p for p in path.split("/") if p)
    if not path:
        return directory
    at = repo.spark.createDataFrame([(path, directory)], "path string, object_id string")
    rows = scanned(repo, root).where(~((F.col("path") == path) | F.startswith("path", F.lit(path + "/"))))
    in_way = rows.where(F.lit(path).startswith(F.concat(F.col("path"), F.lit("/"))) & (F.col("kind") == "File"))
    files = rows.where("kind = 'File'").join(in_way.select("path"), "path", "left_anti").select("path", "size", "executable", "target_id")
    dirs, nodes = trees.tree(files, rows.where("kind = 'Directory'").select("path"), skip=at)
    repo.write_structures(nodes)
    return dirs.where("path = ''").first().object_id


def directory_at(repo: Repository, root: str, path: str) -> str | None:
    """The id of the directory at a path below a root, None where there is none."""
    try:
        return repo.resolve_to_directory(root, path)
    except PathError:
        return None


#: The rest of the script that ends a conflict; a version that isn't there was removed on its side.
TAKE = """ in the place of this directory: ./take base, theirs, ours or merged.
set -e
here=$(cd "$(dirname "$0")" && pwd)
case "$1" in
merged) test -e "$here/merged" || { echo "nothing was merged" >&2; exit 1; } ;;
base | theirs | ours) ;;
*) echo "usage: $0 base|theirs|ours|merged" >&2; exit 2 ;;
esac
if test -e "$here/$1"; then mv "$here/$1" "$here.taken"; fi
rm -r "$here"
if test -e "$here.taken"; then mv "$here.taken" "$here"; fi
"""



def merge_directories(repo: Repository, base: str | None, one: str, two: str, limit: int = 1 << 30) -> tuple[str, list[str]]:
    """(id of the merged directory, paths of conflicts). Subtrees that a side takes over are taken by id and not read."""
    spark = repo.spark
    sides = [s for s in (("base", base), ("theirs", one), ("ours", two)) if s[1]]
    snaps = None
    for side, directory in sides:
        rows = scanned(repo, directory).withColumn("side", F.lit(side))
        snaps = rows if snaps is None else snaps.unionByName(rows)
    decided = trees.cut_lineage(merge.decisions(merge.zipper(snaps)))
    content = F.when(F.col("base.target_id") != F.col("one.target_id"), F.col("one")).otherwise(F.col("two"))
    chosen = F.when(F.col("action").isin("TakeEither", "Take1"), F.col("one")).when(F.col("action") == "Take2", F.col("two")).when(F.col("action") == "TakeFile", content)
    taken = decided.where("action in ('TakeEither', 'Take1', 'Take2', 'TakeFile')").select("path", F.coalesce("executable", chosen["executable"]).alias("executable"), chosen.alias("c"))
    files = taken.where("c.kind = 'File'").select("path", "c.size", "executable", "c.target_id")
    known = taken.where("c.kind = 'Directory'").select("path", F.col("c.target_id").alias("object_id"))
    dirs = decided.where("action = 'MergeDirectories'").select("path")

    texts = decided.where("action = 'MergeFiles'")
    sized = sum((F.coalesce(F.col(f"{s}.size"), F.lit(0)) for s in ("base", "one", "two")), F.lit(0))
    data = trees.cut_lineage(file_contents(repo, texts.where(sized <= limit).select(F.explode(F.array("base.target_id", "one.target_id", "two.target_id")).alias("target_id"))))
    triple = texts.where(sized <= limit).select("path", F.when(F.col("base.kind") == "File", F.col("base.target_id")).alias("b"), F.col("one.target_id").alias("x"), F.col("two.target_id").alias("y"))
    for key, name in (("b", "base"), ("x", "one"), ("y", "two")):
        triple = triple.join(data.select(F.col("target_id").alias(key), F.col("content").alias(name)), key, "left")
    tried = merge.text_merges(triple.select("path", "base", "one", "two"), limit)
    large = texts.where(sized > limit).select("path", F.lit("TooLarge").alias("outcome"), F.lit(None).cast("binary").alias("content"))
    tried = trees.cut_lineage(tried.unionByName(large))
    merged = tried.where("outcome = 'Merged'").join(texts.select("path", "executable"), "path")

    conflicts = decided.where("action = 'Conflict'").withColumn("outcome", F.lit(None).cast("string")).unionByName(texts.join(tried.where("outcome <> 'Merged'").select("path", "outcome"), "path").select(*decided.columns, "outcome"))
    conflicts = trees.cut_lineage(merge.conflict_text(conflicts))
    held = merge.conflict_entries(conflicts).where("target_id is not null").withColumn("path", F.concat_ws("/", "path", "entry"))
    made = conflicts.select(F.concat_ws("/", "path", F.lit("CONFLICT.txt")).alias("path"), F.encode("text", "utf-8").alias("content"), F.lit(False).alias("executable"))
    script = F.encode(F.concat(F.lit("#!/bin/sh\n# Puts a version of "), F.replace("name", F.lit("\n"), F.lit(" ")), F.lit(TAKE)), "utf-8")
    made = made.unionByName(conflicts.select(F.concat_ws("/", "path", F.lit("take")).alias("path"), script.alias("content"), F.lit(True).alias("executable")))
    made = made.unionByName(tried.where("outcome = 'MergeConflict'").select(F.concat_ws("/", "path", F.lit("merged")).alias("path"), "content", F.lit(False).alias("executable")))
    made = trees.cut_lineage(made.unionByName(merged.select("path", "content", "executable")))
    ids = store_files(repo, made.select("path", "content"))
    files = files.unionByName(ids.join(made.select("path", "executable"), "path").select("path", "size", "executable", "target_id"))
    files = files.unionByName(held.where("kind = 'File'").select("path", "size", "executable", "target_id"))
    known = known.unionByName(held.where("kind = 'Directory'").select("path", F.col("target_id").alias("object_id")))
    built, nodes = trees.tree(trees.cut_lineage(files), dirs, skip=trees.cut_lineage(known))
    repo.write_structures(nodes)
    return built.where("path = ''").first().object_id, sorted(r.path for r in conflicts.select("path").collect())


def merge_commits(repo: Repository, base: str, one: str, two: str, limit: int = 1 << 30, **metadata) -> tuple[str, list[str]]:
    """(commit, conflicts): the other side where one is the base, else a commit of both with their directories merged."""
    if base == one:
        return two, []
    if base == two:
        return one, []
    directory = lambda c: repo.read(c, "Commit")["directory"]
    merged, conflicts = merge_directories(repo, directory(base), directory(one), directory(two), limit)
    return repo.next_commit(one, merged, (two,), **metadata), conflicts


def download(repo: Repository, directory: str, folder: str, dry: bool = False, cache: FingerprintCache | None = None, stage: Stage | None = None) -> list[str]:
    """Bring a folder to the state of a directory; the lines of the plan, which is all that is made of it if dry.

    Files whose fingerprints the cache knows to be the ones wanted stay. With a stage, all chunks are fetched first and the folder
    is changed afterwards; the stage is cleared when all is done.
    """
    here = uri(folder)
    store = file_store.entries(repo.spark, folder).select("path", "kind", "executable", "fingerprint")
    known = cache.table().where(F.col("store") == here) if cache else repo.spark.createDataFrame([], FingerprintCache.SCHEMA)
    store = store.join(known.select("path", F.col("fingerprint").alias("cached_fingerprint"), F.col("object_id").alias("cached_id")), "path", "left")
    steps = trees.cut_lineage(reconcile.plan(scanned(repo, directory).select("path", "kind", "target_id", "executable"), store))
    lines = [r.line for r in reconcile.rendered(reconcile.in_order(steps)).collect()]
    if dry:
        return lines
    ids = steps.where("action = 'download'").select("target_id")
    if stage:
        parts = trees.cut_lineage(walk.list_file(repo.structures(), _wanted(ids)))
        stage.fetch(repo, parts, ids)
        file_store.apply(steps, folder, stage.contents(repo, parts, ids))
        stage.clear()
    else:
        file_store.apply(steps, folder, file_contents(repo, ids))
    if cache:
        done = steps.where("action = 'download'").select("path", "target_id")
        now = file_store.entries(repo.spark, folder).where("kind = 'File'").join(done, "path")
        cache.upsert(trees.cut_lineage(now.select(F.lit(here).alias("store"), "path", "fingerprint", F.col("target_id").alias("object_id"))))
    return lines


def add_sync(repo: Repository, url: str, store: str, repo_dir: str, branch: str | None = None) -> str:
    """Begin to sync a store with a directory of a repository: upload, download or nothing, by which side has content."""
    root = repo.read(repo.current_root(), "Root")
    branch = branch or root["defaultBranchName"]
    head = repo.branches(root["branches"]).where(F.col("name") == branch).first().commit_id
    state = StateFile(store, repo.spark)
    at = directory_at(repo, repo.read(head, "Commit")["directory"], repo_dir)
    held = scanned(repo, at).count() if at else 0
    files = file_store.entries(repo.spark, store).where("kind = 'File'").count()
    todo = sync.add_sync_action(files, held, state.current() is not None, state.next() is not None)
    if todo in ("upload", "create"):
        new = upload(repo, store)

        def publish(current: str) -> str:
            now = repo.read(current, "Root")
            parent = repo.branches(now["branches"]).where(F.col("name") == branch).first().commit_id
            grafted = graft(repo, repo.read(parent, "Commit")["directory"], repo_dir, new)
            commit = repo.next_commit(parent, grafted, message=f"add sync of {repo_dir.strip('/') or '/'}")
            return repo.next_root(current, repo.next_branches(now["branches"], {branch: commit}))

        root = repo.read(repo.update(publish), "Root")
        head = repo.branches(root["branches"]).where(F.col("name") == branch).first().commit_id
    else:
        download(repo, at, store)
    state.set_next(SyncState(datetime.now(timezone.utc).isoformat(), url, repo_dir, branch, head))
    state.commit_next()
    return todo


def run_syncs(repo: Repository, url: str, stores: list[str], force: bool = False, limit: int = 1 << 30) -> list[dict]:
    """Sync stores with a repository; for each, in order: its commit and the conflicts, or why it was not synced.

    Stores of one branch and base go together: their uploads are grafted on the base, those that overlap in later commits; the
    result is merged with the branch, published, and brought to the stores.
    """
    results: dict[str, dict] = {}
    items = []
    for s in stores:
        file = StateFile(s, repo.spark)
        state = file.current()
        if file.next() is not None:
            if not force:
                results[s] = {"store": s, "ok": False, "reason": "pending", "conflicts": []}
                continue
            state = file.next()
        if state is None or state.repository_url != url:
            results[s] = {"store": s, "ok": False, "reason": "not synced", "conflicts": []}
            continue
        items.append((s, state.repository_url, state.branch_name, state.base_commit, state.repository_directory))
    if items:
        df = repo.spark.createDataFrame(items, "store string, repo_url string, branch string, base_commit string, repo_dir string")
        planned = sorted(sync.batches(df).collect(), key=lambda r: (r.branch, r.base_commit, r.batch, r.sync_no))
        conflicts: dict[str, list[str]] = {}

        def publish(current: str) -> str:
            conflicts.clear()
            now = repo.read(current, "Root")
            heads = {r.name: r.commit_id for r in repo.branches(now["branches"]).collect()}
            for branch, base in sorted({(r.branch, r.base_commit) for r in planned}):
                own = [r for r in planned if (r.branch, r.base_commit) == (branch, base)]
                for batch in sorted({r.batch for r in own}):
                    directory = repo.read(base, "Commit")["directory"]
                    for r in own:
                        if r.batch == batch:
                            directory = graft(repo, directory, r.repo_dir, upload(repo, r.store))
                    if directory == repo.read(base, "Commit")["directory"]:
                        continue
                    ours = repo.next_commit(base, directory, message="sync")
                    heads[branch], found = merge_commits(repo, base, heads[branch], ours, limit, message="sync")
                    conflicts.setdefault(branch, []).extend(found)
            return repo.next_root(current, repo.next_branches(now["branches"], heads))

        root = repo.read(repo.update(publish), "Root")
        heads = {r.name: r.commit_id for r in repo.branches(root["branches"]).collect()}
        for r in planned:
            head, file = heads[r.branch], StateFile(r.store, repo.spark)
            file.set_next(replace(file.next() or file.current(), base_commit=head))
            at = directory_at(repo, repo.read(head, "Commit")["directory"], r.repo_dir)
            if at:
                download(repo, at, r.store)
            file.commit_next()
            inside = [c for c in conflicts.get(r.branch, []) if sync.overlap(r.repo_dir, c) and sync.overlap(c, r.repo_dir)]
            results[r.store] = {"store": r.store, "ok": True, "commit": head, "conflicts": inside}
    return [results[s] for s in stores]
