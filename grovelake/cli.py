"""A thin command line: python -m grovelake.cli REPOSITORY COMMAND ..."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import canon, text
from .operators import chunks, walk
from .sources import file_store, syncing
from .sources.repository import Repository


def listed(entries: DataFrame, long: bool, json: bool, classify: bool) -> list[str]:
    """Lines of a listing of entries (name, kind, size, executable, target_id), by name."""
    rows = entries.orderBy("name")
    suffix = F.when(F.col("kind") == "Directory", "/").when(F.col("executable"), "*").otherwise("") if classify else F.lit("")
    shown = F.concat(text.shell_escaped(F.col("name")), suffix)
    if json:
        mode = F.when(F.col("executable"), ',"executable":true').otherwise("")
        size = F.when(F.col("kind") == "File", F.concat(F.lit(',"size":'), F.col("size").cast("string"), mode)).otherwise("")
        shown = F.concat(F.lit('{"type":"'), "kind", F.lit('"'), size, F.lit(',"name":'), canon.json_string(F.col("name")), F.lit("}"))
    elif long:
        width = entries.agg(F.max(F.length(F.col("size").cast("string")))).first()[0] or 0
        shown = F.concat(text.human_mode(F.col("kind"), F.col("executable")), F.lit(" "), F.lpad(F.coalesce(F.col("size").cast("string"), F.lit("")), width, " "), F.lit(" "), shown)
    return [r.line for r in rows.select(shown.alias("line"), "name").orderBy("name").collect()]


def columns(names: list[str], width: int, across: bool = False) -> list[str]:
    """Names in as many columns as fit, two spaces apart, down or across."""
    if not names:
        return []
    cell = max(map(len, names)) + 2
    n = max(1, (width + 2) // cell)
    rows = -(-len(names) // n)
    picked = [names[i : i + n] for i in range(0, len(names), n)] if across else [names[r::rows] for r in range(rows)]
    return ["".join(x.ljust(cell) for x in row).rstrip() for row in picked]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="grovelake")
    parser.add_argument("repository")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, args in {
        "initialize": (), "info": (), "get-current-root": (), "set-current-root": ("root",), "exists": ("id",), "read": ("id",),
        "upload-directory": ("folder",), "download-directory": ("id", "folder"), "ls": ("id",), "scan": ("folder",), "source-chunks": ("folder",),
        "write": ("file",), "upload-file": ("file",), "download-file": ("id", "file"), "branches": (), "resolve": ("id", "path"), "add-sync": ("store", "directory"), "sync": ("store",),
    }.items():
        sub = commands.add_parser(name)
        for a in args:
            sub.add_argument(a, nargs="+" if (name, a) == ("sync", "store") else None)
        if name == "add-sync":
            sub.add_argument("--branch", default=None)
        if name == "sync":
            sub.add_argument("--force", action="store_true")
        if name == "ls":
            for flag in ("--long", "--json", "--classify"):
                sub.add_argument(flag, action="store_true")
        if name == "download-directory":
            sub.add_argument("--dry-run", action="store_true")
        if name == "upload-directory":
            sub.add_argument("--branch", default=None)
            sub.add_argument("--message", default=None)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    repo = Repository(spark, a.repository)
    out: list[str] = []
    if a.command == "initialize":
        out = [repo.initialize()]
    elif a.command == "info":
        out = [repo.info()["uuid"]]
    elif a.command == "get-current-root":
        out = [repo.current_root() or "none"]
    elif a.command == "set-current-root":
        repo.set_current_root(a.root)
    elif a.command == "exists":
        out = [str(repo.exists(a.id)).lower()]
    elif a.command == "read":
        out = [repo.read(a.id).decode("utf-8", "replace")]
    elif a.command == "upload-directory":
        directory = syncing.upload(repo, a.folder)

        def publish(current: str) -> str:
            root = repo.read(current, "Root")
            branch = a.branch or root["defaultBranchName"]
            head = repo.branches(root["branches"]).where(F.col("name") == branch).first()
            commit = repo.next_commit(head.commit_id if head else None, directory, message=a.message)
            return repo.next_root(current, repo.next_branches(root["branches"], {branch: commit}))

        out = [directory, repo.update(publish)]
    elif a.command == "download-directory":
        out = syncing.download(repo, a.id, a.folder, a.dry_run)
    elif a.command == "write":
        with open(a.file, "rb") as f:
            row = spark.createDataFrame([(f.read(),)], "bytes binary").select(canon.object_id(F.col("bytes")).alias("object_id"), "bytes")
        repo.write(row)
        out = [row.first().object_id]
    elif a.command == "upload-file":
        with open(a.file, "rb") as f:
            out = [syncing.store_files(repo, spark.createDataFrame([(a.file, f.read())], "path string, content binary")).first().target_id]
    elif a.command == "download-file":
        row = syncing.file_contents(repo, spark.createDataFrame([(a.id,)], "target_id string")).first()
        repo.read(a.id, "File")
        with open(f"{a.file}.part", "wb") as f:
            f.write(row.content)
        os.replace(f"{a.file}.part", a.file)
    elif a.command == "branches":
        out = [f"{r.name} {r.commit_id}" for r in repo.branches(repo.root()["branches"]).orderBy("name").collect()]
    elif a.command == "resolve":
        got = repo.resolve(a.id, a.path)
        out = [" ".join(x for x in (got["found"], got["target_id"]) if x)]
    elif a.command == "add-sync":
        out = [syncing.add_sync(repo, repo.files.uri, a.store, a.directory, a.branch)]
    elif a.command == "sync":
        for r in syncing.run_syncs(repo, repo.files.uri, a.store, a.force):
            out.append(f"{r['store']}: {'synced' if r['ok'] else r.get('reason')}" + "".join(f"\n  conflict: {c}" for c in r["conflicts"]))
    elif a.command == "ls":
        start = spark.createDataFrame([("", a.id)], "list string, object_id string")
        out = listed(walk.list_directory(repo.structures(), start), a.long, a.json, a.classify)
    elif a.command == "scan":
        rows = file_store.entries(spark, a.folder).collect()
        for r in sorted(rows, key=lambda r: r.path.split("/")):
            indent = " " * 4 * r.path.count("/") + r.path.rpartition("/")[2]
            out.append(indent + ("/" if r.kind == "Directory" else f" ({r.size} bytes, {'x' if r.executable else '-'}, fingerprint: {r.fingerprint})"))
    elif a.command == "source-chunks":
        cut = chunks.chunk_contents(file_store.contents(spark, a.folder), "content", ["path"]).orderBy("path", "ix")
        out = [f"{r.path}: {r.offset}+{r.size}, hash: {r.chunk_id}" for r in cut.select("path", "offset", "size", "chunk_id").collect()]
    print("\n".join(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
