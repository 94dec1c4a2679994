"""A repository: objects in a Parquet table by the first two digits of their ids, a root pointer that is swapped atomically, evolution."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canon
from ..operators import search
from ..operators.trees import branch_lists
from ..operators.walk import list_branches, list_directory
from .hadoop_fs import Folder

OBJECT_SCHEMA = "object_id string, bytes binary, prefix string"


def object_json(spark: SparkSession, column) -> tuple[str, str]:
    """(id, JSON) of one object given as a column without inputs."""
    row = spark.range(1).select(column.alias("j")).select("j", canon.text_id(F.col("j")).alias("i")).first()
    return row.i, row.j


class PathError(ValueError):
    """A path that doesn't lead where it should: reason is NotFound or NotADirectory."""

    def __init__(self, reason: str, path: str):
        super().__init__(f"{reason}: {path}")
        self.reason, self.path = reason, path


class Repository:
    """Objects and a current root below a folder that all executors see, in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.files = spark, Folder(spark, folder)
        self.folder = self.files.uri.removeprefix("file://")

    @property
    def _objects(self) -> str:
        return f"{self.files.uri}/objects"

    def objects(self) -> DataFrame:
        """object_id, bytes; a filter on prefix and object_id reads one folder."""
        if not self.files.exists("objects"):
            return self.spark.createDataFrame([], OBJECT_SCHEMA)
        return self.spark.read.schema(OBJECT_SCHEMA).parquet(self._objects)

    def structures(self) -> DataFrame:
        """object_id, json of the objects that are small enough to be structures and begin as JSON objects do."""
        return self.objects().where(F.col("bytes").startswith(F.encode(F.lit("{"), "utf-8"))).select("object_id", F.decode("bytes", "utf-8").alias("json"))

    def write(self, new: DataFrame) -> None:
        """Add objects (object_id, bytes), each once, those that aren't there yet."""
        fresh = new.dropDuplicates(["object_id"]).withColumn("prefix", F.substring("object_id", 1, 2))
        if self.files.exists("objects"):
            fresh = fresh.join(self.objects().select("prefix", "object_id"), ["prefix", "object_id"], "left_anti")
        fresh.select("object_id", "bytes", "prefix").write.mode("append").partitionBy("prefix").parquet(self._objects)

    def write_structures(self, nodes: DataFrame) -> None:
        self.write(nodes.select("object_id", F.encode("json", "utf-8").alias("bytes")))

    def put(self, column) -> str:
        oid, text = object_json(self.spark, column)
        self.write_structures(self.spark.createDataFrame([(oid, text)], "object_id string, json string"))
        return oid

    def read(self, object_id: str, kind: str | None = None) -> dict | bytes:
        """An object: parsed if a kind is asked for, which it must have; else its bytes."""
        row = self.objects().where((F.col("prefix") == object_id[:2]) & (F.col("object_id") == object_id)).select("bytes").first()
        if row is None:
            raise KeyError(object_id)
        if kind is None:
            return bytes(row.bytes)
        got = json.loads(bytes(row.bytes))
        if got.get("type") != kind:
            raise TypeError(f"{object_id} is a {got.get('type')}, not a {kind}")
        return got

    def exists(self, object_id: str) -> bool:
        return not self.objects().where((F.col("prefix") == object_id[:2]) & (F.col("object_id") == object_id)).isEmpty()

    def _root_names(self) -> list[str]:
        return [n for n in self.files.names("roots") if n.isdigit()]

    def current_root(self) -> str | None:
        """The root of the highest number; each number is written once."""
        names = self._root_names()
        return self.files.read(f"roots/{names[-1]}") if names else None

    def set_current_root(self, root: str) -> None:
        while not self.swap_current_root(self.current_root(), root)[0]:
            pass

    def swap_current_root(self, expected: str | None, new: str) -> tuple[bool, str | None]:
        """(True, new), or (False, the root that is there instead of the one expected)."""
        names = self._root_names()
        now = self.files.read(f"roots/{names[-1]}") if names else None
        if now != expected:
            return False, now
        if self.files.create(f"roots/{int(names[-1]) + 1 if names else 0:020}", new):
            return True, new
        return False, self.current_root()

    def info(self) -> dict:
        return json.loads(self.files.read("repository.json"))

    def initialize(self, default_branch: str = "main", timestamp: str | None = None, name: str | None = None) -> str:
        """An empty directory, its commit, a branch and a root; an error where there is a repository."""
        if self.files.exists("repository.json"):
            raise FileExistsError(self.folder)
        when, none = timestamp or datetime.now(timezone.utc).isoformat(), F.lit(None).cast("string")
        directory = self.put(canon.directory_object(F.array().cast("array<string>")))
        commit = self.put(canon.commit_object(F.lit(directory), F.array().cast("array<string>"), F.lit(when), none, none, F.lit("Repository initialization")))
        branches = self.put(canon.branches_object(F.array(canon.branch(F.lit(default_branch), F.lit(commit)))))
        root = self.put(canon.root_object(F.lit(when), F.lit(default_branch), F.lit(branches), none))
        self.set_current_root(root)
        self.files.replace("repository.json", json.dumps({"uuid": name or str(uuid.uuid4())}))
        return root

    def root(self) -> dict:
        """The current root."""
        now = self.current_root()
        if now is None:
            raise KeyError("there is no current root")
        return self.read(now, "Root")

    def branch(self, name: str | None = None) -> str | None:
        """The commit of a branch, the default one if no name is given; None where there is none by that name."""
        root = self.root()
        wanted = self.spark.createDataFrame([("", root["branches"], name or root["defaultBranchName"])], "list string, object_id string, name string")
        row = search.find_branches(self.structures(), wanted).first()
        if row is None and name is None:
            raise KeyError(f"the default branch {root['defaultBranchName']} isn't there")
        return row.target_id if row else None

    def directory(self, commit: str) -> str:
        """The directory of a commit."""
        return self.read(commit, "Commit")["directory"]

    def entries(self, directory: str) -> DataFrame:
        """kind, name, size, executable, target_id of a directory's entries."""
        at = self.spark.createDataFrame([("", directory)], "list string, object_id string")
        return list_directory(self.structures(), at).drop("list", "at")

    def find_entry(self, directory: str, name: str) -> dict | None:
        """The entry of a directory by its name."""
        wanted = self.spark.createDataFrame([("", directory, name)], "list string, object_id string, name string")
        row = search.find_entries(self.structures(), wanted).drop("list").first()
        return row.asDict() if row else None

    def resolve(self, directory: str, path: str) -> dict:
        """found (Root, Directory, File or None), target_id, size, executable of a path below a directory."""
        root = self.spark.createDataFrame([(directory,)], "object_id string")
        return search.resolve(self.structures(), root, self.spark.createDataFrame([(path,)], "path string")).drop("path").first().asDict()

    def resolve_to_directory(self, directory: str, path: str) -> str:
        """The id of the directory at a path; a PathError where there is none or something else."""
        got = self.resolve(directory, path)
        if got["found"] not in ("Root", "Directory"):
            raise PathError("NotADirectory" if got["found"] == "File" else "NotFound", path)
        return got["target_id"]

    def next_commit(self, current: str | None, directory: str, extra_parents: tuple[str, ...] = (), timestamp: str | None = None, author: str | None = None, committer: str | None = None, message: str | None = None) -> str:
        parents = [p for p in (current, *extra_parents) if p]
        ids = F.array(*map(F.lit, parents)) if parents else F.array().cast("array<string>")
        text = lambda v: F.lit(v).cast("string")
        return self.put(canon.commit_object(F.lit(directory), ids, F.lit(timestamp or datetime.now(timezone.utc).isoformat()), text(author), text(committer), text(message)))

    def branches(self, branches_id: str) -> DataFrame:
        start = self.spark.createDataFrame([("", branches_id)], "list string, object_id string")
        return list_branches(self.structures(), start).select("name", F.col("target_id").alias("commit_id"))

    def next_branches(self, branches_id: str, changes: dict[str, str | None]) -> str:
        """The list with branches set to commits, or removed where the commit is None."""
        kept = self.branches(branches_id).where(~F.col("name").isin(*changes)) if changes else self.branches(branches_id)
        new = self.spark.createDataFrame([(n, c) for n, c in changes.items() if c], "name string, commit_id string")
        roots, nodes = branch_lists(kept.unionByName(new).withColumn("list", F.lit("")))
        self.write_structures(nodes)
        row = roots.first()
        return row.object_id if row else self.put(canon.branches_object(F.array().cast("array<string>")))

    def next_root(self, current: str, branches: str | None = None, default_branch: str | None = None, timestamp: str | None = None) -> str:
        now = self.read(current, "Root")
        when = timestamp or datetime.now(timezone.utc).isoformat()
        return self.put(canon.root_object(F.lit(when), F.lit(default_branch or now["defaultBranchName"]), F.lit(branches or now["branches"]), F.lit(current)))

    def update(self, change: Callable[[str], str], attempts: int = 10) -> str:
        """Swap in change(current root) as the new root; made again from the root that got ahead, up to attempts times."""
        for _ in range(attempts):
            current = self.current_root()
            new = change(current)
            if self.swap_current_root(current, new)[0]:
                return new
        raise RuntimeError(f"the root changed {attempts} times")
