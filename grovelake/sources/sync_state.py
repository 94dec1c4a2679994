"""The state of a store's sync: what it was last brought to, and what it is being brought to."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

from .hadoop_fs import Folder, uri


@dataclass(frozen=True)
class SyncState:
    created_at: str
    repository_url: str
    repository_directory: str
    branch_name: str
    base_commit: str


class StateFile:
    """Current and next state in a store's hidden folder, in any file system that Spark knows."""

    def __init__(self, store: str, spark: SparkSession | None = None):
        self.files = Folder(spark or SparkSession.active(), f"{uri(store)}/.tfs")

    def _read(self, slot: str) -> SyncState | None:
        text = self.files.read(f"sync_{slot}.json")
        return SyncState(**json.loads(text)) if text else None

    def current(self) -> SyncState | None:
        return self._read("current")

    def next(self) -> SyncState | None:
        return self._read("next")

    def set_next(self, state: SyncState | None) -> None:
        if state is None:
            if self.files.exists("sync_next.json"):
                self.files.delete("sync_next.json")
            return
        self.files.replace("sync_next.json", json.dumps(asdict(state)))

    def commit_next(self) -> None:
        """Make the next state the current one."""
        if self.next() is None:
            raise ValueError("there is no next state")
        self.files.move("sync_next.json", "sync_current.json")
