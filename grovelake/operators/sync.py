"""Planning of syncs between stores and repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import names_of

GROUP = ["repo_url", "branch", "base_commit"]


def current_states(states: DataFrame, force: bool = False) -> DataFrame:
    """One row per store of states (store, slot current or next, ...): the pending state where there is one, if forced.

    blocked tells that a pending state stands in the way.
    """
    pending = F.max(F.when(F.col("slot") == "next", F.struct(*[c for c in states.columns if c not in ("store", "slot")])))
    present = F.max(F.when(F.col("slot") == "current", F.struct(*[c for c in states.columns if c not in ("store", "slot")])))
    rows = states.groupBy("store").agg(pending.alias("n"), present.alias("c"))
    return rows.select("store", F.coalesce("n", "c").alias("s"), (F.col("n").isNotNull() & ~F.lit(force)).alias("blocked")).select("store", "s.*", "blocked")


def groups(items: DataFrame) -> DataFrame:
    """Each (repo_url, branch, base_commit) with the number of its items and its place among the bases of its branch."""
    per = items.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_items"))
    return per.withColumn("base_no", F.row_number().over(Window.partitionBy("repo_url", "branch").orderBy("base_commit")))


def ordered(items: DataFrame) -> DataFrame:
    """items with sync_no, the order within their group: deepest directory first, then by path."""
    depth = F.size(names_of(F.col("repo_dir")))
    return items.withColumn("depth", depth).withColumn("sync_no", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("depth"), "repo_dir", "store")))


def overlap(a: str, b: str) -> bool:
    x, y = a.strip("/"), b.strip("/")
    return x == y or not x or not y or x.startswith(y + "/") or y.startswith(x + "/")


def batches(items: DataFrame) -> DataFrame:
    """items with batch: in order, each goes to the first batch in which no directory overlaps its own.

    What overlaps within a group waits for the merged result of the batch before. The choice is sequential within a group, so each group is
    one call; groups hold the directories that are synced to one base of one branch, not data.
    """
    rows = ordered(items)

    def place(pdf):
        pdf = pdf.sort_values("sync_no").reset_index(drop=True)
        left, batch, out = list(range(len(pdf))), 0, [0] * len(pdf)
        dirs = pdf["repo_dir"].tolist()
        while left:
            taken, rest = [], []
            for i in left:
                if any(overlap(dirs[i], dirs[j]) for j in taken):
                    rest.append(i)
                else:
                    taken.append(i)
                    out[i] = batch
            left, batch = rest, batch + 1
        return pdf.assign(batch=out)

    schema = rows.select("*", F.lit(0).cast("int").alias("batch")).schema
    return rows.groupBy(*GROUP).applyInPandas(place, schema)


def add_sync_action(store_files: int, repo_entries: int, has_state: bool, has_pending: bool) -> str:
    """What adding a sync does, by what each side holds; a store without files is empty even if it has directories."""
    if has_pending or has_state:
        raise ValueError("the store is pending" if has_pending else "the store is already synced")
    if store_files and repo_entries:
        raise ValueError("both the store and the repository directory have content")
    return "upload" if store_files else "download" if repo_entries else "create"


def summary(results: DataFrame) -> DataFrame:
    """succeeded, failed, conflicts of results (ok, conflicts array)."""
    return results.agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum(F.size("conflicts")), F.lit(0)).cast("long").alias("conflicts"))
