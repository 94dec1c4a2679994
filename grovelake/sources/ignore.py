"""Ignore rules in the manner of gitignore files, matched against bare names.

Rules of all stores and directories form a table; a name meets the rules of the directories above it by equality of the directory, the
first decisive scope from the root down holds, within a scope its last matching rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import name_of, names_of, parent_of
from ..operators.edit import ancestors

#: Directories that are never scanned, and the files that hold rules, in the order in which they are read.
DEFAULT_IGNORES = (".git/", ".tfs/")
IGNORE_FILES = (".gitignore", ".tfsignore")


def pattern(glob: str) -> tuple[str, bool, bool] | None:
    """(regular expression for a bare name, directories only, negated) of a line; None for a blank or comment."""
    line = glob.rstrip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line[1:] if line.startswith(("\\#", "\\!")) else line
    only_dirs = line.endswith("/")
    line = line.strip("/")
    if "/" in line:
        line = line[3:] if line.startswith("**/") and "/" not in line[3:] else line
    out, i = [], 0
    while i < len(line):
        c = line[i]
        end = line.find("]", i + 2) if c == "[" else -1
        if c == "*":
            while line[i + 1 : i + 2] == "*":
                i += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif end > 0:
            inner = line[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]")
            i = end
        elif c == "\\" and i + 1 < len(line):
            i += 1
            out.append("\\" + line[i] if not line[i].isalnum() else line[i])
        else:
            out.append(c if c.isalnum() or c in "_/" or ord(c) > 127 else "\\" + c)
        i += 1
    return f"^{''.join(out)}$", only_dirs, negated


def rules_table(spark: SparkSession, texts: list[tuple[str, str]], global_rules: tuple[str, ...] = DEFAULT_IGNORES) -> DataFrame:
    """dir, ord, regex, only_dirs, negated of texts (directory, content of its ignore files); dir null for the global rules."""
    rows = [(None, i, *p) for i, g in enumerate(global_rules) if (p := pattern(g))]
    for d, text in texts:
        rows += [(d, i, *p) for i, g in enumerate(text.split("\n")) if (p := pattern(g))]
    return spark.createDataFrame(rows, "dir string, ord int, regex string, only_dirs boolean, negated boolean")


def ignored(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """path of the entries (path, kind) that a rule decides to ignore, not counting what only lies below such a directory."""
    global_rows = rules.where("dir is null").orderBy("ord").collect()  # a setting, not data
    own = rules.where("dir is not null")
    name, is_dir = name_of(F.col("path")), F.col("kind") == "Directory"
    hit = lambda r: name.rlike(r["regex"]) & (is_dir if r["only_dirs"] else F.lit(True))
    verdict: Column = reduce(lambda so_far, r: F.when(hit(r), not r["negated"]).otherwise(so_far), global_rows, F.lit(None).cast("boolean"))
    holders = F.concat(F.array(F.lit("")), ancestors(F.col("path")))
    met = entries.select("path", "kind", verdict.alias("_global"), F.explode(holders).alias("dir"))
    matched = met.join(own, "dir", "left").withColumn("_m", F.coalesce(F.regexp_like(name, F.col("regex")) & (is_dir | ~F.col("only_dirs")), F.lit(False)))
    depth = F.size(names_of(F.col("dir")))
    scoped = matched.groupBy("path", "_global", depth.alias("_depth")).agg(F.max_by(F.when(F.col("_m"), ~F.col("negated")), F.when(F.col("_m"), F.col("ord")).otherwise(-1)).alias("_v"))
    first = scoped.groupBy("path", "_global").agg(F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col("_depth")).otherwise(1 << 30)).alias("_v"))
    return first.where(F.coalesce("_global", "_v", F.lit(False))).select("path")


def visible(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """entries without those ignored and all that lies below an ignored directory."""
    out = ignored(entries, rules).select(F.col("path").alias("_at"))
    below = entries.select("path", F.explode(ancestors(F.col("path"), True)).alias("_at")).join(out, "_at").select("path").distinct()
    return entries.join(below, "path", "left_anti")


def children(entries: DataFrame, directory: str) -> DataFrame:
    """The entries directly in a directory, by name."""
    return entries.where((parent_of(F.col("path")) == directory) & (F.col("path") != "")).orderBy(name_of(F.col("path")))
