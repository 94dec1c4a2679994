"""Paths, sizes and renderings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: characters for which a name is quoted.
SHELL_SPECIAL = r"[ \t\n\r\\'\"`$!*?\[\]{}|&;<>()#~]"


def names_of(path: Column) -> Column:
    """The names of a path; empty ones are dropped."""
    return F.filter(F.split(path, "/", -1), lambda p: p != "")


def normal_path(path: Column) -> Column:
    return F.array_join(names_of(path), "/")


def resolved_path(base: Column, path: Column) -> Column:
    """An absolute path as it is, any other joined to the base; both normalised, with a leading slash."""
    return F.concat(F.lit("/"), F.when(F.startswith(path, F.lit("/")), normal_path(path)).otherwise(normal_path(F.concat_ws("/", base, path))))


def parent_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def overlaps(a: Column, b: Column) -> Column:
    """Whether two normalised paths are equal or one holds the other; the empty path holds all."""
    within = lambda x, y: (x == "") | F.startswith(y, F.concat(x, F.lit("/")))
    return (a == b) | within(a, b) | within(b, a)


def fingerprint(millis: Column, size: Column, executable: Column) -> Column:
    """Milliseconds since the epoch of the last change, size, and x or -."""
    return F.concat_ws(":", millis.cast("string"), size.cast("string"), F.when(executable, "x").otherwise("-"))


def executable_mode(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(0o111)) != 0


def shell_escaped(name: Column) -> Column:
    quoted = F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return F.when(name.rlike(SHELL_SPECIAL), quoted).otherwise(name)


def byte_size(text: Column) -> Column:
    """Bytes from digits and a unit B, K, KB, M, MB, G, GB, T, TB (base 1024, any case); saturates at the largest long; else null."""
    upper = F.upper(F.trim(text))
    digits, unit = F.regexp_extract(upper, r"^([0-9]+)\s*(B|[KMGT]B?)?$", 1), F.regexp_extract(upper, r"^([0-9]+)\s*(B|[KMGT]B?)?$", 2)
    power = F.when(F.startswith(unit, F.lit("K")), 1).when(F.startswith(unit, F.lit("M")), 2).when(F.startswith(unit, F.lit("G")), 3).when(F.startswith(unit, F.lit("T")), 4).otherwise(0)
    most = (1 << 63) - 1
    unit_size = F.element_at(F.array(*(F.lit(1 << 10 * k) for k in range(5))), power + 1)
    count = F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 18, digits).otherwise(F.lit(str(most))).cast("long")
    return F.when(digits == "", None).when(count > F.floor(F.lit(most) / unit_size), F.lit(most)).otherwise(F.try_multiply(count, unit_size))


def effective_limit(*levels: Column) -> Column:
    """The limit that holds, from the nearest level to the farthest: a number, 'none' for disabled, null or 'inherit' for the next."""
    return F.nullif(F.coalesce(*(F.nullif(v, F.lit("inherit")) for v in levels)), F.lit("none")).cast("long")


def human_mode(kind: Column, executable: Column) -> Column:
    return F.when(kind == "Directory", "d").when(executable, "x").otherwise("-")


def reverse_timestamp(millis: Column) -> Column:
    """2**64 - 1 - milliseconds, as 20 digits: the newest name sorts first."""
    return F.lpad((F.lit(str((1 << 64) - 1)).cast("decimal(20,0)") - millis.cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")
