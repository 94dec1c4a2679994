"""Secret scans by multipart credential linking (native DataFrame functions only).

Base findings stand by themselves. Weak candidates (an identifier without a known prefix, an opaque token, an endpoint)
are too common to report alone; they are reported only when the parts that complete a credential stand within the
same scope, a number of code points around them. That interval join is one sweep along the parts of a document in order of
their starts: the furthest end among earlier parts of a class and the first start among later ones decide whether one is
in scope, so a document with many parts makes no pairs of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, let, stored

#: Fixed values of the contract: the base patterns, the group measured and its least length. Order is that of kinds.
BASE = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Names of identifiers, and access ids of other kinds than the base one.
ID_NAMES = ("username", "userid", "login", "accountid", "clientid", "keyid")
ID_PREFIXES = ("ASIA", "AROA", "AIDA", "AGPA", "ANPA", "ABIA", "ACCA")


def _either_case(name: str) -> str:
    """A pattern of an ASCII name in either case, with a hyphen or underline where its id or name begins."""
    stem = next((name.removesuffix(end) for end in ("name", "id") if name.endswith(end)), name)
    spelt = lambda part: "".join(f"[{c}{c.upper()}]" for c in part)
    return spelt(stem) + ("[_-]?" + spelt(name[len(stem) :]) if stem != name else "")


#: Weak parts: an identifier assigned by name, in either case and after other words of the name, or known by its prefix; a long
#: token of mixed letters and digits; an address with a scheme.
WEAK = {
    "identifier": rf"""(?<![A-Za-z0-9_])(?:(?:[A-Za-z0-9]{{1,24}}[_-]){{0,4}}(?:{"|".join(map(_either_case, ID_NAMES))})["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{{4,}}|(?:{"|".join(ID_PREFIXES)})[A-Z0-9]{{16,}})""",
    "opaque": r"[A-Za-z0-9+/_-]{20,}",
    "endpoint": r"""(?<![A-Za-z0-9_])(?:https?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[A-Za-z0-9._~:/?#@%&+=-]{4,}""",
}
KINDS = (*BASE, *WEAK)
IDENTIFIERS, SECRETS, ENDPOINTS = ("access", "identifier"), ("assign", "hex", "opaque"), ("endpoint",)

_BLOCK = 256


def _scan(steps: Column, start: Column) -> Column:
    """Running totals before each step."""
    state = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(steps, state, lambda s, x: F.struct((s["at"] + x).cast("int").alias("at"), F.array_append(s["out"], s["at"]).alias("out")))["out"]


def before_each(steps: Column) -> Column:
    """Running totals before each of many steps, in blocks, so that no long array is copied for each of its items."""
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int"))), lambda b: F.slice(steps, b * _BLOCK + 1, _BLOCK))
    total = lambda b: F.aggregate(b, F.lit(0), lambda s, x: (s + x).cast("int"))
    return let(cut, lambda blocks: F.flatten(F.zip_with(blocks, _scan(F.transform(blocks, total), F.lit(0)), _scan)))


def spans(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, kind (number), stop>> of the leftmost non-overlapping matches; code points, stop exclusive."""
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")

    def placed(p: Column) -> Column:
        gaps = F.slice(F.transform(p["gaps"], F.length), 1, F.size(p["found"]))
        sizes = F.transform(p["found"], F.length)
        steps = F.zip_with(gaps, sizes, lambda g, m: (g + m).cast("int"))
        starts = F.zip_with(before_each(steps), gaps, lambda a, g: (a + g).cast("int"))
        made = F.zip_with(starts, sizes, lambda a, m: F.struct(a.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (a + m).cast("int").alias("stop")))
        long = F.transform(p["measured"], lambda m: F.length(m) >= least)
        return F.transform(F.filter(F.arrays_zip(made.alias("span"), long.alias("long")), lambda x: x["long"]), lambda x: x["span"])

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("measured"))
    least_pattern = {"hex": r"[0-9a-f]{24}", "access": r"AKIA[A-Z0-9]{16}"}.get(kind, pattern)
    return F.when(text.rlike(least_pattern), let(parts, placed)).otherwise(none)


def _mixed(text: Column, span: Column) -> Column:
    token = F.substring(text, span["start"] + 1, span["stop"] - span["start"])
    return token.rlike("[A-Z]") & token.rlike("[a-z]") & token.rlike("[0-9]")


def _joined(found: Column) -> Column:
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", name(x), x["start"], x["stop"])), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 256) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_linked (weak parts that were reported).

    A weak part that overlaps a base finding is dropped, as is an opaque token inside an endpoint. An opaque token is reported with
    an identifier (or access id) or an endpoint in scope, an identifier with a secret in scope, an endpoint with both in
    scope. Null and empty texts have no findings. Repeated rows are rows of their own; an empty table gives an
    empty result; other columns are ignored.
    """
    text = F.col("_text")
    rows = keyed(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), "_id", "_text")
    base = F.concat(*(spans(text, kind, *rule) for kind, rule in BASE.items()))
    weak = F.concat(*(F.filter(spans(text, k, p), lambda x: _mixed(text, x)) if k == "opaque" else spans(text, k, p) for k, p in WEAK.items()))
    found = stored(rows.select("_rk", "_id", base.alias("base"), weak.alias("weak")), "parts")

    parts = found.where(F.size("weak") > 0).select("_rk", F.explode(F.concat("base", "weak")).alias("p")).select("_rk", "p.*")
    parts = parts.repartition("_rk")
    order = Window.partitionBy("_rk").orderBy("start", "kind", "stop")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    of = lambda kinds: F.col("kind").isin([KINDS.index(k) for k in kinds])

    def near(kinds: tuple[str, ...]) -> Column:
        back = F.col("start") - F.max(F.when(of(kinds), F.col("stop"))).over(earlier)
        ahead = F.min(F.when(of(kinds), F.col("start"))).over(later) - F.col("stop")
        return F.coalesce(back <= scope, F.lit(False)) | F.coalesce(ahead <= scope, F.lit(False))

    def covered(kinds: tuple[str, ...]) -> Column:
        back = F.max(F.when(of(kinds), F.col("stop"))).over(earlier) > F.col("start")
        ahead = F.min(F.when(of(kinds), F.col("start"))).over(later) < F.col("stop")
        return F.coalesce(back, F.lit(False)) | F.coalesce(ahead, F.lit(False))

    clear = parts.withColumn("_over", (of(tuple(WEAK)) & covered(tuple(BASE))) | (of(("opaque",)) & covered(ENDPOINTS))).where(~F.col("_over")).drop("_over")
    linked = clear.select("*", near(IDENTIFIERS).alias("id"), near(SECRETS).alias("secret"), near(ENDPOINTS).alias("address"))
    told = (of(("opaque",)) & (F.col("id") | F.col("address"))) | (of(("identifier",)) & F.col("secret")) | (of(ENDPOINTS) & F.col("id") & F.col("secret"))
    linked = linked.where(told).groupBy("_rk").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("linked"))

    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    out = found.select("_rk", "_id", "base").join(linked, "_rk", "left").withColumn("linked", F.coalesce("linked", none))
    return out.select(
        F.col("_id").alias(id_col), *map(count, BASE), F.sha2(F.encode(_joined(F.col("base")), "utf-8"), 256).alias("base_sha256"), _joined(F.concat("base", "linked")).alias("spans"), F.size("linked").cast("long").alias("n_linked"),
    )
