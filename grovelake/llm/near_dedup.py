"""MinHash near-dedup with Odd sketches.

Each document's set of word shingles gives min-hash samples. Runs of samples are bands; documents that share a band are
candidates. All samples are also folded into a parity bitmap, an Odd sketch: a sample flips the bit that it hashes to. Equal
samples cancel in the XOR of two sketches, so its population count tells how many samples differ, most precisely where few
do; candidates below the estimate are dropped before any text is fetched, and the rest are confirmed on full sets.

Groups may be large, so pairs within a band are never listed:
1. Documents of the same words in the same order (by a 128-bit digest of the whole sequence) form a class; one stands for it
   from here on. Equal sets of other orders share all bands and are confirmed like any other pair.
2. Star rounds: in each band whose documents aren't yet in one component, all are compared with a centre: first the document
   that meets most others in its bands, as the original of many copies does, then a few others; what links joins components.
3. In bands that still hold several components, the documents outside the largest are compared with the others. Both sides of
   a large band are dealt out in parts, so that it is no single task's.
The comparison of sketches is part of the joins' conditions. Odd sketches of the whole sets are compared as well: they can't
differ in more bits than the sets do in shingles, so a pair whose sketches differ in more than the similarity allows is
ruled out for certain, and little but links comes out.
Components are merged by alternating large-star and small-star steps over stored tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_or_numbered, sliced, stored, tidied

BANDS, ROWS, SKETCH_WORDS = 24, 4, 4
#: Centres of a band in the star rounds after the first.
CENTRES = 8
#: 64-bit words of the Odd sketch of a whole set, which tells pairs near the threshold apart in the last round.
SET_WORDS = 16
#: Differences from here on fill that sketch and rule nothing out.
MOST_DIFFERENCE = 3 * 64 * SET_WORDS
#: Documents of a band that the last round compares with others in one task.
PART = 2048
_RNG = np.random.default_rng(20240229)
_TIMES = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_SALT = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_KEPT_WORDS = 1 << 16


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _KEPT_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], width: int) -> set:
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {*zip(*(words[i:] for i in range(width)))}


def shingle_hashes(words: list[bytes], width: int, known: dict) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles."""
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if not len(words):
        return h
    n = max(1, len(words) - width + 1)
    x = np.full(n, min(len(words), width), np.uint64)
    for i in range(min(width, len(words))):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(x)


def samples(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[i : i + 4096, None] * _TIMES + _PLUS).min(0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    x = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + column)
    return x.view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    bits = np.bincount((_mix(least ^ _SALT) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def set_sketch(hashes: np.ndarray) -> np.ndarray:
    """The Odd sketch of all shingles: its XOR counts by how many two sets differ."""
    bits = np.bincount((hashes >> np.uint64(54)).astype(np.int64), minlength=64 * SET_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def sketch_bits(estimate: float) -> int:
    """The most bits in which two Odd sketches may differ for their estimated similarity to reach the one given."""
    n, k = 64 * SKETCH_WORDS, BANDS * ROWS
    return int(n / 2 * (1 - np.exp(4 * k / n * (estimate - 1))))


def set_bits() -> list[int]:
    """For each difference of two sets up to MOST_DIFFERENCE, the most bits in which their sketches may differ.

    Bits can't exceed the difference; for sets that fill the sketch, nor 5 standard deviations above the mean.
    """
    bits = 64 * SET_WORDS
    d = np.arange(MOST_DIFFERENCE + 1)
    q = np.exp(d * (-2 / bits))
    spread = np.sqrt(np.maximum(0, (1 - q * q) * (bits / 4) - d * q * q))
    return np.minimum(d, (1 - q) * (bits / 2) + spread * 5 + 2).astype(int).tolist()[:-1] + [bits]


def words(column: str, size: int) -> list[Column]:
    return [F.col(column)[i].alias(f"{column}{i}") for i in range(size)]


def signatures(rows: DataFrame, width: int) -> DataFrame:
    """_rk, _id, n, d1, d2 (digest of the sequence of words), bands, sketch, whole of each row of _rk, _id, _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        with np.errstate(over="ignore"):
            for batch in sliced(batches, 2):
                sizes, digests, bands, sketches, wholes = [], [], [], [], []
                for text in batch.column(2).to_pylist():
                    words = words_of(text)
                    h = shingle_hashes(words, width, known)
                    sizes.append(len(h))
                    wholes.append(set_sketch(h))
                    digests.append(np.frombuffer(hashlib.blake2b(b" ".join(words), digest_size=16).digest(), np.int64))
                    if len(h):
                        least = samples(h)
                        bands.append(band_keys(least))
                        sketches.append(odd_sketch(least))
                    else:
                        bands.append(np.empty(0, np.int64))
                        sketches.append(np.zeros(SKETCH_WORDS, np.int64))
                d = np.array(digests, np.int64).reshape(-1, 2)
                arrays = [pa.array(x, pa.list_(pa.int64())) for x in (bands, sketches, wholes)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), *arrays], names=["_rk", "_id", "n", "d1", "d2", "bands", "sketch", "whole"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.select("_rk", "_id", "_text").mapInArrow(tidied(run), f"_rk long, _id {kind}, n long, d1 long, d2 long, bands array<long>, sketch array<long>, whole array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of pairs (c, v) whose full sets of shingles reach the similarity. texts: _rk, _text.

    The pairs of a c are dealt out in runs of about 256, so that a centre of many is no single task's; a task reads
    the centre's text of a run first, then one text after another.
    """
    runs = stored(pairs.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / 256).alias("_runs")).where("_runs > 1"), "runs")
    dealt = pairs.join(runs, "c", "left").withColumn("run", F.pmod(F.xxhash64("v"), F.coalesce("_runs", F.lit(1)))).drop("_runs")
    wanted = dealt.select("c", "run", F.lit(1).alias("role"), F.col("v").alias("_rk")).unionByName(dealt.select("c", "run").distinct().select("c", "run", F.lit(0).alias("role"), F.col("c").alias("_rk")))
    read = wanted.join(texts, "_rk").repartition("c", "run").sortWithinPartitions("c", "run", "role")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre: set = set()
        for batch in sliced(batches, "_text"):
            found: tuple[list, list] = ([], [])
            for rk, c, role, text in zip(*(batch.column(k).to_pylist() for k in ("_rk", "c", "role", "_text")), strict=True):
                own = shingle_set(words_of(text), width)
                if not role:
                    centre = own
                    continue
                both = len(centre & own)
                if 100 * both >= percent * (len(centre) + len(own) - both) and own:
                    found[0].append(c)
                    found[1].append(rk)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["c", "v"])

    return read.select("_rk", "c", "role", "_text").mapInArrow(tidied(check), "c long, v long")


def components(edges: DataFrame) -> DataFrame:
    """v, comp: the smallest vertex of each connected component of edges (a, b); every vertex of an edge has a row."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # Large-star: the larger neighbours of each vertex are linked to the least of its neighbourhood.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = stored(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
        # Small-star: each vertex and its smaller neighbours are linked to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        now = stored(large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        # Done when every vertex is a centre or has one edge, to its centre.
        ends = now.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select("b", F.lit(0), F.lit(1)).toDF("v", "up", "down"))
        if ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            break
    stars = now.select(F.col("a").alias("v"), F.col("b").alias("comp"))
    return stars.unionByName(stars.select(F.col("comp").alias("v"), "comp").distinct())


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, star_rounds: int = 2, estimate: float = 0.55) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept, class_id (smallest id with the same words in the same order).

    Two documents are linked when 100 * common >= percent * all of their distinct shingles of `width` words; a
    text with fewer words is one shingle. Null and empty texts and texts of white space have no shingle and are linked with nothing.
    component_id is the smallest id that links reach; kept marks the row that has it. Rows that repeat an id are rows
    of their own (of equal rows one is kept); null ids come last. An empty table gives an empty result; other columns are ignored.
    """
    rows, plain = keyed_or_numbered(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text")
    out = _grouped(rows, plain, width, percent, star_rounds, estimate)
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept", "class_id")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, of which near_dedup says kept: one of each component."""
    rows, plain = keyed_or_numbered(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct("*").alias("_row")), "_id", "_text")
    kept = stored(_grouped(rows.select("_rk", "_id", "_text"), plain, width, percent, 2, 0.55).where("kept").select("_rk"), "kept")
    # The ids grow with the corpus: this join is a shuffle at every size.
    return rows.join(kept.hint("merge"), "_rk", "left_semi").select("_row.*")


def _grouped(rows: DataFrame, plain: bool, width: int, percent: int, star_rounds: int, estimate: float) -> DataFrame:
    """_rk, _id, n, component_id, kept, class_id of each of rows (_rk, _id, _text); plain: row keys are ids."""
    signed = stored(signatures(rows, width), "signatures")
    some = signed.where("n > 0")
    classes = stored(some.groupBy("d1", "d2").agg(F.min("_rk").alias("rep")), "classes")

    banded = some.join(classes.select(F.col("rep").alias("_rk")), "_rk").select(F.col("_rk").alias("rep"), "n", *words("sketch", SKETCH_WORDS), F.explode("bands").alias("band"))
    shared = stored(banded.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "shared")
    banded = stored(banded.join(shared, "band"), "bands")
    # How many meet a document in its bands: the original of many copies meets more than any of them does.
    whole = signed.select(F.col("_rk").alias("rep"), *words("whole", SET_WORDS), "bands")
    labels = stored(banded.groupBy(F.col("rep").alias("v")).agg(F.sum("m").alias("met")).withColumn("comp", F.col("v")), "labels")
    # The ids grow with the corpus: this join is a shuffle at every size.
    texts = stored(rows.select("_rk", "_text").join(labels.select(F.col("v").alias("_rk")).hint("merge"), "_rk"), "texts")
    most = sketch_bits(estimate)
    bounds = F.split(F.lit(" ".join(map(str, set_bits()))), " ").cast("array<int>")

    def differ(a: str, b: str, column: str, size: int) -> Column:
        return sum((F.bit_count(F.col(f"{a}.{column}{i}").bitwiseXOR(F.col(f"{b}.{column}{i}"))) for i in range(size)), F.lit(0))

    def alike(a: str, b: str) -> Column:
        """Whether sizes and both kinds of sketches allow the similarity."""
        x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
        size = (x * 100 >= y * percent) & (y * 100 >= x * percent)
        allowed = F.get(bounds, F.least(F.floor((x + y) * (100 - percent) / (100 + percent)), F.lit(MOST_DIFFERENCE)).cast("int"))
        return size & (differ(a, b, "sketch", SKETCH_WORDS) <= most) & (differ(a, b, "whole", SET_WORDS) <= allowed)

    for turn in range(star_rounds + 1):
        now = stored(banded.join(labels, F.col("rep") == F.col("v")).drop("v"), "labelled")
        open_ = stored(now.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("band"), "several")
        pool = stored(now.join(open_, "band").join(whole, "rep"), "open")
        if turn < star_rounds:
            order = F.struct(F.lit(0) - F.col("met"), "rep") if turn == 0 else F.struct(F.xxhash64("rep", "band", F.lit(turn)), "rep")
            part = F.lit(0) if turn == 0 else F.pmod(F.xxhash64("rep"), F.lit(CENTRES))
            chosen = pool.groupBy("band", part.alias("part")).agg(F.min_by(F.struct(*[c for c in pool.columns if c not in ("band", "met", "m", "bands")]), order).alias("at"))
            centres = stored(chosen.select("band", "at.*"), "centres").alias("x")
            found = centres.join(pool.alias("y"), F.col("x.band") == F.col("y.band")).where((F.col("x.comp") != F.col("y.comp")) & alike("x", "y"))
        else:
            largest = stored(pool.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("band").agg(F.max_by("comp", F.struct("k", "comp")).alias("main")), "largest")
            parts = F.ceil(F.col("m") / PART).cast("int")
            outside = stored(pool.join(largest, "band").where("comp <> main").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))), "outside").alias("x")
            dealt = pool.withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int")).alias("y")
            # Of the bands that a pair shares, the first alone gives it; there one of the two is outside as well.
            first = F.element_at(F.array_intersect("x.bands", "y.bands"), 1) == F.col("x.band")
            found = outside.join(dealt.hint("merge"), (F.col("x.band") == F.col("y.band")) & (F.col("x.part") == F.col("y.part"))).where((F.col("x.comp") != F.col("y.comp")) & alike("x", "y") & first)
        pairs = found.groupBy(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).agg(F.min(F.struct(F.col("x.rep").alias("c"), F.col("y.rep").alias("v"))).alias("p"))
        pairs = pairs.select("p.*")
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            continue
        links = stored(confirmed(pairs, texts, width, percent).select(F.col("c").alias("a"), F.col("v").alias("b")), "links")
        if links.isEmpty():
            continue
        joined = components(links.unionByName(labels.where("v <> comp").select(F.col("v").alias("a"), F.col("comp").alias("b"))))
        labels = stored(labels.drop("comp").join(joined, "v", "left").select("v", "met", F.coalesce("comp", "v").alias("comp")), "labels")
    heads = stored(classes.join(labels, F.col("rep") == F.col("v"), "left").select("d1", "d2", "rep", F.coalesce("comp", "rep").alias("comp")), "heads")
    ids = signed.select("_rk", "_id", "n", "d1", "d2")
    out = ids.where("n > 0").join(heads, ["d1", "d2"]).select("_rk", "_id", "n", "comp", "rep").unionByName(ids.where("n = 0").select("_rk", "_id", "n", F.col("_rk").alias("comp"), F.col("_rk").alias("rep")))
    if plain:
        out = out.select("*", F.col("comp").alias("component_id"), F.col("rep").alias("class_id"))
    else:
        names = stored(ids.select(F.col("_rk").alias("k"), F.col("_id").alias("name")), "ids")
        out = out.join(names.select(F.col("k").alias("comp"), F.col("name").alias("component_id")), "comp").join(names.select(F.col("k").alias("rep"), F.col("name").alias("class_id")), "rep")
    return out.select("_rk", "_id", "n", "component_id", (F.col("_rk") == F.col("comp")).alias("kept"), "class_id")
