"""Chunk tables of contents and the ids of files made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon
from .trees import fold, positions

#: Sizes of chunks, largest first; a chunk takes the largest that fits in what remains, the last all of it.
CHUNK_SIZES = (4 << 20, 1 << 20, 256 << 10, 64 << 10, 16 << 10)


def chunk_sizes(size: Column) -> Column:
    """array<long>: the sizes of the chunks of a content. Each size divides the one before, so every count is one division."""
    counts, rest = [], size.cast("long")
    for s in CHUNK_SIZES:
        counts.append(F.array_repeat(F.lit(s).cast("long"), F.floor(rest / s).cast("int")))
        rest = rest % s
    return F.concat(*counts, F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))


def chunk_manifest(files: DataFrame, size: Column, keep: list[str]) -> DataFrame:
    """keep, ix, offset, size: one row per chunk; an empty content has none."""
    sizes = files.select(*keep, chunk_sizes(size).alias("_sizes"))
    # A running total inside the row: the offset of a chunk is what stands before it.
    before = lambda a, i: F.aggregate(F.slice(a, 1, i), F.lit(0).cast("long"), lambda s, x: s + x)
    placed = F.transform("_sizes", lambda s, i: F.struct(before(F.col("_sizes"), i).alias("offset"), s.alias("size")))
    return sizes.select(*keep, F.posexplode(placed).alias("ix", "_c")).select(*keep, "ix", "_c.offset", "_c.size")


def chunk_contents(files: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """keep, ix, offset, size, bytes, chunk_id: a manifest with each chunk's bytes and SHA-256."""
    data = F.col(content)
    manifest = files.select(*keep, data.alias("_data"), chunk_sizes(F.length(data)).alias("_sizes"))
    before = lambda a, i: F.aggregate(F.slice(a, 1, i), F.lit(0).cast("long"), lambda s, x: s + x)
    cut = F.transform("_sizes", lambda s, i: F.struct(before(F.col("_sizes"), i).alias("offset"), s.alias("size"), F.substring(F.col("_data"), (before(F.col("_sizes"), i) + 1).cast("int"), s.cast("int")).alias("bytes")))
    rows = manifest.select(*keep, F.posexplode(cut).alias("ix", "_c")).select(*keep, "ix", "_c.*")
    return rows.withColumn("chunk_id", canon.object_id(F.col("bytes")))


def file_ids(chunks: DataFrame, files: DataFrame, key: str, max_items: int = canon.MAX_FILE) -> tuple[DataFrame, DataFrame]:
    """(key, size, object_id) of every file, and the File objects (object_id, json) that make it.

    chunks: key, ix, size, chunk_id. A file of files without chunks is the empty File.
    """
    leaves = chunks.select(F.col(key).alias("list"), "ix", canon.chunk_part(F.col("size"), F.col("chunk_id")).alias("item"), F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("last"), "size")
    roots, nodes = fold(leaves, files.select(F.col(key).alias("list")), canon.file_object, lambda r: canon.nested_file_part(r["size"], r["object_id"]), max_items)
    return roots.select(F.col("list").alias(key), "size", "object_id"), nodes


def file_within(parts: Column, most: int, max_items: int = canon.MAX_FILE) -> Column:
    """struct(size, object_id, objects) of the file of an array of parts (size, chunk_id), made within its row.

    objects: array of (object_id, json), the File objects that make it. More parts than the levels for `most` hold are an error.
    """

    def nodes(items: Column) -> Column:
        def node(group: Column) -> Column:
            size = F.aggregate(group, F.lit(0).cast("long"), lambda s, x: s + x["size"])
            return canon.let(canon.file_object(F.transform(group, lambda x: x["item"])), lambda j: F.struct(size.alias("size"), canon.text_id(j).alias("object_id"), j.alias("json")))

        last = F.greatest(F.lit(0), F.floor((F.size(items) - 1) / max_items).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda k: node(F.slice(items, k * max_items + 1, max_items)))

    def up(level: Column, below: list[Column], reach: int) -> Column:
        objects = [*below, F.transform(level, lambda x: F.struct(x["object_id"].alias("object_id"), x["json"].alias("json")))]
        root = F.struct(level[0]["size"].alias("size"), level[0]["object_id"].alias("object_id"), F.concat(*objects).alias("objects"))
        if reach >= most:
            more = F.raise_error(F.lit(f"a file has more than {reach} parts"))
        else:
            items = F.transform(level, lambda x: F.struct(x["size"].alias("size"), canon.nested_file_part(x["size"], x["object_id"]).alias("item")))
            more = canon.let(nodes(items), lambda x: up(x, objects, reach * max_items))
        return F.when(F.size(level) == 1, root).otherwise(more)

    items = F.transform(parts, lambda p: F.struct(p["size"].alias("size"), canon.chunk_part(p["size"], p["chunk_id"]).alias("item")))
    return canon.let(items, lambda x: canon.let(nodes(x), lambda y: up(y, [], max_items)))


def whole_file_ids(files: DataFrame, content: str, keep: list[str], max_items: int = canon.MAX_FILE) -> DataFrame:
    """keep, size, n_chunks, object_id: every file's id from its bytes.

    The File object of up to max_items chunks is made within the row that holds them, without a shuffle; only longer
    files go through the fold, by keep, which must tell rows apart.
    """
    data, sizes = F.col(content), F.col("_sizes")
    before = lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0).cast("long"), lambda s, x: s + x)
    part = F.transform(sizes, lambda s, i: canon.chunk_part(s, canon.object_id(F.substring(data, (before(i) + 1).cast("int"), s.cast("int")))))
    rows = files.withColumn("_sizes", chunk_sizes(F.length(data)))
    about = [*keep, F.length(data).cast("long").alias("size"), F.size(sizes).cast("long").alias("n_chunks")]
    short = rows.where(F.size(sizes) <= max_items).select(*about, canon.text_id(canon.file_object(part)).alias("object_id"))
    long = rows.where(F.size(sizes) > max_items)
    if long.isEmpty():
        return short
    keyed = long.withColumn("_key", F.struct(*keep))
    ids, _ = file_ids(chunk_contents(keyed, content, ["_key"]).drop("bytes"), keyed, "_key", max_items)
    return short.unionByName(keyed.select("_key", *about).join(ids.select("_key", "object_id"), "_key").drop("_key"))


def appended_buffers(buffers: DataFrame, key: str) -> DataFrame:
    """key, ix, offset, size of the chunks that a stream of buffers (key, seq, bytes) makes: those of its bytes in a row."""
    totals = buffers.groupBy(key).agg(F.sum(F.length("bytes")).alias("_total"))
    return chunk_manifest(totals, F.col("_total"), [key])


def chunk_at(position: Column, total: Column) -> Column:
    """The number of the chunk that holds a byte of a content of total bytes: one division for each size of chunk."""
    at, rest, number = position.cast("long"), total.cast("long"), F.lit(0).cast("long")
    found = F.lit(None).cast("long")
    for s in CHUNK_SIZES:
        n = F.floor(rest / s)
        found = F.coalesce(found, F.when(at < n * s, number + F.floor(at / s)))
        at, rest, number = at - n * s, rest % s, number + n
    return F.coalesce(found, number)


def streamed_chunks(buffers: DataFrame, key: str) -> DataFrame:
    """key, ix, offset, size, chunk_id of the chunks that streams of buffers (key, seq, bytes) make.

    Each buffer is cut where chunks end, whose places follow from the stream's length alone; the pieces of a chunk meet by its number.
    Streams of any length are dealt over many tasks; only pieces of one chunk, at most the largest size, come together.
    """
    placed = positions(buffers.select(key, "seq", "bytes", F.length("bytes").cast("long").alias("_n")), [key], ["seq"], "_at", weight="_n")
    totals = buffers.groupBy(key).agg(F.sum(F.length("bytes")).cast("long").alias("_total"))
    rows = placed.join(totals, key).where("_n > 0")
    first, last = chunk_at(F.col("_at"), F.col("_total")), chunk_at(F.col("_at") + F.col("_n") - 1, F.col("_total"))
    pieces = rows.withColumn("ix", F.explode(F.sequence(first, last)))
    manifest = chunk_manifest(totals, F.col("_total"), [key]).withColumn("ix", F.col("ix").cast("long"))
    met = pieces.join(manifest, [key, "ix"])
    start = F.greatest(F.lit(0).cast("long"), F.col("offset") - F.col("_at"))
    stop = F.least(F.col("_n"), F.col("offset") + F.col("size") - F.col("_at"))
    met = met.select(key, "ix", "offset", "size", "_at", F.substring(F.col("bytes"), (start + 1).cast("int"), (stop - start).cast("int")).alias("piece"))
    joined = met.groupBy(key, "ix", "offset", "size").agg(F.array_sort(F.collect_list(F.struct("_at", "piece"))).alias("p"))
    content = F.aggregate("p", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["piece"]))
    return joined.select(key, F.col("ix").cast("int").alias("ix"), "offset", "size", canon.object_id(content).alias("chunk_id"))
