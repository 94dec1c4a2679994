"""Byte-level BPE encoding and decoding by merge replay over the corpus.

1. Texts are cut into words by the tokenizer's pattern. A block of texts keeps its distinct words once, as a dictionary in chunks
   by the words' hashes; each text becomes the places of its words in it.
2. The chunks of all blocks are dealt out by hash, so that every distinct word of the corpus is encoded by one task, once (again
   only after its bounded memory of words was cleared): new words are laid out as one sequence of byte tokens with links
   between neighbours; an inverted index lists, for each pair of tokens, its positions; all merges are replayed in rank
   order over all of them, each visiting only the positions of its pairs and re-indexing only the neighbours that it has touched.
3. The ids of a block's words come back to its texts, and each text's places are replaced by ids.

Words don't interact, so these are the ids that any other cut of the vocabulary would give. Texts aren't shuffled, only
their places, compressed. No vocabulary of the corpus has to fit anywhere: a task holds a block's dictionary, or a bounded
part of those words that fall to it.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from zstandard import ZstdCompressor, ZstdDecompressor

from .common import SLICE_BYTES, sliced, stored, tidied

#: Characters of text in a block (a longer text is a block), and words or ids handled at a time in a text.
BLOCK_CHARS, CHUNK = 1 << 25, 1 << 18
#: Uses in a block from which on a word is numbered by frequency.
FREQUENT = 8
#: New words replayed together, encoded words and merged pairs that a task remembers, and the least number of chunks of a dictionary.
REPLAYED, KEPT_WORDS, KEPT_PAIRS, LEAST_CHUNKS = 1 << 16, 1 << 18, 1 << 17, 64


class Vocabulary:
    """The tokens of a rank file (base64 token and rank on each line); a token's rank is its id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}

    def merged(self, a: int, b: int) -> int:
        """The token that the pair a, b merges into, or -1."""
        got = self.joined.get((a, b))
        if got is None:
            if len(self.joined) > KEPT_PAIRS:
                self.joined.clear()
            got = self.joined[a, b] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return got

    def one_by_one(self, word: bytes) -> list[int]:
        """The definition: join the leftmost pair of the lowest rank until none is left."""
        ids = [self.single[b] for b in word]
        while len(ids) > 1:
            rank, i = min((r if r >= 0 else 1 << 60, i) for i, r in enumerate(map(self.merged, ids, ids[1:])))
            if rank == 1 << 60:
                break
            ids[i : i + 2] = [rank]
        return ids

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, all merges replayed over all words together."""
        if not words:
            return []
        token: list[int] = []
        starts: list[int] = []
        for word in words:
            starts.append(len(token))
            token += [self.single[b] for b in word]
            token.append(-1)  # ends a word
        after = list(range(1, len(token) + 1))
        before = list(range(-1, len(token) - 1))
        index: dict[tuple[int, int], list[int]] = {}
        pairs: dict[int, list[tuple[int, int]]] = {}  # those of each rank: several may join into the same bytes
        waiting: list[int] = []
        merged = self.merged

        def enter(at: int, a: int, b: int) -> int:
            if a < 0 or b < 0 or (rank := merged(a, b)) < 0:
                return -1
            if (places := index.get((a, b))) is not None:
                places.append(at)
                return rank
            index[a, b] = [at]
            if rank in pairs:
                pairs[rank].append((a, b))
            else:
                pairs[rank] = [(a, b)]
                heapq.heappush(waiting, rank)
            return rank

        for at in range(len(token) - 1):
            enter(at, token[at], token[at + 1])
        odd: set[int] = set()  # positions where a merge opened one of a lower rank: their words are encoded by the definition
        while waiting:
            rank = heapq.heappop(waiting)
            # The leftmost comes first, whichever pair it is of.
            for at in sorted(at for pair in pairs.pop(rank) for at in index.pop(pair)):
                a = token[at]
                if a < 0:
                    continue
                right = after[at]
                b = token[right]
                if b < 0 or merged(a, b) != rank:
                    continue
                token[at], token[right] = rank, -2  # -2: joined into its left neighbour
                beyond = after[at] = after[right]
                if beyond < len(token):
                    before[beyond] = at
                left = before[at]
                if left >= 0 and 0 <= enter(left, token[left], rank) < rank:
                    odd.add(at)
                if beyond < len(token) and 0 <= enter(at, rank, token[beyond]) < rank:
                    odd.add(at)
        again = set((np.searchsorted(starts, sorted(odd), "right") - 1).tolist()) if odd else ()
        ends = [*starts[1:], len(token)]
        return [self.one_by_one(word) if k in again else [t for t in token[start:end] if t >= 0] for k, (word, start, end) in enumerate(zip(words, starts, ends, strict=True))]

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """The ids of each distinct word, as little-endian unsigned 32-bit integers. A word that is a token is that token."""
        out, rest = {}, []
        for w in {*words}:
            whole = self.ranks.get(w)
            if whole is None:
                rest.append(w)
            else:
                out[w] = whole.to_bytes(4, "little")
        for w, ids in zip(rest, self.replay(rest), strict=True):
            out[w] = np.array(ids, "<u4").tobytes()
        return out

    def decode(self, ids: bytes) -> bytes:
        found = np.frombuffer(ids, "<u4")
        return b"".join(b"".join(map(self.tokens.__getitem__, found[i : i + CHUNK].tolist())) for i in range(0, len(found), CHUNK))


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Block:
    """Texts as places in the list of their distinct words."""

    def __init__(self, pattern: regex.Pattern):
        self.find, self.chars = pattern, 0
        self.words: defaultdict[str, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.texts: list[np.ndarray] = []

    def add(self, text: str) -> None:
        self.chars += len(text)
        if len(text) <= BLOCK_CHARS:
            parts = [self.find.findall(text)]
        else:
            found = self.find.finditer(text)
            parts = iter(lambda: [m[0] for m in islice(found, CHUNK)], [])
        places = [np.array([self.words[w] for w in part], np.uint32) for part in parts]
        self.texts.append(np.concatenate(places) if places else np.empty(0, np.uint32))


def planes(values: np.ndarray) -> bytes:
    """Numbers of four bytes as all their lowest bytes, then all the next, and so on: small ones compress well that way."""
    return np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def packed(sizes: np.ndarray, rest: bytes) -> bytes:
    """Numbers and what follows them, compressed: of words, their lengths and the words in a row."""
    return ZstdCompressor(3).compress(len(sizes).to_bytes(4, "little") + planes(sizes) + rest)


def unpacked(data: bytes) -> tuple[np.ndarray, bytes]:
    whole = ZstdDecompressor().decompress(data)
    n = int.from_bytes(whole[:4], "little")
    return unplaned(whole[4 : 4 * n + 4]).astype(np.int64), whole[4 * n + 4 :]


def numbered(first: np.ndarray, n: int) -> np.ndarray:
    """The places 0 to n - 1 in the order of their numbers: those of `first`, then the others as they come."""
    rest = np.ones(n, bool)
    rest[first] = False
    return np.concatenate([first, np.flatnonzero(rest)])


def cut(docs: DataFrame, pattern: str, chunks: int) -> DataFrame:
    """block, role, ix, data, _row of docs (_row, _text): the chunks of each block's dictionary, words in order (role 0, chunk ix),
    the places of those that are numbered first (role 1, ix 0), the numbers of all words of its texts in a row (role 1, ix 1), and its
    texts' rows (role 2).
    """
    schema = T.StructType().add("block", "long").add("role", "integer").add("ix", "integer").add("data", "binary").add("_row", docs.schema["_row"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern)
        number = TaskContext.get().partitionId() << 32
        block, rows = Block(find), []

        def made(role: int, ix: list[int], data: list[bytes | None], row: pa.Array) -> pa.RecordBatch:
            k = len(data)
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(number, pa.int64()), k), pa.repeat(pa.scalar(role, pa.int32()), k), pa.array(ix, pa.int32()), pa.array(data, pa.binary()), row], names=schema.names)

        def ended() -> Iterator[pa.RecordBatch]:
            lengths = np.fromiter(map(len, block.texts), np.int64, len(block.texts))
            numbers = np.concatenate(block.texts)
            counts = np.bincount(numbers, minlength=len(block.words))
            words = [w.encode() for w in block.words]
            chunk = [crc32(w) % chunks for w in words]
            order = np.array(sorted(range(len(words)), key=lambda k: (chunk[k], words[k])), np.int64)
            data: dict[int, list[bytes]] = {}
            for k in order.tolist():
                data.setdefault(chunk[k], []).append(words[k])
            ix = [*data]
            data = [packed(np.fromiter(map(len, part), np.int64, len(part)), b"".join(part)) for part in data.values()]
            frequent = np.argsort(-counts[order], kind="stable")[: int((counts >= FREQUENT).sum())]
            place = np.empty(len(words), np.uint32)
            place[order[numbered(frequent, len(words))]] = np.arange(len(words))
            missing = lambda k: pa.nulls(k, rows[0].type)
            yield made(0, ix, data, missing(len(ix)))
            yield made(1, [0, 1], [packed(frequent, b""), packed(lengths, planes(place[numbers]))], missing(2))
            yield made(2, [*range(len(lengths))], [None] * len(lengths), pa.concat_arrays(rows))

        for batch in sliced(batches, "_text"):
            start = 0
            for i, text in enumerate(batch.column("_text").to_pylist()):
                if block.texts and block.chars + len(text or "") > BLOCK_CHARS:
                    if i > start:
                        rows.append(batch.column("_row").slice(start, i - start))
                    yield from ended()
                    number, block, rows, start = number + 1, Block(find), [], i
                block.add(text or "")
            rows.append(batch.column("_row").slice(start))
        if block.texts:
            yield from ended()

    return docs.select("_row", "_text").mapInArrow(tidied(run), schema)


def encoded_chunks(words: DataFrame, path: str) -> DataFrame:
    """block, ix, data of words (block, ix, data): the packed ids of each word in place of the words."""
    schema = T.StructType().add("block", "long").add("ix", "integer").add("data", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, known, last = vocabulary(path), {}, None
        for batch in sliced(batches, "data"):
            given = []
            for ix, data in zip(batch.column("ix").to_pylist(), batch.column("data").to_pylist(), strict=True):
                sizes, whole = unpacked(data)
                ends = np.cumsum(sizes).tolist()
                given.append((ix, [whole[a:b] for a, b in zip([0, *ends], ends)]))
            start, out = 0, []
            while start < len(given):
                # As many chunks as have so many new words; those of another chunk's number have other words.
                new, stop = set(), start
                while stop < len(given) and (stop == start or len(new) < REPLAYED):
                    if given[stop][0] != last or len(known) > KEPT_WORDS:
                        if stop > start:
                            break
                        known, last = {}, given[stop][0]
                    new.update(w for w in given[stop][1] if w not in known)
                    stop += 1
                known |= vocab.encode_words(new)
                for _, chunk in given[start:stop]:
                    ids = [known[w] for w in chunk]
                    out.append(packed(np.fromiter(map(len, ids), np.int64, len(ids)) // 4, planes(np.frombuffer(b"".join(ids), "<u4"))))
                start = stop
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("ix"), pa.array(out, pa.binary())], names=schema.names)

    return words.repartition("ix").sortWithinPartitions("ix").select("block", "ix", "data").mapInArrow(tidied(run), schema)


def bpe_encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """docs without its text column, with ids binary (little-endian unsigned 32-bit) and n_tokens long.

    decoded names a column for the bytes that the ids stand for, as bpe_decode gives them: the worker that has the ids decodes
    them, so that a task needs one worker and not two. Columns named ids or n_tokens, or like it, are replaced.
    A null or empty text has no tokens. Each match of the pattern is encoded by itself, without special tokens. Texts of any length are read whole; one longer than a block is a block by itself,
    cut into words some at a time. Repeated rows stay; an empty table stays empty.
    """
    rest = [c for c in docs.columns if c not in (text_col, "ids", "n_tokens", decoded)]
    given = docs.select(F.struct(*rest, F.lit(0).alias("_")).alias("_row"), F.col(text_col).alias("_text"))
    chunks = max(LEAST_CHUNKS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = stored(cut(given, pattern, chunks), "blocks")
    words = encoded_chunks(blocks.where("role = 0").select("block", "ix", "data"), path)
    texts = blocks.where("role > 0").select("block", "role", "ix", "data", "_row")
    row_type = given.schema["_row"].dataType
    schema = T.StructType().add("_row", row_type).add("ids", "binary").add("n_tokens", "long")
    if decoded is not None:
        schema = schema.add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = None if decoded is None else vocabulary(path)
        block = entries = table = numbers = None
        for batch in sliced(batches, "data"):
            rows, at, out, size = batch.column("_row"), [], [], 0

            def done() -> pa.RecordBatch:
                made = [rows.take(pa.array(at, pa.int64())), pa.array(out, pa.binary()), pa.array([len(x) // 4 for x in out], pa.int64())]
                if vocab:
                    made.append(pa.array(map(vocab.decode, out), pa.binary()))
                return pa.RecordBatch.from_arrays(made, names=schema.names)

            for i, (now, role, ix, data) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("block", "role", "ix", "data")), strict=True)):
                if now != block:
                    block, entries, table = now, [], None
                if role == 0:
                    entries.append(unpacked(data))
                elif role == 1 and ix == 0:
                    table, entries = dictionary(entries, unpacked(data)[0]), None
                elif role == 1:
                    lengths, rest = unpacked(data)
                    numbers, starts = unplaned(rest), np.concatenate([[0], np.cumsum(lengths)])
                else:
                    out.append(with_ids(numbers[starts[ix] : starts[ix + 1]], *table))
                    at.append(i)
                    size += len(out[-1])
                    if size > SLICE_BYTES:
                        yield done()
                        at, out, size = [], [], 0
            yield done()

    missing = F.lit(None).cast(row_type).alias("_row")
    both = texts.unionByName(words.select("block", F.lit(0).alias("role"), "ix", "data", missing))
    done = both.repartition("block").sortWithinPartitions("block", "role", "ix").mapInArrow(tidied(run), schema)
    also = [] if decoded is None else [F.col("decoded").alias(decoded)]
    return done.select(*[F.col("_row").getField(c).alias(c) for c in rest], "ids", "n_tokens", *also)


def dictionary(chunks: list[tuple[np.ndarray, bytes]], frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, starts, sizes: the ids of all words in a row, and where those of the word of each number are."""
    sizes = np.concatenate([c[0] for c in chunks] or [np.empty(0, np.int64)])
    ids = np.concatenate([unplaned(c[1]) for c in chunks] or [np.empty(0, "<u4")])
    by_number = numbered(frequent, len(sizes))
    return ids, (np.cumsum(sizes) - sizes)[by_number], sizes[by_number]


def with_ids(places: np.ndarray, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> bytes:
    """The ids of the words of the given numbers."""
    out = []
    for i in range(0, len(places), CHUNK):
        at = places[i : i + CHUNK]
        n = sizes[at]
        out.append(ids[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes())
    return b"".join(out)


def bpe_decode(encoded: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """encoded with the bytes that its ids stand for in column `to`, which is replaced if it is there.

    Null or empty ids give no bytes; ids of any length are decoded whole. Repeated rows stay; an empty table stays empty.
    """
    rest = [c for c in encoded.columns if c != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in sliced(batches, rest.index(ids_col)):
            ids = batch.column(rest.index(ids_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([vocab.decode(x or b"") for x in ids], pa.binary())], names=[*rest, to])

    return encoded.select(*rest).mapInArrow(tidied(run), encoded.select(*rest, F.lit(b"").alias(to)).schema)
