import hashlib
import random

import pytest
from pyspark.sql import functions as F

from grovelake.functions import canon
from grovelake.operators import chunks, trees, walk
from grovelake.plans import queries

SIZES = (4 << 20, 1 << 20, 256 << 10, 64 << 10, 16 << 10)


def plain_chunks(n):
    out = []
    while n:
        out.append(next((s for s in SIZES if s <= n), n))
        n -= out[-1]
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fold(items, most, wrap, nested):
    """Nodes are closed when the next item arrives, level by level."""
    levels = [[]]

    def add(k, item):
        if len(levels) == k:
            levels.append([])
        if len(levels[k]) == most:
            full, levels[k] = levels[k], []
            add(k + 1, nested(full, sha(wrap(full))))
        levels[k].append(item)

    for x in items:
        add(0, x)
    k = 0
    while k < len(levels) - 1 or k == 0 and len(levels) > 1:
        part, levels[k] = levels[k], []
        add(k + 1, nested(part, sha(wrap(part))))
        k += 1
        if k == len(levels) - 1:
            break
    return sha(wrap(levels[-1]))


def test_chunk_sizes(spark):
    sizes = [0, 1, 1000, 16383, 16384, 2_000_000, 4_194_304, 5_500_000, 10_000_000, 123_456_789]
    got = spark.createDataFrame([(s,) for s in sizes], "n long").select("n", chunks.chunk_sizes(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in got} == {s: plain_chunks(s) for s in sizes}


def test_chunk_contents_and_manifest(spark):
    data = bytes(range(256)) * 200
    df = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"")), ("c", bytearray(b"abc"))], "path string, content binary")
    got = chunks.chunk_contents(df, "content", ["path"]).orderBy("path", "ix").collect()
    assert b"".join(r.bytes for r in got if r.path == "a") == data and [r.size for r in got if r.path == "a"] == plain_chunks(len(data))
    assert all(hashlib.sha256(r.bytes).hexdigest() == r.chunk_id for r in got)
    assert [r.chunk_id for r in got if r.path == "c"] == ["ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"]
    assert not [r for r in got if r.path == "b"]
    manifest = chunks.chunk_manifest(df, F.length("content"), ["path"]).collect()
    assert sorted((r.path, r.ix, r.offset, r.size) for r in manifest) == sorted((r.path, r.ix, r.offset, r.size) for r in got)
    ids, nodes = chunks.file_ids(got_df := chunks.chunk_contents(df, "content", ["path"]), df, "path")
    assert {r.path: r.object_id for r in ids.collect()}["b"] == "e4b4749ca34e7f5d6c60d66b135019d263f56322cedf8dde7ad1789c139bd426"
    leaves = walk.list_file(nodes, ids.select(F.col("path").alias("list"), "object_id"))
    assert sorted((r["list"], r.target_id) for r in leaves.collect()) == sorted((r.path, r.chunk_id) for r in got_df.collect())


def test_streamed_buffers_make_the_same_chunks(spark):
    rng = random.Random(1)
    buffers = [("a", i, bytearray(rng.randbytes(100_000))) for i in range(50)] + [("b", 0, bytearray(b""))]
    got = chunks.appended_buffers(spark.createDataFrame(buffers, "key string, seq int, bytes binary"), "key").orderBy("key", "ix").collect()
    assert [r.size for r in got if r.key == "a"] == plain_chunks(5_000_000) and not [r for r in got if r.key == "b"]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 28, 81])
def test_file_fold_is_the_stack_builder(spark, n):
    parts = [("f", i, i + 1, sha(str(i))) for i in range(n)]
    df = spark.createDataFrame(parts, "path string, ix int, size long, chunk_id string")
    ids, _ = chunks.file_ids(df, spark.createDataFrame([("f",)], "path string"), "path", 3)
    items = [(s, f'{{"content":"{c}","size":{s},"type":"Chunk"}}') for _, _, s, c in parts]
    wrap = lambda xs: '{"parts":[' + ",".join(j for _, j in xs) + '],"type":"File"}'
    nested = lambda xs, i: (sum(s for s, _ in xs), f'{{"file":"{i}","size":{sum(s for s, _ in xs)},"type":"File"}}')
    assert ids.first().object_id == plain_fold(items, 3, wrap, nested)


def test_json_strings(spark):
    names = ["plain", 'q"b\\', "\x1f\x00\x08\t\n\x0c\r\x7f", "é/ 😀"]
    import json

    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", canon.json_string(F.col("n")).alias("j")).collect()
    assert {r.n: r.j for r in got} == {n: json.dumps(n, ensure_ascii=False) for n in names}


def test_golden_empty_directory_and_optional_members(spark):
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    row = spark.range(1).select(canon.text_id(canon.directory_object(empty)).alias("d"), canon.commit_object(F.lit("x"), empty, none, none, none, none).alias("c"), canon.root_object(F.lit("t"), F.lit("main"), F.lit("b"), none).alias("r")).first()
    assert row.d == "bc864e363e30272b02e9b7de72ec9982c5addaabce9e05b6819dcc9c076714f3"
    assert row.c == '{"directory":"x","parents":[],"type":"Commit"}'
    assert row.r == '{"branches":"b","defaultBranchName":"main","previousRoot":null,"timestamp":"t","type":"Root"}'


def test_tree_round_trip_with_empty_directories_and_order(spark):
    rows = [("a/b", 1, False, "x"), ("a-b", 2, True, "y"), ("d/e/f/g.txt", 3, False, "z"), ("top", 4, False, "w"), ("é", 5, False, "v")]
    files = spark.createDataFrame(rows, "path string, size long, executable boolean, target_id string")
    dirs, nodes = trees.tree(files, spark.createDataFrame([("hollow/in",)], "path string"), max_items=2)
    found = walk.scan(nodes, dirs.where("path = ''").select("object_id"))
    assert sorted(map(tuple, found.where("kind = 'File'").select("path", "size", "executable", "target_id").collect())) == sorted(rows)
    assert {r.path for r in found.where("kind = 'Directory'").collect()} == {"", "a", "d", "d/e", "d/e/f", "hollow", "hollow/in"}
    events = [(r.event, r.path) for r in walk.scan_events(found).orderBy("seq").collect()]
    assert events[:5] == [("EnterDirectory", ""), ("EnterDirectory", "a"), ("File", "a/b"), ("ExitDirectory", "a"), ("File", "a-b")]
    assert events[-1] == ("ExitDirectory", "")


def test_positions_of_a_list_over_many_tasks(spark):
    df = spark.createDataFrame([(i % 2, f"n{i:04}") for i in range(500)], "l int, name string").repartition(5)
    got = trees.positions(df, ["l"], ["name"]).collect()
    for k in (0, 1):
        assert [r.ix for r in sorted((r for r in got if r.l == k), key=lambda r: r.name)] == list(range(250))


def test_lookups(spark):
    entries = spark.createDataFrame([("", "Directory", "r"), ("a", "Directory", "d"), ("a/f", "File", "x")], "path string, kind string, target_id string")
    paths = spark.createDataFrame([("/",), ("a//f/",), ("a/f/x",), ("b",)], "path string")
    assert {r.path: r.found for r in walk.resolve(paths, entries).collect()} == {"/": "Root", "a//f/": "File", "a/f/x": "None", "b": "None"}
    parts = spark.createDataFrame([("f", 0, 100, "p"), ("f", 1, 200, "q"), ("f", 2, 150, "s")], "k string, ix int, size long, target_id string")
    probes = spark.createDataFrame([("f", p) for p in (0, 99, 100, 299, 300, 449, 450)], "k string, pos long")
    assert {r.pos: r.ix for r in walk.parts_at(probes, parts, "k").collect()} == {0: 0, 99: 0, 100: 1, 299: 1, 300: 2, 449: 2}


def test_history_and_reachability(spark):
    commits = spark.createDataFrame([("d", ["c", "b"]), ("c", ["b"]), ("b", ["a"]), ("a", [])], "commit_id string, parents array<string>")
    assert {r.commit_id: r.distance for r in walk.history(commits, commits.where("commit_id = 'd'")).collect()} == {"d": 0, "c": 1, "b": 1, "a": 2}
    refs = spark.createDataFrame([("r", "d1"), ("r", "d2"), ("d1", "f"), ("d2", "gone")], "object_id string, target_id string")
    have = spark.createDataFrame([("r",), ("d1",), ("d2",), ("f",)], "object_id string")
    assert {r.object_id for r in walk.fully_stored(have, refs).collect()} == {"d1", "f"}
    assert {r.object_id for r in walk.reachable(have.where("object_id = 'd1'"), refs).collect()} == {"d1", "f"}


def test_history_contracts(spark):
    rng = random.Random(8)
    parents = {f"c{i}": sorted({f"c{i - 1}", *([f"c{i - 5}"] if i % 10 == 0 else []), *([f"c{rng.randrange(i)}"] if rng.random() < 0.1 else [])}) for i in range(1, 200)}
    parents |= {"other": ["c3"], "c0": []}
    for starts in (["c199"], ["c120", "other"]):
        want, todo = {x: 0 for x in starts}, list(starts)
        for x in todo:
            for y in parents[x]:
                if y not in want:
                    want[y] = want[x] + 1
                    todo.append(y)
        commits = spark.createDataFrame(list(parents.items()), "commit_id string, parents array<string>")
        rows = walk.history(commits, spark.createDataFrame([(x,) for x in starts], "commit_id string"), core=60).collect()
        assert {r.commit_id: r.distance for r in rows} == want and len(rows) == len(want)


def test_commit_chain_is_whole(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    far = {n: 0}
    for i in range(n, 1, -1):
        for j in (i - 1, i - 5) if i % 10 == 0 else (i - 1,):
            far[j] = min(far.get(j, n), far[i] + 1)
    want = {hashlib.sha256(f"commit-{i}".encode()).hexdigest(): d for i, d in far.items()}
    assert {r.commit_id: r.distance for r in queries.QUERIES["commit_chain"](spark, sf).collect()} == want
