import hashlib
import random

import pytest
from pyspark.sql import functions as F

from grovelake.operators import edit, merge, trees, walk
from grovelake.plans import queries

FILES = "path string, target_id string"


def test_list_modify(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, v int")
    mods = spark.createDataFrame([("b", "Set", 9), ("c", "Remove", None), ("x", "Remove", None), ("d", "Set", 4)], "key string, op string, v int")
    assert sorted(map(tuple, edit.list_modify(old, mods).collect())) == [("a", 1), ("b", 9), ("d", 4)]
    with pytest.raises(ValueError):
        edit.list_modify(old, mods.unionByName(mods))


def test_overlap_and_tree_modify(spark):
    paths = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("c",), ("c",)], "path string")
    assert sorted(map(tuple, edit.overlap_pairs(paths).collect())) == [("a", "a/b"), ("c", "c")]
    files = spark.createDataFrame([("d/x", "1"), ("d/y", "2"), ("f", "3"), ("g", "4")], FILES)
    mods = spark.createDataFrame([("d", "Set", "new"), ("f/in/z", "Set", "deep"), ("g", "Remove", None), ("none", "Remove", None)], "path string, op string, target_id string")
    assert sorted(map(tuple, edit.tree_modify(files, mods).collect())) == [("d", "new"), ("f/in/z", "deep")]
    for bad in ([("a", "Set", "1"), ("a/b", "Set", "2")], [("/", "Remove", None)]):
        with pytest.raises(ValueError):
            edit.tree_modify(files, spark.createDataFrame(bad, "path string, op string, target_id string"))


N, D1, D2 = None, ("Directory", "d1", None, None), ("Directory", "d2", None, None)
F1, F2, F3, X1, X2 = ("File", "f1", 1, False), ("File", "f2", 2, False), ("File", "f3", 3, False), ("File", "f1", 1, True), ("File", "f2", 2, True)


@pytest.mark.parametrize(
    "base, one, two, c1, c2, action, mode",
    [
        (F1, F1, F1, "Unchanged", "Unchanged", "TakeEither", None),
        (F1, F2, F2, "FileChanged", "FileChanged", "TakeEither", None),
        (F1, N, N, "FileRemoved", "FileRemoved", "TakeEither", None),
        (F1, F2, F1, "FileChanged", "Unchanged", "Take1", None),
        (F1, F1, N, "Unchanged", "FileRemoved", "Take2", None),
        (N, F1, N, "FileCreated", "Unchanged", "Take1", None),
        (N, N, D1, "Unchanged", "DirectoryCreated", "Take2", None),
        (F1, F2, F3, "FileChanged", "FileChanged", "MergeFiles", False),
        (F1, X2, F3, "FileChanged", "FileChanged", "MergeFiles", True),
        (F1, F2, X1, "FileChanged", "FileChanged", "TakeFile", True),
        (F1, N, F2, "FileRemoved", "FileChanged", "Conflict", None),
        (F1, D1, F2, "FileChangedToDirectory", "FileChanged", "Conflict", None),
        (F1, D1, D2, "FileChangedToDirectory", "FileChangedToDirectory", "MergeDirectories", None),
        (D1, D2, ("Directory", "d3", None, None), "DirectoryChanged", "DirectoryChanged", "MergeDirectories", None),
        (D1, N, D2, "DirectoryRemoved", "DirectoryChanged", "Conflict", None),
        (D1, F1, F2, "DirectoryChangedToFile", "DirectoryChangedToFile", "MergeFiles", False),
        (N, F1, F2, "FileCreated", "FileCreated", "MergeFiles", False),
        (N, F1, X2, "FileCreated", "FileCreated", "Conflict", None),
        (N, D1, D2, "DirectoryCreated", "DirectoryCreated", "MergeDirectories", None),
        (N, F1, D1, "FileCreated", "DirectoryCreated", "Conflict", None),
        (D1, F1, N, "DirectoryChangedToFile", "DirectoryRemoved", "Conflict", None),
    ],
)
def test_actions(spark, base, one, two, c1, c2, action, mode):
    df = spark.createDataFrame([(base, one, two)], f"base {merge.ENTRY}, one {merge.ENTRY}, two {merge.ENTRY}")
    row = df.select(merge.change(F.col("base"), F.col("one")).alias("c1"), merge.change(F.col("base"), F.col("two")).alias("c2"), merge.action(F.col("base"), F.col("one"), F.col("two")).alias("a")).first()
    assert (row.c1, row.c2, row.a.action, row.a.executable) == (c1, c2, action, mode)


def test_removed_directory_against_an_edit_inside_is_one_conflict(spark):
    rows = [("base", "D", "Directory", "d1", None, None), ("base", "D/x", "File", "f1", 1, False), ("base", "D/y", "File", "f1", 1, False)]
    rows += [("ours", "D", "Directory", "d2", None, None), ("ours", "D/x", "File", "f2", 1, False), ("ours", "D/y", "File", "f1", 1, False)]
    rows += [("theirs", "n", "File", "f9", 1, False)]
    snaps = spark.createDataFrame(rows, "side string, path string, kind string, target_id string, size long, executable boolean")
    zipped = merge.zipper(snaps)
    assert sorted((r.path, r.action) for r in merge.decisions(zipped).collect()) == [("D", "Conflict"), ("n", "Take1")]
    assert [(r.path, r.from_side) for r in merge.merged_files(snaps, zipped).collect()] == [("n", "theirs")]
    conflict = merge.decisions(zipped).where("action = 'Conflict'")
    assert [r.entry for r in merge.conflict_entries(conflict).orderBy("entry").collect()] == ["CONFLICT.txt", "base", "ours", "take"]
    note = merge.conflict_text(conflict.withColumn("outcome", F.lit(None).cast("string"))).first().text
    assert note.startswith("Two branches have changed D ") and "\ntheirs (first branch): Did not exist\n" in note and "\nfrom base to theirs: Removed directory\n" in note


@pytest.mark.parametrize(
    "base, one, two, outcome, content",
    [
        (b"line1\nline2\nline3\n", b"LINE1\nline2\nline3\n", b"line1\nline2\nLINE3\n", "Merged", b"LINE1\nline2\nLINE3\n"),
        (b"a\nb\nc\n", b"a\nX\nc\n", b"a\nY\nc\n", "MergeConflict", b"a\n<<<<<<< f_1\nX\n||||||| base\nb\n=======\nY\n>>>>>>> f_2\nc\n"),
        (None, b"x", b"y", "MergeConflict", b"<<<<<<< f_1\nx\n=======\ny\n>>>>>>> f_2\n"),
        (None, b"same", b"same", "Merged", b"same"),
        (b"", b"", b"", "Merged", b""),
        (b"a\0b", b"x", b"y", "Binary", None),
        (b"a", b"\xff\xfe", b"y", "Binary", None),
        (b"a" * 50, b"b" * 50, b"c" * 50, "TooLarge", None),
        (b"a\nb\n", b"a\nb\nc\n", b"z\na\nb\n", "Merged", b"z\na\nb\nc\n"),
        (b"a\nb\nc\n", b"a\nc\n", b"a\nb\nc\nd\n", "Merged", b"a\nc\nd\n"),
    ],
)
def test_text_merge(spark, base, one, two, outcome, content):
    df = spark.createDataFrame([("p/f", base if base is None else bytearray(base), bytearray(one), bytearray(two))], "path string, base binary, one binary, two binary")
    row = merge.text_merges(df, 100).first()
    assert (row.outcome, row.content if row.content is None else bytes(row.content)) == (outcome, content)


def test_lines():
    assert [merge.lines_of(x) for x in (b"", b"a\nb\n", b"a\nb", b"single", b"\n", b"a\r\n\x0cb")] == [[], [b"a\n", b"b\n"], [b"a\n", b"b"], [b"single"], [b"\n"], [b"a\r\n", b"\x0cb"]]


def plain_file(parts, most):
    """size, id of the file of parts (size, chunk), and its objects."""
    level, objects = [(s, f'{{"content":"{c}","size":{s},"type":"Chunk"}}') for s, c in parts], {}
    while True:
        made = []
        for i in range(0, max(len(level), 1), most):
            json = '{"parts":[' + ",".join(x for _, x in level[i : i + most]) + '],"type":"File"}'
            made.append((sum(s for s, _ in level[i : i + most]), hashlib.sha256(json.encode()).hexdigest()))
            objects[made[-1][1]] = json
        if len(made) == 1:
            return *made[0], objects
        level = [(s, f'{{"file":"{i}","size":{s},"type":"File"}}') for s, i in made]


def test_file_modify_within_rows_equals_that_of_tables(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for n in [0, 1, 2, 3, 4, 9, 10, 26, 27, 28, 40]:
        parts = [(rng.randint(1, 50), f"c{rng.randint(0, 9)}") for _ in range(n)]
        places = [sum(s for s, _ in parts[:i]) for i in range(n + 1)]
        now = {at: p for at, p in zip(places, parts)}
        mods = [(at, *rng.choice([("Set", 5, "new"), ("Remove", None, None)])) for at in rng.sample(places, rng.randint(0, n + 1))]
        for at, op, size, chunk in mods:
            now.pop(at, None)
            now |= {at: (size, chunk)} if op == "Set" else {}
        _, top, objects = plain_file(parts, 3)
        want[n] = plain_file([now[at] for at in sorted(now)], 3)[:2]
        rows.append((n, top, [*objects.items()], mods))
    files = spark.createDataFrame(rows, "list long, object_id string, objects array<struct<object_id:string,json:string>>, modifications array<struct<offset:long,op:string,size:long,chunk_id:string>>")
    got = {r.list: (r.size, r.object_id) for r in edit.file_modify_within(files, 41, 3).collect()}
    tables = edit.file_modify(files.selectExpr("inline(objects)").distinct(), files.select("list", "object_id"), files.selectExpr("list", "inline(modifications)"), 3)[0]
    assert got == want == {r.list: (r.size, r.object_id) for r in tables.collect()}
    with pytest.raises(Exception, match="more than 27 parts"):
        edit.file_modify_within(files, 20, 3).collect()
    twice = spark.createDataFrame([(*rows[1][:3], [(0, "Remove", None, None)] * 2)], files.schema)
    with pytest.raises(Exception, match="modified more than once"):
        edit.file_modify_within(twice, 20, 3).collect()


def test_orders_are_modified_without_storing_their_objects(spark, tmp_path, monkeypatch):
    stored = []

    def cut(df, done=trees.cut_lineage):
        stored.append(done(df))
        return stored[-1]

    for module in (trees, walk):
        monkeypatch.setattr(module, "cut_lineage", cut)
    lines = {1: 1, 2: 2, 3: 17, 4: 64}
    line = lambda o, n: [(o, i, o * 100 + i, i, 1.5, float(i % 50 + 1)) for i in range(n)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double"

    def want(o, n):
        parts = [(i % 50 + 1, hashlib.sha256(f"{o * 100 + i}:{i}".encode()).hexdigest()) for i in range(n)]
        new, end = (hashlib.sha256(x).hexdigest() for x in (b"new", b"end"))
        return (o, *plain_file([(7, new), *parts[2:], (9, end)], 3)[:2])

    for n in (None, 65):
        lines |= {5: n} if n else {}
        spark.createDataFrame([x for o, n in lines.items() for x in line(o, n)], schema).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
        got = sorted(map(tuple, queries.file_modify(spark, str(tmp_path)).collect()))
        assert got == [want(o, n) for o, n in lines.items()]
        if not n:
            assert sum(df.count() for df in stored) == 0
