import os

import pytest
from pyspark.sql import functions as F

from grovelake.functions import canon, text
from grovelake.operators import caches, reconcile, sync, trees
from grovelake.plans import queries
from grovelake.sources import file_store, ignore
from grovelake.sources.repository import Repository


def test_ignore_rules(spark):
    paths = [("a.log", "File"), ("important.log", "File"), ("sub", "Directory"), ("sub/x.bak", "File"), ("sub/a.log", "File"), (".git", "Directory"), (".git/config", "File"), ("deep/.tfs", "Directory"), ("deep/.tfs/s", "File"), ("x.bak", "File"), ("build", "File"), ("q/build", "Directory"), ("q/build/o", "File")]
    entries = spark.createDataFrame(paths, "path string, kind string")
    rules = ignore.rules_table(spark, [("", "# note\n*.log\n!important.log\nbuild/\n"), ("sub", "*.bak\n!a.log")])
    assert {r.path for r in ignore.visible(entries, rules).collect()} == {"important.log", "sub", "x.bak", "build"}


def test_patterns():
    import re

    for glob, name, hit in [("*.l?g", "a.log", True), ("[a-c]x", "bx", True), ("[!a-c]x", "bx", False), ("\\#x", "#x", True), ("a.b", "aXb", False), ("**/foo", "foo", True)]:
        assert bool(re.search(ignore.pattern(glob)[0], name)) == hit, glob
    assert ignore.pattern("") is ignore.pattern("# c") is None


def test_store_scan_apply_and_rescan(spark, tmp_path):
    (tmp_path / "d/empty").mkdir(parents=True)
    (tmp_path / "d/f.txt").write_text("hello")
    (tmp_path / "run.sh").write_text("x")
    os.chmod(tmp_path / "run.sh", 0o755)
    (tmp_path / "skip.log").write_text("y")
    (tmp_path / ".gitignore").write_text("*.log\n")
    os.symlink(tmp_path / "run.sh", tmp_path / "link")
    got = {r.path: r for r in file_store.entries(spark, str(tmp_path)).collect()}
    assert set(got) == {"d", "d/empty", "d/f.txt", "run.sh", ".gitignore"}
    assert got["run.sh"].executable and got["run.sh"].fingerprint.endswith(":1:x") and got["d/empty"].kind == "Directory" and got["d"].fingerprint is None
    read = {r.path: bytes(r.content) for r in file_store.contents(spark, str(tmp_path)).collect()}
    assert read["d/f.txt"] == b"hello"

    repo = spark.createDataFrame([("d", "Directory", "D", None), ("d/f.txt", "Directory", "E", None), ("d/f.txt/g", "File", "G", True), ("new.txt", "File", "N", False), ("run.sh", "File", "R", False)], "path string, kind string, target_id string, executable boolean")
    store = file_store.entries(spark, str(tmp_path)).withColumn("cached_fingerprint", F.col("fingerprint")).withColumn("cached_id", F.when(F.col("path") == "run.sh", "R"))
    steps = trees.cut_lineage(reconcile.plan(repo, store))
    lines = [r.line for r in reconcile.rendered(reconcile.in_order(steps)).collect()]
    assert sorted(lines) == sorted(["rm .gitignore", "rm d/empty", "rm d/f.txt", "mkdir d/f.txt", "download d/f.txt/g <- G+x", "download new.txt <- N", "chmod -x run.sh"])
    files = spark.createDataFrame([("G", bytearray(b"g")), ("N", bytearray(b"n"))], "target_id string, content binary")
    file_store.apply(steps, str(tmp_path), files)
    after = {r.path: r for r in file_store.entries(spark, str(tmp_path)).collect()}
    assert set(after) == {"d", "d/f.txt", "d/f.txt/g", "new.txt", "run.sh", "skip.log"}
    assert after["d/f.txt/g"].executable and not after["run.sh"].executable and (tmp_path / "new.txt").read_bytes() == b"n"
    with pytest.raises(Exception):
        file_store.entries(spark, str(tmp_path / "none")).collect()


def test_plan_cases(spark):
    repo = spark.createDataFrame([("a", "Directory", "A", None), ("b", "File", "B", False), ("c", "File", "C", False)], "path string, kind string, target_id string, executable boolean")
    store = spark.createDataFrame([("a", "File", False, "1", "1", "x"), ("b", "Directory", None, None, None, None), ("b/in", "File", False, "1", None, None), ("gone", "Directory", None, None, None, None), ("gone/x", "File", False, "1", None, None), ("c", "File", False, "2", "2", "old")], "path string, kind string, executable boolean, fingerprint string, cached_fingerprint string, cached_id string")
    got = sorted((r.path, r.step, r.action) for r in reconcile.plan(repo, store).collect())
    assert got == [("a", 0, "rm"), ("a", 1, "mkdir"), ("b", 0, "rm"), ("b", 1, "download"), ("c", 0, "rm"), ("c", 1, "download"), ("gone", 0, "rm")]
    assert reconcile.root_actions("File") == ["rm", "mkdir"] and reconcile.root_actions(None) == ["mkdir"] and reconcile.root_actions("Directory") == []


def test_staging(spark):
    downloads = spark.createDataFrame([("F",), ("F",), (None,)], "target_id string")
    parts = spark.createDataFrame([("F", 3, "c1"), ("F", 4, "c2"), ("G", 5, "c3")], "file_id string, size long, chunk_id string")
    staged = spark.createDataFrame([("c1", bytearray(b"one"))], "chunk_id string, bytes binary")
    assert [r.chunk_id for r in reconcile.chunks_to_stage(downloads, parts, staged).collect()] == ["c2"]
    objects = spark.createDataFrame([("c1", bytearray(b"far")), ("c2", bytearray(b"two"))], "object_id string, bytes binary")
    assert {r.chunk_id: bytes(r.bytes) for r in reconcile.read_staged(parts.where("file_id = 'F'"), staged, objects).collect()} == {"c1": b"one", "c2": b"two"}


def test_caches(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "key string, value string")
    pending = spark.createDataFrame([("b", "Set", "9", 1), ("b", "Del", None, 2), ("c", "Del", None, 1), ("c", "Set", "8", 2), ("d", "Set", "7", 1)], "key string, op string, value string, seq long")
    assert sorted(map(tuple, caches.overlay(base, pending).collect())) == [("a", "1"), ("c", "8"), ("d", "7")]
    assert [r.key for r in caches.prefix_scan(base.unionByName(spark.createDataFrame([("bb", "x")], "key string, value string")), "b").collect()] == ["b", "bb"]
    table = spark.createDataFrame([("k", "old", 1)], "key string, v string, at long")
    assert [tuple(r) for r in caches.upsert(table, spark.createDataFrame([("k", "new", 2)], "key string, v string, at long"), ["key"], "at").collect()] == [("k", "new", 2)]
    abc = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    local = spark.createDataFrame([(abc, "p", 1, 3), (abc, "q", 0, 3), (abc, "z", 0, 3)], "chunk_id string, path string, offset long, length long")
    files = spark.createDataFrame([("p", bytearray(b"xxxx")), ("q", bytearray(b"abc"))], "path string, content binary")
    found, stale = caches.verified(caches.local_candidates(local.select("chunk_id"), local), files)
    assert [(r.path, bytes(r.bytes)) for r in found.collect()] == [("q", b"abc")] and {r.path for r in stale.collect()} == {"p", "z"}
    gone = caches.without_paths(local, spark.createDataFrame([("p",)], "path string"))
    assert {r.path for r in gone.collect()} == {"q", "z"}
    ids = spark.createDataFrame([("a",), ("a",), ("b",)], "object_id string")
    assert [r.object_id for r in caches.unknown(ids, spark.createDataFrame([("b",)], "object_id string")).collect()] == ["a"]


def test_sync_planning(spark):
    dirs = ["/a", "/a/b/c", "/a/b", "/z", "/a/b/c/d"]
    items = spark.createDataFrame([(f"s{i}", "r", "main", "c1", d) for i, d in enumerate(dirs)], "store string, repo_url string, branch string, base_commit string, repo_dir string")
    assert [r.repo_dir for r in sync.ordered(items).orderBy("sync_no").collect()] == ["/a/b/c/d", "/a/b/c", "/a/b", "/a", "/z"]
    assert {r.repo_dir: r.batch for r in sync.batches(items).collect()} == {"/a/b/c/d": 0, "/z": 0, "/a/b/c": 1, "/a/b": 2, "/a": 3}
    assert (sync.add_sync_action(0, 0, False, False), sync.add_sync_action(0, 5, False, False), sync.add_sync_action(2, 0, False, False)) == ("create", "download", "upload")
    for case in ((1, 1, False, False), (0, 0, True, False), (0, 0, False, True)):
        with pytest.raises(ValueError):
            sync.add_sync_action(*case)
    states = spark.createDataFrame([("s", "current", "b1"), ("s", "next", "b2"), ("t", "current", "b3")], "store string, slot string, base_commit string")
    assert {r.store: (r.base_commit, r.blocked) for r in sync.current_states(states).collect()} == {"s": ("b2", True), "t": ("b3", False)}
    assert not [r for r in sync.current_states(states, True).collect() if r.blocked]


def test_repository(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "repo"))
    root = repo.initialize(timestamp="2024-01-01T00:00:00Z", name="u")
    assert repo.info() == {"uuid": "u"} and repo.current_root() == root
    with pytest.raises(FileExistsError):
        repo.initialize()
    first = repo.read(root, "Root")
    assert first["previousRoot"] is None and first["defaultBranchName"] == "main"
    with pytest.raises(TypeError):
        repo.read(root, "Commit")
    with pytest.raises(KeyError):
        repo.read("00")
    head = repo.branches(first["branches"]).first()
    data = bytearray(b"abc")
    repo.write(spark.createDataFrame([("ba78" + "0" * 60, data), ("ba78" + "0" * 60, data)], "object_id string, bytes binary"))
    repo.write(spark.createDataFrame([("ba78" + "0" * 60, data)], "object_id string, bytes binary"))
    assert repo.objects().where("prefix = 'ba'").count() == 1 and repo.exists("ba78" + "0" * 60) and repo.read("ba78" + "0" * 60) == b"abc"

    def change(current):
        commit = repo.next_commit(head.commit_id, repo.read(head.commit_id, "Commit")["directory"], timestamp="t", message="m")
        return repo.next_root(current, repo.next_branches(repo.read(current, "Root")["branches"], {"main": commit, "side": commit}), timestamp="t")

    new = repo.update(change)
    now = repo.read(new, "Root")
    assert now["previousRoot"] == root and {r.name for r in repo.branches(now["branches"]).collect()} == {"main", "side"}
    commit = repo.read(repo.branches(now["branches"]).where("name = 'main'").first().commit_id, "Commit")
    assert commit["parents"] == [head.commit_id] and commit["metadata"] == {"message": "m", "timestamp": "t"}
    assert repo.swap_current_root(root, "x") == (False, new)
    with pytest.raises(RuntimeError):
        repo.update(lambda c: (repo.set_current_root(c + "x"), c)[1], attempts=2)


def test_functions(spark):
    df = spark.createDataFrame([("/a", "b/../c//d"), ("/a", "/x/")], "base string, path string")
    assert [r[0] for r in df.select(text.resolved_path(F.col("base"), F.col("path"))).collect()] == ["/a/b/../c/d", "/x"]
    names = ["plain", "a b", "it's", "x$y"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(text.shell_escaped(F.col("n"))).collect()
    assert [r[0] for r in got] == ["plain", "'a b'", "'it'\\''s'", "'x$y'"]
    row = spark.range(1).select(text.reverse_timestamp(F.lit(5).cast("long")).alias("r"), text.executable_mode(F.lit(0o644)).alias("m"), text.executable_mode(F.lit(0o744)).alias("x"), text.overlaps(F.lit("a"), F.lit("a/b")).alias("o"), text.overlaps(F.lit("a"), F.lit("ab")).alias("p")).first()
    assert (row.r, row.m, row.x, row.o, row.p) == ("18446744073709551610", False, True, True, False)
    assert canon.MAX_DIRECTORY == 256


def test_local_chunk_candidates_of_many_copies(spark, tmp_path):
    docs = [(i, "the same text" if i < 300 else f"text {i % 5}", "en", "web") for i in range(325)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["local_chunk_candidates"](spark, str(tmp_path)).collect()
    assert sorted(r.nth for r in rows) == sorted([*range(1, 257), *[n for n in range(1, 6) for _ in range(5)]])


def test_contents_of_names_that_spark_passes_over(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    for name in ("__init__.py", ".gitignore", "_x", "a b%20.txt"):
        (tmp_path / "pkg" / name).write_bytes(name.encode())
    got = {r.path: bytes(r.content) for r in file_store.contents(spark, str(tmp_path)).collect()}
    assert got == {f"pkg/{n}": n.encode() for n in ("__init__.py", ".gitignore", "_x", "a b%20.txt")}
    some = spark.createDataFrame([("pkg/_x",), ("pkg",), ("none",)], "path string")
    assert [r.path for r in file_store.contents(spark, str(tmp_path), some).collect()] == ["pkg/_x"]


def test_repository_and_store_in_another_file_system(spark, tmp_path):
    """viewfs:// is a scheme that only Hadoop's FileSystem and Spark's readers understand."""
    from grovelake.sources.hadoop_fs import Folder
    from grovelake.sources.repository import PathError
    from grovelake.sources.sync_state import StateFile, SyncState

    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.own.link./r", f"file://{tmp_path}")
    repo = Repository(spark, "viewfs://own/r/repo")
    first = repo.initialize()
    assert repo.current_root() == first and repo.branch("no") is None
    commit = repo.branch()
    empty = repo.directory(commit)
    assert repo.entries(empty).count() == 0 and repo.find_entry(empty, "a") is None
    assert repo.resolve_to_directory(empty, "//") == empty
    with pytest.raises(PathError, match="NotFound: a/b"):
        repo.resolve_to_directory(empty, "a/b")
    assert repo.swap_current_root("other", "x") == (False, first) and repo.swap_current_root(first, "x") == (True, "x")
    assert Repository(spark, str(tmp_path / "repo")).current_root() == "x"
    with pytest.raises(FileExistsError):
        repo.initialize()

    (tmp_path / "store/d e").mkdir(parents=True)
    (tmp_path / "store/d e/f.txt").write_bytes(b"abc")
    got = {(r.path, r.kind, r.size, r.executable) for r in file_store.entries(spark, "viewfs://own/r/store").collect()}
    assert {("d e", "Directory", None, None), ("d e/f.txt", "File", 3, False)} == got
    assert {r.path: bytes(r.content) for r in file_store.contents(spark, "viewfs://own/r/store").collect()}["d e/f.txt"] == b"abc"
    with pytest.raises(ValueError):
        file_store.apply(spark.createDataFrame([], "path string, step int, action string, target_id string, executable boolean"), "viewfs://own/r/store", None)

    state = StateFile("viewfs://own/r/store", spark)
    one = SyncState("now", "u", "/", "main", "c")
    state.set_next(one)
    state.commit_next()
    assert state.current() == one and state.next() is None
    for place in ("viewfs://own/r/files", str(tmp_path / "files2")):
        files = Folder(spark, place)
        assert files.create("a/b", "1") and not files.create("a/b", "2") and files.read("a/b") == "1" and files.read("none") is None
        files.replace("a/b", "3")
        assert files.read("a/b") == "3" and files.names("a") == ["b"] and files.names("z") == []
