import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from grovelake import cli
from grovelake.sources import syncing
from grovelake.sources.repository import Repository
from grovelake.streaming import changes


def test_upload_and_download_round_trip(spark, tmp_path, capsys):
    store, other, repo = tmp_path / "store", tmp_path / "other", str(tmp_path / "repo")
    (store / "a/empty").mkdir(parents=True)
    (store / "a/f.bin").write_bytes(bytes(range(256)) * 100)
    (store / "zero").write_bytes(b"")
    (store / "run").write_text("#!")
    os.chmod(store / "run", 0o755)
    other.mkdir()
    (other / "old").write_text("gone")
    Repository(spark, repo).initialize()
    cli.main([repo, "upload-directory", str(store), "--message", "first"])
    directory = capsys.readouterr().out.split()[0]
    cli.main([repo, "ls", directory, "--long", "--classify"])
    assert capsys.readouterr().out.splitlines() == ["d   a/", "x 2 run*", "- 0 zero"]
    cli.main([repo, "download-directory", directory, str(other), "--dry-run"])
    lines = capsys.readouterr().out.splitlines()
    assert lines[:2] == ["mkdir a", "mkdir a/empty"] and (other / "old").exists() and len(lines) == 6
    cli.main([repo, "download-directory", directory, str(other)])
    assert (other / "a/f.bin").read_bytes() == (store / "a/f.bin").read_bytes() and (other / "zero").read_bytes() == b""
    assert os.access(other / "run", os.X_OK) and (other / "a/empty").is_dir() and not (other / "old").exists()
    assert syncing.upload(Repository(spark, repo), str(other)) == directory


def test_files_branches_and_paths(spark, tmp_path, capsys):
    repo, file = str(tmp_path / "repo"), tmp_path / "one file"
    file.write_bytes(b"\x00abc" * 50_000)
    told = lambda *args: (cli.main([repo, *args]), capsys.readouterr().out.strip())[1]
    told("initialize")
    chunk = told("write", str(file))
    assert told("exists", chunk) == "true"
    whole = told("upload-file", str(file))
    told("download-file", whole, str(tmp_path / "copy"))
    assert (tmp_path / "copy").read_bytes() == file.read_bytes()
    name, commit = told("branches").split()
    directory = Repository(spark, repo).directory(commit)
    assert name == "main" and told("resolve", directory, "/") == f"Root {directory}" and told("resolve", directory, "x") == "None"


def test_columns():
    names = ["a", "bb", "ccc", "d", "e"]
    assert cli.columns(names, 11) == ["a    ccc", "bb   d", "e"] or cli.columns(names, 11) == ["a    d", "bb   e", "ccc"]
    assert cli.columns(names, 11, True) == ["a    bb", "ccc  d", "e"] and cli.columns([], 80) == []


def test_stream_of_changes(spark, tmp_path):
    schema = "path string, op string, size long, executable boolean, target_id string, seq long"
    src, table = str(tmp_path / "src"), str(tmp_path / "table")
    spark.createDataFrame([("a", "Set", 1, False, "x", 1), ("a", "Set", 2, False, "y", 2), ("b/c", "Set", 3, True, "z", 3)], schema).write.parquet(src)
    state = {"df": spark.createDataFrame([("old", 1, False, "o")], "path string, size long, executable boolean, target_id string")}

    def write(df):
        df.write.mode("overwrite").parquet(table)
        state["df"] = spark.read.parquet(table)

    changes.sync_changes(spark.readStream.schema(schema).parquet(src), lambda: state["df"], write, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.path, r.target_id) for r in state["df"].collect()) == [("a", "y"), ("b/c", "z"), ("old", "o")]


def test_stream_of_buffers(spark, tmp_path):
    start, src = datetime(2024, 1, 1), str(tmp_path / "buffers")
    rows = [("k", start + timedelta(minutes=i), bytearray(b"x" * 10_000)) for i in range(3)] + [("k", start + timedelta(hours=5), bytearray(b"y"))]
    spark.createDataFrame(rows, "key string, ts timestamp, bytes binary").write.parquet(src)
    sized = changes.upload_sizes(spark.readStream.schema("key string, ts timestamp, bytes binary").parquet(src))
    query = sized.writeStream.outputMode("append").format("memory").queryName("uploads").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.size, r.chunk_sizes) for r in spark.table("uploads").where(F.col("size") > 1).collect()] == [(30_000, [16384, 13616])]
