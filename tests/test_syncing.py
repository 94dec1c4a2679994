import pytest

from grovelake.sources import specs, syncing
from grovelake.sources.repository import Repository
from grovelake.sources.sync_state import StateFile, SyncState


def test_two_stores_and_a_conflict(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    (a / "d").mkdir(parents=True)
    b.mkdir()
    (a / "d/x.txt").write_text("1\n2\n3\n4\n5\n")
    (a / "same").write_text("s")
    (a / "gone").write_text("g")
    repo = Repository(spark, str(tmp_path / "repo"))
    repo.initialize()
    assert syncing.add_sync(repo, "u", str(a), "/proj") == "upload"
    assert syncing.add_sync(repo, "u", str(b), "/proj") == "download"
    assert (b / "d/x.txt").read_text() == "1\n2\n3\n4\n5\n"
    with pytest.raises(ValueError):
        syncing.add_sync(repo, "u", str(b), "/proj")

    (a / "d/x.txt").write_text("one\n2\n3\n4\n5\n")
    (a / "new").write_text("n")
    assert [r["ok"] for r in syncing.run_syncs(repo, "u", [str(a)])] == [True]
    (b / "d/x.txt").write_text("1\n2\n3\n4\nfive\n")
    (b / "gone").unlink()
    out = syncing.run_syncs(repo, "u", [str(b)])
    assert out[0]["ok"] and out[0]["conflicts"] == []
    assert (b / "d/x.txt").read_text() == "one\n2\n3\n4\nfive\n" and (b / "new").exists() and not (b / "gone").exists()

    (a / "same").write_text("A")
    (b / "same").write_text("B")
    syncing.run_syncs(repo, "u", [str(a)])
    assert (a / "d/x.txt").read_text() == "one\n2\n3\n4\nfive\n"
    out = syncing.run_syncs(repo, "u", [str(b)])
    assert out[0]["conflicts"] == ["proj/same"]
    assert sorted(p.name for p in (b / "same").iterdir()) == ["CONFLICT.txt", "base", "merged", "ours", "take", "theirs"]
    assert (b / "same/theirs").read_text() == "A" and (b / "same/ours").read_text() == "B"


def test_states(spark, tmp_path):
    file = StateFile(str(tmp_path), spark)
    assert file.current() is file.next() is None
    with pytest.raises(ValueError):
        file.commit_next()
    state = SyncState("t", "u", "/", "main", "c")
    file.set_next(state)
    assert file.next() == state and file.current() is None
    file.commit_next()
    assert file.current() == state and file.next() is None
    file.set_next(state)
    file.set_next(None)
    assert file.next() is None


def test_specs_and_limits():
    config = specs.read_config("[network]\nread-bytes=100MB\n[s3]\nread-bytes=inherit\n[repository.mine]\nurl=s3://bucket/pre/\nread-bytes=none\n[filestore.f]\nurl=/x", ("s3.requests=7",))
    assert specs.parse("mine", config) == specs.Spec("s3", "bucket/pre", "mine") and specs.parse("mine", config).uri() == "s3a://bucket/pre"
    assert specs.parse("f", config, "filestore", True).uri() == "file:///x" and specs.parse("file:///y").location == "/y"
    for bad, error in (("s3://", ValueError), ("unknown", KeyError), ("/abs", KeyError)):
        with pytest.raises(error):
            specs.parse(bad, config)
    with pytest.raises(ValueError):
        specs.parse("http://x", store=True)
    assert specs.limit(config, "read_bytes", "s3", "network") == 100 << 20 and specs.limit(config, "read_bytes", "repository.mine", "network") is None
    assert specs.limit(config, "requests", "s3") == 7 and specs.byte_count("3 kb") == 3072 and specs.byte_count("7b") == 7


def test_cached_and_staged(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    (a / "d").mkdir(parents=True)
    b.mkdir()
    (a / "d/__init__.py").write_text("x = 1\n")
    (a / "big").write_bytes(bytes(range(256)) * 400)
    (a / "zero").write_bytes(b"")
    repo = Repository(spark, str(tmp_path / "repo"))
    repo.initialize()
    cache, stage = syncing.FingerprintCache(spark, str(tmp_path / "cache")), syncing.Stage(spark, str(tmp_path / "stage"))
    first = syncing.upload(repo, str(a), cache)
    assert first == syncing.upload(repo, str(a)) and cache.table().count() == 3

    # A file whose fingerprint is known isn't read: its id comes from the cache.
    other = cache.table().where("path = 'zero'").first().object_id
    cache.upsert(cache.table().where("path = 'big'").drop("at", "object_id").selectExpr("*", f"'{other}' AS object_id"))
    assert syncing.upload(repo, str(a), cache) != first

    lines = syncing.download(repo, first, str(b), cache=cache, stage=stage)
    assert len(lines) == 4 and (b / "big").read_bytes() == (a / "big").read_bytes() and (b / "d/__init__.py").read_text() == "x = 1\n"
    assert not (tmp_path / "stage").exists()
    assert syncing.download(repo, first, str(b), cache=cache) == []
    (b / "big").write_bytes(b"changed")
    assert [x.split()[0] for x in syncing.download(repo, first, str(b), cache=cache, stage=stage)] == ["rm", "download"]
    assert (b / "big").read_bytes() == (a / "big").read_bytes()
