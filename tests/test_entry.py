import importlib.util

import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "path", "size", "n_chunks", "file_id"] and df.count() == 200


def test_registry():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and "file_ids" in names
    if importlib.util.find_spec("grovelake.llm"):
        assert {f"op{n}_" for n in range(1, 11)} == {n[: n.index("_") + 1] for n in names if n.startswith("op") and n[2].isdigit()}
