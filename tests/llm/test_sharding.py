import pytest

from grovelake.llm.sharding import lookup_table, shard


def plain(shards, slots):
    import hashlib

    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    orders = [[(number(f"offset:{s}") % slots + i * (number(f"skip:{s}") % (slots - 1) + 1)) % slots for i in range(slots)] for s in shards]
    table = {}
    while len(table) < slots:
        for k, order in enumerate(orders):
            free = next((x for x in order if x not in table), None)
            if free is not None:
                table[free] = k
    return [table[i] for i in range(slots)]


def test_table_is_that_of_the_plain_turns():
    names = tuple("abcdefg")
    assert lookup_table(names, 101) == plain(names, 101)


def test_even_and_stable():
    names = tuple(f"s{i}" for i in range(10))
    full, less = lookup_table(names, 4099), lookup_table(names[:-1], 4099)
    counts = [full.count(k) for k in range(10)]
    assert max(counts) - min(counts) <= 1
    moved = sum(a != b for a, b in zip(full, less) if a != 9)
    assert moved < 0.25 * 4099


def test_wrong_tables():
    for shards, slots in (((), 7), (("a", "a"), 7), (("a", "b"), 6), (("a", "b", "c"), 2)):
        with pytest.raises(ValueError):
            lookup_table(shards, slots)


def test_rows(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (2, "z")], "doc_id long, slot string")
    got = shard(df).collect()
    assert len(got) == 4 and len({r.shard for r in got if r.doc_id == 1}) == 1 and all(0 <= r.slot < 4099 for r in got)
    assert shard(df.limit(0)).count() == 0
