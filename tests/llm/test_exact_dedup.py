import hashlib
import random
import re

from grovelake.llm.exact_dedup import exact_dedup, without_copies


def brute(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append((doc_id is None, doc_id or 0, i))
    out = []
    for text, members in groups.items():
        best = min(members)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(rows[i][0], rows[best[2]][0], len(members), sha) for _, _, i in members]
    return sorted(out, key=str), len(groups)


def check(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, pos string")
    got = exact_dedup(df, **how).collect()
    want, n_groups = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == n_groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def texts(rng, n):
    pool = ["".join(rng.choice("ab \n\té") for _ in range(rng.randint(0, 60))) for _ in range(n // 2)]
    return [rng.choice(pool) for _ in range(n)]


def test_matches_brute_force_with_small_blocks(spark):
    rows = list(enumerate(texts(random.Random(3), 120))) + [(500, None), (501, ""), (502, " "), (503, "\t\n")]
    check(spark, rows, block_bytes=4)


def test_collisions_of_the_routing_hash_do_not_matter(spark):
    check(spark, list(enumerate(texts(random.Random(4), 80))), block_bytes=4, hash_bits=2)


def test_long_text_differs_at_its_end_only(spark):
    a = "word " * 20000
    check(spark, [(1, a), (2, a + "x"), (3, a), (4, "y" + a)])


def test_repeated_and_null_ids(spark):
    check(spark, [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, None), (2, "b")])


def test_empty_table_and_rows_kept(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a ", 6), (3, "a", 7)], "doc_id long, text string, _rk int")
    assert exact_dedup(df.limit(0)).count() == 0
    assert sorted(map(tuple, without_copies(df).collect())) == [(1, "a", 5), (2, "a ", 6)]


def test_ids_that_are_not_integers(spark):
    df = spark.createDataFrame([("b", "x y"), ("a", "x\ty"), ("c", "x"), ("d", "x ")], "doc_id string, text string")
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup(df).collect()) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")]
