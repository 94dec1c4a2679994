import hashlib
import random

from pyspark.sql import functions as F

from grovelake.llm.fingerprints import combined, edited_fingerprints, fingerprints, sum_lanes


def edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    texts = [t or "" for _, t in order]
    out = {}
    for k, (i, _) in enumerate(order):
        t, n = texts[k], texts[(k + 1) % len(texts)]
        h = len(t) // 2
        out[i] = (len(t), hashlib.sha256((t[: len(t) - h] + n[:h]).encode()).hexdigest())
    return out


def test_edited_texts_and_likeness(spark):
    rng = random.Random(1)
    para = lambda: ". ".join(" ".join(rng.choice("abcdé") * rng.randint(1, 9) for _ in range(8)) for _ in range(3)) + "."
    rows = [(i * 3, "\n".join(para() for _ in range(rng.randint(1, 12)))) for i in range(40)] + [(500, None), (501, ""), (None, "last one\nof all")]
    rows.append((7, rows[3][1]))
    got = {r.doc_id: r for r in edited_fingerprints(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int")).collect()}
    assert {k: (r.n_chars, r.edited_sha256) for k, r in got.items()} == edits(rows)
    assert got[7].fingerprint == got[9].fingerprint and got[500].fingerprint == got[501].fingerprint
    assert len({r.fingerprint for r in got.values()}) == len(rows) - 2
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    long = [r for r in got.values() if r.n_chars > 600]
    assert sum(r.near_edited for r in long) / len(long) > 0.3 > 0.2 > sum(r.near_next for r in long) / len(long)


def test_slices_meet_at_their_ends(spark):
    rng = random.Random(3)
    ids = rng.sample(range(-500, 5000), 90)
    rows = [(i, "".join(rng.choice("ab\n. ") for _ in range(rng.randint(0, 30)))) for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1, 7, 60):
        got = {r.doc_id: (r.n_chars, r.edited_sha256) for r in edited_fingerprints(df, slice_rows=size).collect()}
        order = sorted(rows, reverse=True)
        want = {}
        for k, (i, t) in enumerate(order):
            h, following = len(t) // 2, order[(k + 1) % len(order)][1]
            want[i] = (len(t), hashlib.sha256((t[: len(t) - h] + following[:h]).encode()).hexdigest())
        assert got == want


def test_order_does_not_matter_and_paragraphs_come_and_go(spark):
    df = spark.createDataFrame([(1, "a b. c\nd e\nf"), (2, "f\nd e\na b. c"), (3, "a b. c\nf"), (4, "d e")], "doc_id long, text string")
    prints = {r.doc_id: r.fingerprint for r in fingerprints(df).collect()}
    assert prints[1] == prints[2] != prints[3]
    lanes = df.groupBy().pivot("doc_id", [1, 3, 4]).agg(F.first(sum_lanes(F.col("text"))))
    reduced = lambda c: F.transform(c, lambda x: F.pmod(x, F.lit(1 << 32)))
    row = lanes.select(reduced(combined(F.col("3"), F.col("4"))).alias("added"), F.col("1").alias("whole"), reduced(combined(F.col("1"), F.col("4"), -1)).alias("less"), F.col("3").alias("short")).first()
    assert row.added == row.whole and row.less == row.short


def test_repeated_rows_single_row_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x y"), (1, "x y"), (1, "z")], "doc_id long, text string")
    assert edited_fingerprints(df).count() == 3 and fingerprints(df).count() == 3
    one = edited_fingerprints(df.where("text = 'z'")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"z").hexdigest()
    assert edited_fingerprints(df.limit(0)).count() == 0
