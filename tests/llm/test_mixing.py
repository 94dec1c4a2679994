import random

from grovelake.llm.mixing import mix, mixed


def brute_targets(sizes, weights=(3, 1, 2), budget=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    full, total = set(), budget * sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = sum(w[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else rest * w[s] / free for s in order}
        over = {s for s in order if target[s] > most * sizes[s] and s not in full}
        if not over:
            return target
        full |= over


def test_targets_and_sums(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["b", "a", "é", "", None, "zz", "rare"][: 6 if i else 7])) for i in range(600)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 600
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute_targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] for r in own)
        assert sum(r.taken for r in own) == round(want[s]) or abs(sum(r.taken for r in own) - want[s]) <= 0.5
        assert all(0 <= r.taken <= 2 * r.size and abs(r.copies * r.size - r.taken) <= r.size / 2 for r in own)
    again = mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, 1), (None, "a b", "s", 2), (None, "a b", "s", 2), (3, " \t", "t", 3)], "doc_id long, text string, source string, size int")
    got = mix(df).collect()
    assert len(got) == 4 and sum(r.taken for r in got) == 6
    assert mix(df.limit(0)).count() == 0
    only_empty = mix(df.where("text is null")).collect()
    assert [(r.size, r.target, r.taken) for r in only_empty] == [(0, 0.0, 0)]


def test_rows_of_the_mix(spark):
    df = spark.createDataFrame([(i, "a b c d", "st"[i % 2], i) for i in range(40)], "doc_id long, text string, source string, copies int")
    out = mixed(df)
    assert out.columns == df.columns
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert sum(n.values()) == 60 and max(n.values()) <= 2
