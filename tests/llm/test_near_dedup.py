import random

from grovelake.llm.near_dedup import components, near_dedup, shingle_set, without_near_copies, words_of


def brute(rows, width, percent=80):
    sets = [shingle_set(words_of(t), width) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[max(find(i), find(j))] = min(find(i), find(j))
    return [(rows[i][0], len(sets[i]), rows[find(i)][0]) for i in range(len(rows))]


def corpus(seed, groups, copies, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(length)]
        for _ in range(rng.randint(1, copies)):
            edited = list(base)
            for _ in range(rng.randint(0, length // 12)):
                edited[rng.randrange(length)] = word()
            out.append((" ".join(edited)).upper() if rng.random() < 0.3 else " ".join(edited))
    rng.shuffle(out)
    return out


def check(spark, rows, width, **how):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, comp int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup(df, width=width, **how).collect())
    assert got == sorted((a, n, c, a == c) for a, n, c in brute(rows, width))


def test_matches_brute_force(spark):
    rows = list(enumerate(corpus(1, 25, 9, 60))) + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "two words"), (906, "Two  words")]
    check(spark, rows, 2)


def test_large_group_goes_through_the_last_round(spark):
    check(spark, list(enumerate(corpus(2, 1, 90, 40) + corpus(3, 6, 5, 40))), 2, star_rounds=1)


def test_five_word_shingles(spark):
    check(spark, list(enumerate(corpus(4, 12, 6, 120))), 5)


def test_repeated_ids_empty_table_and_rows_kept(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (None, text + " z", "b"), (2, "other words here", "c")], "doc_id long, text string, n string")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_dedup(df, width=2).collect())
    assert got == [(-1, 1, False), (1, 1, False), (1, 1, True), (2, 2, True)]
    assert near_dedup(df.limit(0)).count() == 0
    assert without_near_copies(df, width=2).count() == 2


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 130)]
    got = {r.v: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 130)}}
