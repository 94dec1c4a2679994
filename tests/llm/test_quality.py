import itertools
import random
import zlib

import numpy as np

from grovelake.llm.quality_crf import SEGMENT, fit, good_documents, good_marginals, held_out, line_features, score, spread_lines, train, train_chain


def document(rng, good):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    clean = lambda: " ".join(word() for _ in range(rng.randint(6, 20))).capitalize() + "."
    junk = lambda: rng.choice([" ".join([word() + "***"] * 9), " ".join(word().upper() + "!!" for _ in range(9)), " ".join([word()] * 20)])
    return "\n".join((clean if good or rng.random() < 0.2 else junk)() for _ in range(rng.randint(1, 9)))


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(1)
    unary, move = rng.normal(size=5), rng.normal(size=(2, 2))
    total, good = 0.0, np.zeros(5)
    for labels in itertools.product((0, 1), repeat=5):
        p = np.exp(sum(u for u, y in zip(unary, labels) if y) + sum(move[a, b] for a, b in zip(labels, labels[1:])))
        total += p
        good += p * np.array(labels)
    assert np.allclose(good_marginals(unary, move), good / total)


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    rows = [(i, document(rng, i % 3 > 0), int(i % 3 > 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("out", held_out(__import__("pyspark").sql.functions.col("doc_id")))
    labels = spark.createDataFrame([(i, q, None) for i, _, q in rows] + [(9999, 1, None), (1, None, None)], "doc_id long, quality int, toxic int")
    model = train(docs.where("not out"), labels)
    got = {r.doc_id: r for r in score(docs, model).collect()}
    assert all(got[i].out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    test = [i for i in got if got[i].out]
    assert len(test) > 40 and sum((got[i].score >= 0.3) == rows[i][2] for i in test) / len(test) > 0.95
    kept = {r.doc_id for r in good_documents(docs, model).collect()}
    assert kept == {i for i in got if got[i].score >= 0.3}


def test_odd_rows(spark):
    rng = random.Random(5)
    data = [(*line_features(document(rng, k)), k) for k in (0, 1) * 20]
    model = fit(data)
    df = spark.createDataFrame([(1, None), (1, ""), (None, "x\n" * 3000), (2, "a"), (2, "a")], "score long, text string")
    got = score(df, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert score(df.limit(0), model).count() == 0
    assert fit([]).score("anything") == 0.5
    assert fit(data[1::2]).score("anything") > 0.9


def test_lines_without_features_follow_their_neighbours():
    rng = np.random.default_rng(2)

    def chain():
        label = int(rng.integers(2))
        x = np.zeros((9, 2))
        x[4, 0], x[:, 1] = 2.0 * label - 1, 1.0  # one line tells, the others don't
        return x, np.full(9, label)

    weights, move = train_chain([chain() for _ in range(200)], steps=200)
    assert move[0, 0] + move[1, 1] > move[0, 1] + move[1, 0]
    for x, y in (chain() for _ in range(50)):
        assert ((good_marginals(x @ weights, move) > 0.5) == y).all()
        alone = good_marginals(x @ weights, np.zeros((2, 2)))
        assert np.ptp(np.delete(alone, 4)) < 1e-9  # without the chain these lines have one and the same probability


def test_lines_to_learn_from_are_bounded():
    assert spread_lines(200, 256).tolist() == list(range(200))
    at = spread_lines(1_000_000, 256)
    assert len(at) == 256 and at[0] == 0 and at[-1] == 999_999 and (np.diff(at).reshape(-1)[: SEGMENT - 1] == 1).all()

