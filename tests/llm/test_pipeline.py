"""Each stage of the pipeline on a small table against a plain version of what it must do to its own input."""

import hashlib
import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_mixing import brute_targets
from tests.llm.test_near_dedup import brute
from tests.llm.test_quality import document


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(240):
        text = document(rng, i % 4 > 0)
        labels.append((i, int(i % 4 > 0), 0))
        rows.append((i, text, "en", f"s{i % 5}", len(text)))
        if i % 10 == 1:
            rows.append((1000 + i, text.replace(" ", "  "), "en", "s0", 0))
        if i % 10 == 2:
            rows.append((2000 + i, text + " extra", "en", None, 0))
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{sf_dir}/{name}")
        docs = spark.read.parquet(f"{sf_dir}/{name}")
        seen.append((name, docs.columns, docs.collect()))
    (_, c1, good), (_, c2, exact), (_, c3, near), (_, c4, mixed), (_, _, coded) = seen
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert c1 == c2 == c3 == c4 == columns
    kept = {r.doc_id for r in good}
    wrong = [i for i in range(240) if (i in kept) != (i % 4 > 0)]
    assert len(wrong) < 12 and all(before[r.doc_id] == r for r in good)

    first = {}
    for r in sorted(good):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r)
    assert sorted(exact) == sorted(first.values())

    groups = brute([(r.doc_id, r.text) for r in sorted(exact)], 5)
    assert sorted(r.doc_id for r in near) == sorted(i for i, _, c in groups if i == c)

    sizes, taken = {}, {}
    for r in near:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    longest = max(len(r.text.split()) for r in near)
    for source, target in brute_targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= longest / 2 + 1

    assert sorted(r.doc_id for r in coded) == sorted(r.doc_id for r in mixed)
    text = {r.doc_id: r.text for r in mixed}
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in coded)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100


def test_stages_take_odd_rows(spark, sf_dir):
    good = "Plain words of a sound document stand here in order and end well. " * 3
    rows = [(1, good, "en", "a", 1, 0.5, "k"), (1, good, "en", "a", 1, 0.5, "k"), (None, good + "Other.", None, None, None, None, None), (3, None, "en", "a", 0, 0.1, "z"), (4, "", "de", "b", 0, None, "z"), (5, good * 400, "en", "b", 9, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept string")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        seen[name] = out.collect()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        assert name == "bpe" or out.columns == docs.columns
    assert {r.doc_id for r in seen["quality"]} >= {1, None, 5} and sum(r.doc_id == 1 for r in seen["quality"]) == 2
    assert sorted((r.doc_id or 0, r.text) for r in seen["exact_dedup"]) == sorted([(1, good), (0, good + "Other."), (3, None), (5, good * 400)], key=lambda x: x[0])
    assert sum(r.doc_id == 1 for r in seen["near_dedup"]) == 1 and {3, 4} <= {r.doc_id for r in seen["near_dedup"]}
    assert len(seen["bpe"]) == len(rows) and [r.n_tokens for r in seen["bpe"] if r.doc_id in (3, 4)] == [0, 0]


def test_a_task_of_the_last_stage_has_one_python_worker(spark, sf_dir):
    """Words are encoded in one shuffle stage, texts are encoded and decoded in the next; no function in Python feeds another."""
    plan = corpus_pipeline.tokens(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 2
