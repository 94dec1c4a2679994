import random
import re

from grovelake.llm.license_scan import TEMPLATES, license_scan, template_bigrams


def brute(text, threshold=0.8):
    known = template_bigrams()
    lines = (text or "").split("\n")
    segments = list(lines)
    if "\n\n" in (text or ""):
        segments += [p for p in re.split("\n{2,}", text) if "\n" in p]
    if len(lines) > 1:
        segments.append(text)
    bigrams = lambda s: [f"{a} {b}" for w in [[x.lower() for x in re.findall("[A-Za-z0-9]+", s)]] for a, b in zip(w, w[1:])]
    dice = lambda own, t: (-2.0 * len({*own} & {*t["pairs"]}) / (len({*own}) + len(t["pairs"])), t["name"])
    best = [min((dice(own, t) for t in known), default=(0, "")) for s in segments if (own := bigrams(s))]
    found = [m for m in best if m[0] <= -threshold]
    whole, windows = bigrams(text or ""), []
    for t in known:
        starts = {max(0, i - t["order"].index(p)) for i, p in enumerate(whole) if p in t["anchors"]}
        m = min((dice(whole[a : a + len(t["order"])], t) for a in starts), default=(0, ""))
        windows += [m] * (m[0] <= -threshold)
    both = found + windows
    return len(found), len(windows), ",".join(sorted({n for _, n in both})), min(both)[1] if both else None, -min(both)[0] if both else 0.0


def test_matches_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", "\n\n", "no licence here at all", "LICENSED under the   mit license", "Licensed under CC BY-NC 4.0.\nand more\n\nReleased under\nthe MIT License."]
    for _ in range(150):
        words = rng.choice(TEMPLATES)[1].split()
        for _ in range(rng.randint(0, 2 + len(words) // 6)):
            words[rng.randrange(len(words))] = rng.choice(["x", "the", "License,"])
        for _ in range(rng.randint(0, 3)):
            words.insert(rng.randrange(len(words)), "\n")
        texts.append(rng.choice(["", "some text before\n", "para\n\n"]) + " ".join(words) + rng.choice(["", "\nafter it", "\n\nafter"]))
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, m string")
    got = {r.doc_id: (r.n_matches, r.n_windows, r.licenses, r.best_license, r.best_dice) for r in license_scan(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, "Released under the MIT License.")] * 2, "doc_id long, text string")
    assert [r.licenses for r in license_scan(df).collect()] == ["MIT", "MIT"]
    assert license_scan(df.limit(0)).count() == 0


def test_any_set_at_the_threshold_has_an_anchor():
    rng = random.Random(7)
    for t in template_bigrams():
        n = len(t["pairs"])
        for _ in range(50):
            kept = rng.sample(t["pairs"], rng.randint(0, n))
            extra = rng.randint(0, n // 2)
            if 2 * len(kept) / (len(kept) + extra + n) >= 0.8:
                assert {*kept} & {*t["anchors"]}


def test_licences_inside_lines_comments_and_files(spark):
    mit = next(text for name, text in TEMPLATES if name == "MIT" and "NONINFRINGEMENT" in text)
    words = mit.split()
    hard = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
    texts = {
        1: "Copyright (c) 2021 Example Ltd. Released under the MIT License. All rights reserved.",
        2: "/*\n" + "\n *\n".join(f" * {x}" for x in hard) + "\n */\nint main() { return 0; }\n" * 40,
        3: "\r\n".join(hard) + "\r\n\r\nmore of the file\r\n" * 30,
        4: " ".join(f"w{i}" for i in range(5000)) + " " + mit + " " + " ".join(f"v{i}" for i in range(5000)),
        5: "the software is provided in boxes and the rights to use them are reserved",
        6: "Released under the MIT License. " * 3000,
    }
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert all("MIT" in got[i].licenses.split(",") for i in (1, 2, 3, 4, 6)) and got[5].licenses == ""
    assert got[2].best_dice == got[4].best_dice == 1.0


def test_words_and_anchors_of_a_text_are_found_once(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = license_scan(df)._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_intersect(") == 3  # anchors of the text, a segment with a template, a window with a template
    assert plan.count("[^A-Za-z0-9]+") == 2  # words of the text, of a segment
