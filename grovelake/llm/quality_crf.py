"""Quality classifier: a linear-chain conditional random field labels every line of a document good or bad.

A line has features of its own (characters, words, repetition) and those of its neighbours; one weight per feature and four
transition weights between the labels of adjacent lines. Forward-backward gives the probability that a line is good, and
the document's quality is their mean weighted by the lines' lengths, put on the scale of the labels by a logistic curve.

Labels stand for documents, not for lines: training begins with each line labelled like its document, then labels
lines of bad documents that the model finds good as good (the worst line of a bad document stays bad) and trains again.
Training takes a bounded sample of labelled documents; scoring reads every whole text, in one pass without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, tidied

UPPER, LOWER, DIGIT = (bytes(range(ord(a), ord(b) + 1)) for a, b in ("AZ", "az", "09"))
MARKS = b"*$%#&!|<>{}[]\\^~@_=+`"
OWN = ("words", "mean_word", "distinct", "repeat", "upper", "marks", "digits", "bars", "other", "ends", "begins", "seen", "exclaims")
#: Those of a line's own features that it also takes from the lines before and after it.
AROUND = tuple(OWN.index(x) for x in ("words", "distinct", "repeat", "upper", "marks", "seen"))
WIDTH = len(OWN) + 2 * len(AROUND) + 3
#: Lines of a training segment; a longer document makes several.
SEGMENT = 64


def own_features(line: bytes, seen: bool) -> tuple[float, ...]:
    words = line.split()
    n, k = len(line), len(words)
    if not k:
        return (0.0,) * len(OWN)
    without = lambda table: (n - len(line.translate(None, table))) / n
    upper, lower, digits, marks = without(UPPER), without(LOWER), without(DIGIT), without(MARKS)
    return (
        math.log1p(k), min(sum(map(len, words)) / k, 40.0) / 10, len({*words}) / math.sqrt(k) if k > 16 else len({*words}) * 4 / k, sum(map(eq, words, words[1:])) / k, upper, marks, digits,
        line.count(b"|") / k, 1 - upper - lower - digits - marks, float(words[-1][-1:] in b".!?"), float(line[:1].isupper()), float(seen), line.count(b"!") / k,
    )


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x WIDTH) and lengths of the lines of a text; an empty text is one empty line."""
    lines = text.encode("utf-8", "replace").split(b"\n")
    known: set[bytes] = set()
    own = np.empty((len(lines), len(OWN)))
    for i, line in enumerate(lines):
        own[i] = own_features(line, line in known)
        known.add(line)
    made = np.zeros((len(lines), WIDTH))
    made[:, : len(OWN)] = own
    at = len(OWN)
    made[1:, at : at + len(AROUND)] = own[:-1, AROUND]
    made[:-1, at + len(AROUND) : at + 2 * len(AROUND)] = own[1:, AROUND]
    made[0, -3] = made[-1, -2] = 1.0
    made[:, -1] = 1.0
    return made, np.array([len(line) + 1.0 for line in lines])


def good_marginals(unary: np.ndarray, move: np.ndarray) -> np.ndarray:
    """P(good) of each line; unary: log-odds of good per line, move: 2 x 2 log weights between adjacent labels."""
    odds = np.clip(unary, -60, 60).tolist()
    (bb, bg), (gb, gg) = np.exp(move).tolist()
    ahead, g = [], math.exp(odds[0])
    b = 1.0
    ahead.append((b / (b + g), g / (b + g)))
    for u in odds[1:]:
        b, g = ahead[-1]
        b, g = b * bb + g * gb, (b * bg + g * gg) * math.exp(u)
        ahead.append((b / (b + g), g / (b + g)))
    out = [0.0] * len(odds)
    back_b = back_g = 1.0
    for i in range(len(odds) - 1, -1, -1):
        b, g = ahead[i]
        b, g = b * back_b, g * back_g
        out[i] = g / (b + g)
        e = math.exp(odds[i])
        back_b, back_g = bb * back_b + bg * e * back_g, gb * back_b + gg * e * back_g
        total = back_b + back_g
        back_b, back_g = back_b / total, back_g / total
    return np.array(out)


class Model:
    """weights of the standardised features, transition weights, and the logistic curve over the weighted mean."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, move: np.ndarray, curve: tuple[float, float] = (1.0, 0.0)):
        self.mean, self.scale, self.weights, self.move, self.curve = mean, scale, weights, move, curve

    def lines(self, features: np.ndarray) -> np.ndarray:
        return good_marginals(((features - self.mean) / self.scale) @ self.weights, self.move)

    def mean_good(self, features: np.ndarray, lengths: np.ndarray) -> float:
        return float(self.lines(features) @ lengths / lengths.sum())

    def score(self, text: str) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a * self.mean_good(*line_features(text)) + b))))


def _batch_marginals(unary: np.ndarray, mask: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) (segments x steps) and the expected number of each transition, for all segments together."""
    n, steps = unary.shape
    m = np.exp(move)
    e = np.stack([np.ones_like(unary), np.exp(np.clip(unary, -60, 60))], 2)
    ahead, behind = np.empty((n, steps, 2)), np.empty((n, steps, 2))
    ahead[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for t in range(1, steps):
        x = (ahead[:, t - 1] @ m) * e[:, t]
        ahead[:, t] = np.where(mask[:, t, None], x / x.sum(1, keepdims=True), ahead[:, t - 1])
    behind[:, -1] = 0.5
    for t in range(steps - 2, -1, -1):
        x = (e[:, t + 1] * behind[:, t + 1]) @ m.T
        behind[:, t] = np.where(mask[:, t + 1, None], x / x.sum(1, keepdims=True), 0.5)
    both = ahead * behind
    both /= both.sum(2, keepdims=True)
    pair = ahead[:, :-1, :, None] * m * (e[:, 1:] * behind[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return both[:, :, 1], (pair * mask[:, 1:, None, None]).sum((0, 1))


def train_chain(docs: list[tuple[np.ndarray, np.ndarray]], steps: int = 60, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions that fit docs (standardised features, label of each line) by maximum likelihood."""
    cut = [(x[i : i + SEGMENT], y[i : i + SEGMENT]) for x, y in docs for i in range(0, len(y), SEGMENT)]
    n, width = len(cut), cut[0][0].shape[1]
    longest = max(len(y) for _, y in cut)
    x, y, mask = np.zeros((n, longest, width)), np.zeros((n, longest)), np.zeros((n, longest), bool)
    for k, (a, b) in enumerate(cut):
        x[k, : len(b)], y[k, : len(b)], mask[k, : len(b)] = a, b, True
    label = y.astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[:, :-1][mask[:, 1:]], label[:, 1:][mask[:, 1:]]), 1)
    flat, total = x.reshape(-1, width), mask.sum()
    w, move = np.zeros(width), np.zeros((2, 2))
    first, second = np.zeros(width + 4), np.zeros(width + 4)
    for t in range(1, steps + 1):
        good, moved = _batch_marginals((flat @ w).reshape(n, longest), mask, move)
        grad = np.concatenate([flat.T @ (((good - y) * mask).ravel()) / total + ridge * w, ((moved - seen) / total + ridge * move).ravel()])
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        step = 0.15 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        w, move = w - step[:width], move - step[width:].reshape(2, 2)
    return w, move


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 2) -> Model:
    """A model of docs: (features, lengths, label)."""
    if len({label for _, _, label in docs}) < 2:
        always = 20.0 if docs and docs[0][2] else -20.0 if docs else 0.0
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), np.zeros((2, 2)), (0.0, always))
    every = np.concatenate([x for x, _, _ in docs])
    mean, scale = every.mean(0), every.std(0)
    mean[-1], scale[scale == 0] = 0.0, 1.0
    lines = [np.full(len(n), label) for _, n, label in docs]
    inputs = [(x - mean) / scale for x, _, _ in docs]
    for again in range(rounds):
        model = Model(mean, scale, *train_chain(list(zip(inputs, lines, strict=True))))
        if again + 1 < rounds:
            for k, (x, _, label) in enumerate(docs):
                if not label:
                    good = model.lines(x)
                    lines[k] = ((good > 0.5) & (good > good.min())).astype(int)
    means = np.array([model.mean_good(x, n) for x, n, _ in docs])
    truth = np.array([label for _, _, label in docs], float)
    a = b = 0.0
    for _ in range(50):  # Newton steps of a logistic regression on one input
        p = 1 / (1 + np.exp(-np.clip(a * means + b, -60, 60)))
        g = np.array([((p - truth) * means).mean() + 1e-3 * a, (p - truth).mean()])
        v = p * (1 - p) + 1e-6
        h = np.array([[(v * means**2).mean() + 1e-3, (v * means).mean()], [(v * means).mean(), v.mean()]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    model.curve = (float(a), float(b))
    return model


def spread_lines(n: int, most: int) -> np.ndarray:
    """The places of at most `most` of n lines: all, or whole segments at even distances."""
    if n <= most:
        return np.arange(n)
    starts = np.linspace(0, n - SEGMENT, max(1, most // SEGMENT)).astype(int)
    return np.unique(starts[:, None] + np.arange(SEGMENT))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 1000, lines: int = 256) -> Model:
    """A model fitted on at most per_class documents of each label, those first in the order of the md5 of the id.

    Give the labels to learn from only: those held out must not be among them, or they take places in the sample. Of a
    document with more than `lines` lines, that many are learnt from, in segments spread over it, so what comes to the driver
    (features of lines, no texts) is bounded: 2 * per_class * lines rows of some 30 numbers. Rows of labels without a 0 or
    1, or without a document, are passed over; an id with both labels counts as bad; a document that stands on several rows
    counts as often. Null texts count as empty. Without any labels, every score is a half; other columns are ignored.
    """
    one = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("_label"))
    order = F.md5(F.col(id_col).cast("string"))
    chosen = [one.where(F.col("_label") == k).orderBy(order, id_col).limit(per_class) for k in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1]).select(F.col(id_col).alias("_id"), "_label")
    given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            data: tuple[list, list] = ([], [])
            for text in batch.column(2).to_pylist():
                features, sizes = line_features(text or "")
                at = spread_lines(len(sizes), lines)
                data[0].append(features[at].astype("<f4").tobytes())
                data[1].append(sizes[at].astype("<f4").tobytes())
            data = [pa.array(x, pa.binary()) for x in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), *data], names=["_id", "_label", "x", "n"])

    rows = given.withColumn("_label", F.col("_label").cast("int")).mapInArrow(tidied(run), given.select("_id", F.col("_label").cast("int"), F.lit(b"").alias("x"), F.lit(b"").alias("n")).schema).collect()
    rows.sort(key=lambda r: (str(r[0]), r[2]))
    return fit([(np.frombuffer(r.x, "<f4").reshape(-1, WIDTH).astype(float), np.frombuffer(r.n, "<f4").astype(float), r._label) for r in rows])


def score(docs: DataFrame, model: Model, text_col: str = "text", to: str = "score") -> DataFrame:
    """docs without its text column, with the score (0 to 1) of each whole text; null counts as empty.

    Equal texts have equal scores. Texts of any length are read whole. Repeated rows stay; an empty table stays empty; a column
    named like `to` is replaced.
    """
    rest = [c for c in docs.columns if c not in (text_col, to)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, len(rest)):
            scores = [model.score(t or "") for t in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(scores, pa.float64())], names=[*rest, to])

    return docs.select(*rest, text_col).mapInArrow(tidied(run), docs.select(*rest, F.lit(0.0).alias(to)).schema)


def good_documents(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold; texts pass through once, without a shuffle.

    Null texts count as empty and have that score. Repeated rows share their fate; an empty table stays empty; a column named
    score stays as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([model.score(t or "") >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)


def held_out(id_column) -> F.Column:
    """Rows that no label is learnt from."""
    return F.crc32(F.encode(F.coalesce(id_column.cast("string"), F.lit("")), "utf-8")) % 5 == 0
