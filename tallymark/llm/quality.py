"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line speaks through its own features and those of the lines beside it, and neighbouring labels through
a transition table. Forward-backward gives the marginal of each line; their mean, weighted by length, is the raw score of the
document, which a logistic curve fitted on the training documents turns into a probability. Trained in numpy on a
bounded sample of labelled documents; the lines of a training document have its label.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_column_from_texts

SAMPLE_DOCUMENTS = 4_000
SAMPLE_LINES = 200
SAMPLE_BYTES = 40_000
"""Longer documents are scored like others, but not trained on."""

_KINDS = 8
_CLASS = np.full(256, 7, np.uint8)  # 7: other symbols
_CLASS[[*range(97, 123), *range(128, 256)]] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 4
_CLASS[ord("!")] = 5
_CLASS[ord("|")] = 6
_OWN = _KINDS + 7


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes, and the number of lines of each text; an empty text is one empty line."""
    lines, numbers, counts, word_level = [], [], [], []
    for text in texts:
        own = text.split("\n")
        seen = Counter(own)
        numbers.append(len(own))
        for line in own:
            words = line.split()
            n = len(words)
            counts.append(n)
            common = Counter(words).most_common(1)[0][1] if n > 3 else 1
            word_level.append(
                (len(set(words)) / n if n else 1.0, common / n if n > 3 else 0.0, min(n, 400) / 400, float(seen[line] > 1 and n > 0))
            )
        lines += own
    data = [line.encode("utf-8", "surrogatepass") for line in lines]
    length = np.array([len(d) for d in data], np.int64)
    kinds = _CLASS[np.frombuffer(b"".join(data), np.uint8)].astype(np.int64)
    owner = np.repeat(np.arange(len(data)), length)
    shares = np.bincount(owner * _KINDS + kinds, minlength=len(data) * _KINDS).reshape(-1, _KINDS) / np.maximum(1, length)[:, None]
    words = np.array(word_level, float).reshape(-1, 4)
    per_word = length * (1 - shares[:, 3]) / np.maximum(1, np.array(counts, np.int64))
    shape = np.column_stack([np.log1p(length) / 10, np.minimum(per_word, 40) / 20, (length == 0).astype(float)])
    own = np.column_stack([shares, words, shape])
    first = np.concatenate(([0], np.cumsum(numbers)[:-1])).astype(np.int64)
    last = np.cumsum(numbers) - 1
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    edge = np.zeros((len(own), 3))
    edge[first, 0], edge[last, 1], edge[:, 2] = 1, 1, 1
    return np.column_stack([own, before, after, edge]), length, np.array(numbers, np.int64)


def forward_backward(unary: np.ndarray, numbers: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal of the label 1 of every line, and the expected label pairs of each chain (chains, 2, 2).

    ``unary`` is the log-odds of label 1 of each line before transitions. Chains advance together, longest first.
    """
    order = np.argsort(-numbers, kind="stable")
    start = (np.cumsum(numbers) - numbers)[order]
    sizes = numbers[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest)]
    weight = np.exp(transitions - transitions.max())
    odds = np.clip(unary, -30, 30)
    local = np.stack([1 / (1 + np.exp(odds)), 1 / (1 + np.exp(-odds))], axis=1)
    forward = np.empty_like(local)
    carried = np.ones((len(sizes), 2)) / 2
    for t in range(longest):
        m = active[t]
        at = start[:m] + t
        carried = (carried[:m] @ weight if t else carried[:m]) * local[at]
        carried /= carried.sum(axis=1, keepdims=True)
        forward[at] = carried
    marginal = np.empty(len(local))
    pairs = np.zeros((len(sizes), 2, 2))
    back = np.ones((len(sizes), 2))
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = start[:m] + t
        both = forward[at] * back[:m]
        marginal[at] = both[:, 1] / both.sum(axis=1)
        if t:
            message = local[at] * back[:m]
            joint = forward[at - 1][:, :, None] * weight * message[:, None, :]
            pairs[:m] += joint / joint.sum(axis=(1, 2), keepdims=True)
            back[:m] = message @ weight.T
            back[:m] /= back[:m].sum(axis=1, keepdims=True)
    restored = np.empty_like(pairs)
    restored[order] = pairs
    return marginal, restored


@dataclass
class LineField:
    """A trained field: feature scaling, weights, transition table, and the curve from raw score to probability."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray
    curve: tuple[float, float]
    prior: float

    def marginals(self, features: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return forward_backward((features - self.mean) / self.scale @ self.weights, numbers, self.transitions)

    def raw(self, features: np.ndarray, length: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Logit of the mean marginal of each document, lines weighted by length."""
        marginal, _ = self.marginals(features, numbers)
        owner = np.repeat(np.arange(len(numbers)), numbers)
        total = np.bincount(owner, length, len(numbers))
        mean = np.bincount(owner, length * marginal, len(numbers)) / np.maximum(1, total)
        mean = np.clip(mean, 1e-4, 1 - 1e-4)
        return np.log(mean / (1 - mean))

    def scores(self, texts: list) -> list[float]:
        """Probability that a text is good; one without any character but white space, or null, has the share of good training documents."""
        whole = ["" if t is None else t for t in texts]
        if not len(self.weights):
            return [self.prior] * len(whole)
        raw = self.raw(*line_features(whole))
        found = 1 / (1 + np.exp(-(self.curve[0] * raw + self.curve[1])))
        blank = np.array([not t or t.isspace() for t in whole])
        return np.where(blank, self.prior, found).tolist()


def train(texts: list[str], labels: list[int], rounds: int = 120, rate: float = 0.08, decay: float = 1e-4) -> LineField:
    """Maximise the conditional likelihood of the line labels, each document weighing the same (Adam on whole batches).

    Without documents of both labels the field gives the share of label 1 (one half without any) to every text.
    """
    y_document = np.array(labels, float)
    prior = float(y_document.mean()) if len(labels) else 0.5
    if len(set(labels)) < 2:
        return LineField(np.zeros(0), np.ones(0), np.zeros(0), np.zeros((2, 2)), (1.0, 0.0), prior)
    features, length, numbers = line_features(texts)
    mean, scale = features.mean(axis=0), features.std(axis=0)
    fixed = scale < 1e-9
    mean[fixed], scale[fixed] = 0, 1
    x = (features - mean) / scale
    y = np.repeat(y_document, numbers)
    share = np.repeat(1 / numbers, numbers) / len(numbers)
    chain_share = 1 / np.maximum(1, numbers) / len(numbers)
    steps = (numbers - 1) * chain_share
    observed = np.array([[(steps * (1 - y_document)).sum(), 0.0], [0.0, (steps * y_document).sum()]])
    theta = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        marginal, pairs = forward_backward(x @ theta[:-4], numbers, theta[-4:].reshape(2, 2))
        gradient = np.concatenate(
            [x.T @ ((y - marginal) * share), (observed - (pairs * chain_share[:, None, None]).sum(axis=0)).ravel()]
        ) - decay * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta += rate * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.999**i)) + 1e-8)
    field = LineField(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), (1.0, 0.0), prior)
    raw = field.raw(features, length, numbers)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic curve with two parameters, slightly held back
        p = 1 / (1 + np.exp(-(a * raw + b)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((y_document - p) * raw).sum() - 0.1 * (a - 1), (y_document - p).sum()])
        h = np.array([[(w * raw * raw).sum() + 0.1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
        change = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + change[0], b + change[1]
    field.curve = (float(max(a, 1e-3)), float(b))
    return field


def held_out(doc_id: str = "doc_id"):
    """Documents whose labels are never learned from; false for a null id, which has no label either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> LineField:
    """Train on at most ``sample`` labelled documents that are not held out, chosen by a hash of doc_id.

    Null labels and ids are left out; a doc_id that is labelled or stored more than once counts once, by its smallest label and text. Texts of
    ``SAMPLE_LINES`` lines or more than ``SAMPLE_BYTES`` bytes are not learned from, so that the sample is bounded.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    whole = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(
        (F.octet_length("text") <= SAMPLE_BYTES)
        & (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) < SAMPLE_LINES)
    )
    chosen = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    once = whole.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    rows = sorted(once.collect(), key=lambda row: row["doc_id"])
    return train([row["text"] for row in rows], [int(row["quality"] > 0) for row in rows])


def with_quality(documents: DataFrame, field: LineField, name: str = "quality_score") -> DataFrame:
    """``documents`` with the probability that a document is good, for every row and whole text."""
    return with_column_from_texts(documents, lambda texts: [field.scores(texts)], f"{name} double")
