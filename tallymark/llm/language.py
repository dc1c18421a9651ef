"""Language identification by a byte convolutional network.

Texts are cut into windows of fixed length. Bytes are embedded; filters of several widths slide over a window, the largest
response of each filter is kept, and a softmax over these gives the languages. A document has the mean of its windows'
probabilities, weighted by their bytes: every byte of the text is read. Trained in numpy on a bounded sample of labelled documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import with_column_from_texts

SAMPLE_DOCUMENTS = 4_000
SAMPLE_BYTES = 40_000
"""Longer documents are predicted like others, but not trained on."""
WINDOWS_OF_DOCUMENT = 4
UNKNOWN = "und"

_LENGTH = 256  # bytes of a window
_EMBEDDED = 8
_WIDTHS = {2: 8, 3: 12, 4: 12}  # filters of each width
_WIDEST = max(_WIDTHS)
_STRIDE = _LENGTH - _WIDEST + 1  # each run of four bytes lies in one window
_FILTERS = sum(_WIDTHS.values())
_LETTER = regex.compile(r"\p{L}")


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (n, length), zeros behind the end of a text; how many bytes each has of its own; number of windows of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    numbers = np.maximum(1, -(-(sizes - _WIDEST + 1) // _STRIDE))
    out = np.zeros((int(numbers.sum()), _LENGTH), np.uint8)
    own = np.empty(len(out), np.int64)
    at = 0
    for text, n, size in zip(texts, numbers, sizes, strict=True):
        filled = np.zeros(int(n - 1) * _STRIDE + _LENGTH, np.uint8)
        filled[:size] = np.frombuffer(text, np.uint8)
        out[at : at + n] = np.lib.stride_tricks.sliding_window_view(filled, _LENGTH)[::_STRIDE]
        own[at : at + n] = np.clip(size - np.arange(n) * _STRIDE, 1, _STRIDE)
        at += n
    return out, own, numbers


@dataclass
class ByteNetwork:
    """Embedding (256, e), filters (widest * e, f) with zeros beyond a filter's width, bias, and the softmax layer."""

    languages: list[str]
    embedding: np.ndarray = field(default=None)
    filters: np.ndarray = field(default=None)
    bias: np.ndarray = field(default=None)
    out: np.ndarray = field(default=None)
    out_bias: np.ndarray = field(default=None)

    def pooled(self, cut: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each window.

        A row of four embedded bytes is contiguous in memory, so each of four offsets is one matrix product without copies.
        """
        x = self.embedding[cut].reshape(-1)
        best = np.full((len(cut), _FILTERS), -np.inf, np.float32)
        for offset in range(_WIDEST):
            whole = len(x) // (_WIDEST * _EMBEDDED) - (offset > 0)
            begin = offset * _EMBEDDED
            rows = x[begin : begin + whole * _WIDEST * _EMBEDDED].reshape(whole, -1) @ self.filters
            if offset:  # the last row of a window reaches into the next one
                rows = np.concatenate((rows, rows[:1]))
                responses = rows.reshape(len(cut), -1, _FILTERS)[:, :-1]
            else:
                responses = rows.reshape(len(cut), -1, _FILTERS)
            np.maximum(best, responses.max(axis=1), out=best)
        return np.maximum(best + self.bias, 0)

    def probabilities(self, cut: np.ndarray) -> np.ndarray:
        logits = self.pooled(cut) @ self.out + self.out_bias
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        """Language and its probability; ``und`` and 0 for a text that is null or has no letter."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t is not None and self.languages and _LETTER.search(t)]
        if known:
            cut, own, numbers = windows([texts[i].encode("utf-8", "surrogatepass") for i in known])
            p = np.concatenate([self.probabilities(cut[i : i + 512]) for i in range(0, len(cut), 512)])
            start = np.cumsum(numbers) - numbers
            mean = np.add.reduceat(p * own[:, None], start) / np.add.reduceat(own, start)[:, None]
            for i, best, row in zip(known, mean.argmax(axis=1), mean, strict=True):
                names[i], scores[i] = self.languages[best], float(min(1.0, row[best]))
        return names, scores


def train(examples: list[tuple[bytes, str]], rounds: int = 6, rate: float = 0.01, seed: int = 11) -> ByteNetwork:
    """Train on (window, language) with Adam in batches; languages weigh the same however many windows they have."""
    languages = sorted({language for _, language in examples})
    model = ByteNetwork(languages)
    if not languages:
        return model
    rng = np.random.Generator(np.random.PCG64(seed))
    cut = np.zeros((len(examples), _LENGTH), np.uint8)
    for i, (text, _) in enumerate(examples):
        cut[i, : min(len(text), _LENGTH)] = np.frombuffer(text[:_LENGTH], np.uint8)
    y = np.array([languages.index(language) for _, language in examples])
    weight = (len(y) / len(languages) / np.bincount(y, minlength=len(languages)))[y].astype(np.float32)
    mask = np.zeros((_WIDEST * _EMBEDDED, _FILTERS), np.float32)
    at = 0
    for width, n in _WIDTHS.items():
        mask[: width * _EMBEDDED, at : at + n] = 1
        at += n

    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    model.embedding = normal(256, _EMBEDDED, scale=0.5)
    model.filters = normal(_WIDEST * _EMBEDDED, _FILTERS, scale=0.3) * mask
    model.bias = np.zeros(_FILTERS, np.float32)
    model.out = normal(_FILTERS, len(languages), scale=0.2)
    model.out_bias = np.zeros(len(languages), np.float32)
    names = ["embedding", "filters", "bias", "out", "out_bias"]
    moments = {n: (np.zeros_like(getattr(model, n)), np.zeros_like(getattr(model, n))) for n in names}
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            b = cut[some]
            grams = np.lib.stride_tricks.sliding_window_view(b, _WIDEST, axis=1)
            x = model.embedding[grams].reshape(len(b), grams.shape[1], -1)
            responses = x @ model.filters
            place = responses.argmax(axis=1)
            best = np.take_along_axis(responses, place[:, None, :], axis=1)[:, 0] + model.bias
            hidden = np.maximum(best, 0)
            logits = hidden @ model.out + model.out_bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(b)), y[some]] -= 1
            p *= weight[some][:, None] / len(b)
            d_best = (p @ model.out.T) * (best > 0)
            row = np.arange(len(b))[:, None]
            chosen = x[row, place]  # (batch, filters, four embedded bytes): only the largest response learns
            d_chosen = d_best[:, :, None] * model.filters.T[None]
            d_embedding = np.zeros_like(model.embedding)
            np.add.at(d_embedding, grams[row, place].ravel(), d_chosen.reshape(-1, _EMBEDDED))
            gradients = {
                "embedding": d_embedding, "filters": np.einsum("bf,bfe->ef", d_best, chosen) * mask,
                "bias": d_best.sum(axis=0), "out": hidden.T @ p, "out_bias": p.sum(axis=0),
            }
            step += 1
            for n in names:
                m, v = moments[n]
                m += 0.1 * (gradients[n] - m)
                v += 0.001 * (gradients[n] ** 2 - v)
                change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                setattr(model, n, (getattr(model, n) - change).astype(np.float32))
    return model


def held_out(doc_id: str = "doc_id"):
    """Documents never learned from; false for a null id, which is not learned from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> ByteNetwork:
    """Train on at most ``sample`` documents with a language that are not held out: the first of each language by a hash of doc_id.

    Of each some windows are taken, evenly spread. The hash also thins out large languages before they are ranked, so that
    no task ranks more than a bounded number of ids.
    """
    usable = documents.where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
        & (F.octet_length("text") <= SAMPLE_BYTES) & ~held_out()
    ).select("doc_id", "lang", "text")
    ids = usable.select("doc_id", "lang")
    counts = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample)
    number = max(1, counts.count())
    each = max(1, sample // number)
    chance = F.least(F.lit(1.0), F.lit(2.0 * each + 50) / F.col("n"))
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    thinned = ids.join(F.broadcast(counts), "lang").where(order < chance * (1 << 30))
    ranked = thinned.withColumn("__rank", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id")))
    chosen = ranked.where(F.col("__rank") <= each).select("doc_id", "lang").distinct()
    rows = usable.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", "text").collect()
    examples = []
    for _, language, text in sorted((tuple(row) for row in rows)):
        raw = text.encode("utf-8", "surrogatepass")
        places = np.linspace(0, max(0, len(raw) - _LENGTH), min(WINDOWS_OF_DOCUMENT, 1 + len(raw) // _LENGTH)).astype(int)
        examples += [(raw[p : p + _LENGTH], language) for p in places]
    return train(examples)


def with_language(documents: DataFrame, model: ByteNetwork, name: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``documents`` with the predicted language of every whole text and its probability."""
    return with_column_from_texts(documents, model.predict, f"{name} string, {score} double")
