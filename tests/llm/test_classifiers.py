from __future__ import annotations

import itertools

import numpy as np
import pyarrow.parquet as pq
import pytest

from llm_fixtures import make, odd_rows  # noqa: F401 - fixtures

from tallymark.llm import language, quality

DATA = "/root/testdata/sf0.01"


def brute_marginals(odds, transitions):
    """Sum over all labellings of one chain."""
    n = len(odds)
    weights = {}
    for y in itertools.product((0, 1), repeat=n):
        weights[y] = np.exp(sum(o * a for o, a in zip(odds, y)) + sum(transitions[a][b] for a, b in zip(y, y[1:])))
    total = sum(weights.values())
    single = [sum(w for y, w in weights.items() if y[t]) / total for t in range(n)]
    pairs = np.zeros((2, 2))
    for y, w in weights.items():
        for a, b in zip(y, y[1:]):
            pairs[a, b] += w / total
    return single, pairs


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    numbers = np.array([3, 1, 6, 2, 6])
    odds, transitions = rng.normal(size=18) * 2, rng.normal(size=(2, 2))
    marginal, pairs = quality.forward_backward(odds, numbers, transitions)
    at = 0
    for i, n in enumerate(numbers):
        single, both = brute_marginals(odds[at : at + n], transitions)
        assert np.allclose(marginal[at : at + n], single) and np.allclose(pairs[i], both)
        at += n


def test_features_see_the_lines_beside():
    features, length, numbers = quality.line_features(["ab\nCD!!\n", "", "x"])
    assert numbers.tolist() == [3, 1, 1] and length.tolist() == [2, 4, 0, 0, 1]
    own = quality._OWN
    assert np.allclose(features[1, own : 2 * own], features[0, :own]) and np.allclose(features[0, 2 * own : 3 * own], features[1, :own])
    assert not features[0, own : 2 * own].any() and not features[4, own : 3 * own].any()


def test_word_length_of_a_long_line():
    """Whatever the number of words, they have the length they have; a clean text on a single line is a good one."""
    short, long = (quality.line_features([" ".join(["letter"] * n)])[0][0, quality._KINDS + 5] for n in (50, 5000))
    assert np.isclose(short, 6 / 20) and np.isclose(long, 6 / 20)
    folder = "/root/testdata/sf0.001"
    texts = dict(zip(*(pq.read_table(f"{folder}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text")), strict=True))
    labels = pq.read_table(f"{folder}/labels.parquet").to_pylist()
    known = [(texts[r["doc_id"]], int(r["quality"] > 0)) for r in labels if texts.get(r["doc_id"]) and r["quality"] is not None]
    field = quality.train(*map(list, zip(*known, strict=True)))
    words = " ".join(t for t, y in known if y).split()
    clean = (words * (6000 // len(words) + 1))[:6000]
    assert min(field.scores([" ".join(clean[:3000]), " ".join(clean[3000:])])) >= 0.5


def test_classifiers_without_examples():
    field = quality.train([], [])
    assert field.scores(["a", None, ""]) == [0.5] * 3
    assert quality.train(["a", "b"], [1, 1]).scores(["x"]) == [1.0]
    model = language.train([])
    assert model.predict(["text", None]) == (["und", "und"], [0.0, 0.0])


def test_windows_cover_every_run_of_four_bytes():
    for size in (0, 1, 4, 252, 253, 256, 257, 1000):
        text = bytes(i % 251 + 1 for i in range(size))
        cut, own, numbers = language.windows([text, b"z"])
        assert numbers.sum() == len(cut) == len(own) and cut.shape[1] == 256
        runs = {bytes(w[i : i + 4]) for w in cut[: numbers[0]] for i in range(253)}
        assert {text[i : i + 4] for i in range(size - 3)} <= runs


def test_pooling_equals_plain_convolution():
    model = language.train([(b"the cat sat on the mat", "a"), (b"der hund und die katze", "b")] * 8, rounds=2)
    cut, _, _ = language.windows([b"the quick brown fox", bytes(range(1, 251)) * 3])
    x = model.embedding[np.lib.stride_tricks.sliding_window_view(cut, 4, axis=1)].reshape(len(cut), 253, -1)
    assert np.allclose(model.pooled(cut), np.maximum((x @ model.filters).max(axis=1) + model.bias, 0), atol=1e-4)


def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_quality_of_held_out_documents(spark, make, odd_rows):
    documents, labels = tables(spark)
    field = quality.fit(documents, labels.unionByName(labels.limit(5)))
    scored = quality.with_quality(documents.select("doc_id", "text"), field).where(quality.held_out()).join(labels, "doc_id").collect()
    right = [(r["quality_score"] >= 0.5) == (r["quality"] == 1) for r in scored]
    assert len(right) > 80 and np.mean(right) > 0.97
    odd = quality.with_quality(make(odd_rows), field)
    found = odd.collect()
    assert len(found) == len(odd_rows) and all(0 <= r["quality_score"] <= 1 for r in found)
    assert {r["quality_score"] for r in found if not (r["text"] or "").strip()} == {field.prior}
    assert odd.columns[:-1] == make(odd_rows).columns
    assert quality.with_quality(make([]), field).count() == 0
    none = quality.fit(make([]), labels)
    assert none.scores(["a"]) == [0.5]


def test_scores_do_not_depend_on_ids_or_batches(spark):
    documents, labels = tables(spark)
    field = quality.fit(documents, labels)
    texts = [r["text"] for r in documents.limit(40).collect()]
    together = field.scores(texts)
    assert np.allclose(together, [field.scores([t])[0] for t in texts], atol=1e-6)


def test_language_of_held_out_documents(spark, make, odd_rows):
    documents, _ = tables(spark)
    model = language.fit(documents)
    found = language.with_language(documents, model).where(language.held_out()).collect()
    assert len(found) > 200 and np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.97
    odd = language.with_language(make(odd_rows), model).collect()
    assert len(odd) == len(odd_rows)
    for r in odd:
        known = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in model.languages) == known and (r["lang_score"] > 0) == known
    assert language.fit(make([])).languages == []
    assert language.with_language(make([]), model).count() == 0


@pytest.mark.parametrize("module", [quality, language])
def test_labels_of_held_out_documents_are_never_read(spark, module):
    documents, labels = tables(spark)
    some = documents.where("doc_id < 300")
    if module is quality:
        changed = labels.where("doc_id < 300").selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) as quality", "toxic")
        a, b = quality.fit(some, labels.where("doc_id < 300")), quality.fit(some, changed)
        assert np.array_equal(a.weights, b.weights)
    else:
        changed = some.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 4 = 2, 'xx', lang) as lang", "source", "n_chars")
        a, b = language.fit(some), language.fit(changed)
        assert a.languages == b.languages and np.array_equal(a.filters, b.filters)


def test_number_signs_are_no_letters(make):
    model = language.fit(make([(i, "the cat and the dog" if i % 2 else "der Hund und die Katze", "s", "en" if i % 2 else "de") for i in range(80)]))
    names, scores = model.predict(["\u00bd \u2461 \u00b2", "\u2167 12", "_ 1", "\u00aa", None, ""])
    assert names[:3] == ["und"] * 3 and names[4:] == ["und"] * 2 and scores[0] == 0
    assert names[3] != "und"


def test_repeated_documents_are_learned_from_once(make, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    rows = [(i, "good clean line of words" if i % 2 else "xx xx xx!!!! ||| 99", "s", "en") for i in range(60)]
    again = [(i, "other text " + str(i), "s", "en") for i in range(60)]
    one, two = (quality.fit(make(some), labels).scores(["some clean line", "!!!"]) for some in (rows + again, again + rows[::-1]))
    assert one == two
