from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from llm_fixtures import make, odd_rows  # noqa: F401 - fixtures

from tallymark.llm import mixing, sharding


def documents(n=3000, seed=5):
    """A source with a third of all rows, sizes of three orders of magnitude, and groups of equal texts (one of them large)."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        size = int(np.exp(rng.normal(4, 1)))
        text = "shared text " * 30 if i % 20 == 0 else f"copy {i % 50} " * 5 if i % 9 == 0 else f"w{i} " * size
        rows.append((i, text, "big" if i % 3 == 0 else f"s{i % 11}", ["en", "de", None][i % 3]))
    return rows


def test_shards_have_equal_bytes_and_gapless_slots(make):
    rows = documents()
    found = sharding.kd_shards(make(rows), shards=16).collect()
    texts = {d: t for d, t, *_ in rows}
    assert sorted(r["doc_id"] for r in found) == list(range(len(rows)))
    weight, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in found:
        text = texts[r["doc_id"]]
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode())
        weight[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[text].add(r["shard"])
    assert sorted(weight) == list(range(16))
    mean = sum(weight.values()) / 16
    assert max(abs(w / mean - 1) for w in weight.values()) < 0.1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = defaultdict(int)
    for r in found:
        total[texts[r["doc_id"]]] += r["size"]
    assert all(len(h) == 1 for text, h in homes.items() if total[text] <= mean)


def test_heavy_groups_stay_whole_in_equal_shards(make):
    """Groups of a tenth to nearly a whole shard, beside texts that differ, and rows without ids."""
    rows = [(None if g == 0 else g * 1_000 + i, f"group {g} " * 20, f"s{g}", "en") for g in range(30) for i in range(8 + 3 * g)]
    rows += [(10**6 + i, f"own {i} " * (1 + i % 7), "big", "de") for i in range(6_000)]
    found = sharding.kd_shards(make(rows), shards=16).collect()
    weight, homes = defaultdict(int), defaultdict(set)
    for r in found:
        weight[r["shard"]] += r["size"]
        homes[r["text_crc32"]].add(r["shard"])
    assert len(found) == len(rows) and all(len(h) == 1 for h in homes.values())
    assert max(weight.values()) < 1.05 * min(weight.values())


def test_a_group_above_a_shard_is_split(make):
    rows = [(i, "the same text " * 4 if i % 2 else f"text {i:03} of its own " * 3, "s", "en") for i in range(1_600)]
    found = sharding.kd_shards(make(rows), shards=8)
    sizes = [r[1] for r in found.groupBy("shard").sum("size").collect()]
    assert len(sizes) == 8 and max(sizes) < 1.1 * min(sizes)


def test_sources_of_one_prefix_can_be_parted(make):
    """Two sources that differ in their last letter only are cut between them, as they are the widest dimension."""
    rows = [(i % 2, f"w{i:04} x", "common-crawl-" + "ab"[i % 2], "en") for i in range(400)]
    found = sharding.kd_shards(make(rows), shards=2).collect()
    assert {(r["doc_id"], r["shard"]) for r in found} in ({(0, 0), (1, 1)}, {(0, 1), (1, 0)})


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_any_number_of_shards(make, shards):
    found = sharding.kd_shards(make(documents(600)), shards=shards).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in found]
    assert len(sizes) == shards and max(sizes) < 1.25 * sum(sizes) / shards


def test_shards_by_target_bytes_and_odd_rows(make, odd_rows):
    found = sharding.kd_shards(make(documents(600)), target_bytes=20_000)
    sizes = [r[1] for r in found.groupBy("shard").sum("size").collect()]
    assert len(sizes) == -(-sum(sizes) // 20_000)
    odd = sharding.kd_shards(make(odd_rows), shards=16).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r["shard"] < 16 for r in odd)
    assert sum(r["size"] == 1 for r in odd) == 3
    assert sharding.kd_shards(make([]), shards=16).count() == 0


def targets(sizes: dict, weights=(5, 2, 1), limit=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(limit * sizes[s] for s in capped)
        open_weight = sum(weight[s] for s in sizes if s not in capped)
        target = {s: limit * sizes[s] if s in capped else rest * weight[s] / open_weight for s in sizes}
        above = {s for s in sizes if s not in capped and target[s] > limit * sizes[s]}
        if not above:
            return target
        capped |= above


def test_mix_meets_its_targets(make, monkeypatch):
    rows = [*documents(2500), (9001, "tiny", "t1", "en"), (9002, "tiny too", None, "en"), (9003, None, "zero", "en")]
    monkeypatch.setattr(mixing, "DOCUMENTS_IN_BLOCK", 40)
    monkeypatch.setattr(mixing, "RESIDUALS_IN_BLOCK", 4)
    found = mixing.mix(make(rows)).collect()
    again = mixing.mix(make(rows[::-1]).repartition(5)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in rows}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for d, _, s, _ in rows:
        sizes[s] += words[d]
        largest[s] = max(largest[s], words[d])
    expected = targets(dict(sizes))
    for r in found:
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(expected[r["source"]]) and 0 <= r["copies"] <= 3
        assert r["copies"] in (int(share := r["target"] / max(1, r["source_size"]) + 1e-9), int(share) + 1)
        taken[r["source"]] += r["taken"]
    assert len(found) == len(rows)
    assert all(abs(taken[s] - expected[s]) <= largest[s] for s in sizes)


def test_pivot_keeps_weighted_sum_and_expectation():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 100, 60).astype(float)
    start = np.full(60, 0.3)
    total = np.zeros(60)
    for _ in range(2000):
        p = start.copy()
        held = mixing.pivot(p, size, rng.random(60))
        assert abs((p * size).sum() - (start * size).sum()) < 1e-6
        assert all(x in (0, 1) for i, x in enumerate(p) if i != held)
        total += p
    assert np.abs(total / 2000 - 0.3).max() < 0.06


def test_mix_of_odd_rows(make, odd_rows):
    found = mixing.mix(make(odd_rows)).collect()
    assert len(found) == len(odd_rows) and all(r["taken"] == r["copies"] * r["size"] for r in found)
    copies = mixing.mixed(make(odd_rows))
    assert copies.columns == make(odd_rows).columns and copies.count() == sum(r["copies"] for r in found)
    assert mixing.mix(make([])).count() == 0
    assert mixing.mix(make([(1, None, "a", "en"), (2, " ", None, "en")])).selectExpr("sum(taken)").first()[0] == 0
