"""The Jaccard join's cells in memory and across shuffles against all pairs, and what becomes of stock phrases."""

import random

import numpy as np
import pytest

from tests.llm.test_operators import brute_components, shingles
from textforge.llm import jaccard_join


def families(rng, sizes, length, edits, vocabulary=400):
    """Near copies of some texts, each some edits from its base or from the copy before it."""
    out = []
    for size in sizes:
        text = [f"w{rng.randrange(vocabulary)}" for _ in range(length)]
        base, chain = text, rng.random() < 0.5
        for _ in range(size):
            own = list(text if chain else base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(length)] = f"w{rng.randrange(vocabulary)}"
            out.append(" ".join(own))
            text = own
    rng.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize("seed, percent", [(1, 85), (2, 80), (3, 60), (4, 50)])
def test_link_region(seed, percent):
    rng = random.Random(seed)
    data = families(rng, [60, 50, 30, 20, 1, 1, 1], 60, 3 if percent > 70 else 8)
    sets = {i: shingles(t, 2) for i, t in data.items()}
    number = {s: k for k, s in enumerate(sorted(set().union(*sets.values())))}
    found = jaccard_join.link_region([np.array(sorted(number[s] for s in sets[i]), dtype=np.uint64) for i in sorted(sets)], percent)
    assert dict(enumerate(found)) == brute_components(sets, percent)


@pytest.mark.parametrize("seed, words, percent, edits", [(1, 4, 85, 2), (2, 2, 70, 8)])
def test_regions_are_split_across_shuffles(spark, monkeypatch, seed, words, percent, edits):
    rng = random.Random(seed)
    data = families(rng, [90, 60, 40, 5], 80, edits)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 6)
    calls = []
    split = jaccard_join._split
    monkeypatch.setattr(jaccard_join, "_split", lambda *a: calls.append(1) or split(*a))
    got = jaccard_join.jaccard_components(spark.createDataFrame(list(data.items()), "doc_id long, text string"), words, percent, most=12)
    sets = {i: shingles(t, words) for i, t in data.items()}
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == brute_components(sets, percent)
    assert calls


def test_blocks_hold_every_pair(spark):
    rows = spark.range(40).selectExpr("7L as region", "id as node", "40L as points", "400L as weight")
    blocks = {}
    for r in jaccard_join._blocks(rows, 10, 10**6).collect():
        blocks.setdefault(r["region"], set()).add(r["node"])
    assert all(any({a, b} <= x for x in blocks.values()) for a in range(40) for b in range(a))
    assert max(map(len, blocks.values())) < 30


def test_stock_phrases_make_no_region(spark):
    """Unrelated texts that share many phrases: their own words come first in the order, so nothing is left to compare."""
    rng = random.Random(5)
    stock = [" ".join(f"s{k}x{j}" for j in range(6)) for k in range(60)]
    data = [(i, " ".join(rng.sample(stock, 12)) + " " + " ".join(f"u{i}x{j}" for j in range(40))) for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    sets = {i: shingles(t, 4) for i, t in data}
    held = spark.createDataFrame([(i, [hash(s) for s in sets[i]]) for i in sets], "node long, shingles array<long>")
    assert jaccard_join.regions(held, 85, len(sets)).count() == 0
    got = jaccard_join.jaccard_components(df)
    assert all(r["component_id"] == r["doc_id"] for r in got.collect())


def test_a_cell_with_one_point_at_home_ends():
    """A pivot alone in its cell, with many copies of others in its window and one point near it that it is not linked with."""
    rng, new = random.Random(1), iter(range(10**6, 10**7))
    fresh = lambda n: [next(new) for _ in range(n)]
    near = lambda s: [*rng.sample(s, len(s) - 10), *fresh(12)]
    other = list(range(100))
    alone = [*other[:80], *fresh(20)]
    rows = {0: alone, 5: other, 10: near(alone)} | {i: near(other) for i in range(2, 60) if i % 5}
    sets = [rows.get(i) or fresh(100) for i in range(jaccard_join.MOST)]
    found = jaccard_join.link_region([np.array(sorted(s), dtype=np.uint64) for s in sets], 85)
    assert dict(enumerate(found)) == brute_components(dict(enumerate(map(frozenset, sets))), 85)
