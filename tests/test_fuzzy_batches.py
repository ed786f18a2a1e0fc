"""The greedy pass over names in batches against a plain one."""

import random

import numpy as np
import pytest

from textforge.operators import blocks, dedup


def names_of(rng, n):
    words = ["supplier", "hot", "cold", "bolt", "bolts", "ring", "a", "b1", "small" * 15, "i", "j", "k", "l", "m", "n"]
    out = []
    for _ in range(n):
        number = f"0000{rng.randrange(400):03d}"
        out.append(" ".join(rng.choices([["supplier", number, *rng.sample(words[1:6], 2)], rng.sample(words, rng.randint(1, 12)), [number, "supplier", "ring"], []], [6, 2, 2, 0.2])[0]))
    return out


def plain(rows):
    kept, want = [], {}
    for i, name, place in rows:
        near = lambda q, own=place: not q or not own or q == own or dedup.token_set_ratio(q, own) >= 90
        want[i] = next((k for k, n, q in kept if name and near(q) and dedup.token_set_ratio(n, name) >= 92), i)
        if want[i] == i:
            kept.append((i, name, place))
    return want


@pytest.mark.parametrize("first, pairs, names", [(40, 1 << 21, 8192), (100, 0, 30)])
def test_batches_give_the_rows_of_a_plain_pass(spark, monkeypatch, first, pairs, names):
    for k, v in (("FIRST", first), ("PAIRS", pairs), ("NAMES", names), ("GROUP", 8), ("VERIFIED", 50)):
        monkeypatch.setattr(dedup, k, v, raising=False)
    rng = random.Random(first)
    rows = [(3 * i, n, rng.choice(["nation 1", "nation 11", "nation 2", ""])) for i, n in enumerate(names_of(rng, 500))]
    df = spark.createDataFrame([(i, "", n, p) for i, n, p in rows], "row_id long, company string, title string, location string")
    want = plain(rows)
    assert 20 < len(set(want.values())) < 400
    assert {r["row_id"]: r["group"] for r in dedup.fuzzy_groups(df).collect()} == want


def test_keys_that_are_not_kept_are_not_compared(spark, monkeypatch):
    """All pairs that match were made, of which only those with a kept key are asked for."""
    written, old = [], blocks.kept

    def kept(df, name):
        out = old(df, name)
        if "a" in out.columns and "b" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(blocks, "kept", kept)
    monkeypatch.setattr(dedup, "FIRST", 20, raising=False)
    df = spark.createDataFrame([(i, "supplier of many things", f"number {i}", "town") for i in range(400)], "row_id long, company string, title string, location string")
    groups = {r["row_id"]: r["group"] for r in dedup.fuzzy_groups(df).collect()}
    assert groups == plain([(i, f"supplier of many things number {i}", "town") for i in range(400)])
    assert sum(written) < 400 * 399 // 8


def test_longest_common_subsequences_of_many_pairs():
    rng = random.Random(4)
    left, right = (["".join(rng.choices("ab1 z", k=rng.choice((0, 1, 5, 30, 64)))) for _ in range(60)] for _ in range(2))
    i, j = (np.repeat(np.arange(60), 60), np.tile(np.arange(60), 60))
    got = dedup._common_letters(left, right, i, j)
    want = [round(dedup.indel_ratio(left[x], right[y]) * (len(left[x]) + len(right[y])) / 200) if left[x] or right[y] else 0 for x, y in zip(i, j, strict=True)]
    assert got.tolist() == want
