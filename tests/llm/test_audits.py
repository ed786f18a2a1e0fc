"""Hard negatives, the filter audit and line dedup against brute force, with nulls, ties, repeats, long texts and empty tables; long secrets."""

import hashlib
import random
import string
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textforge.llm import filter_audit, hard_negatives, line_dedup, pii, registry

# 11


def mined(rows, is_anchor, positives=5, negatives=3):
    """rows: (id, vector, label) with finite vectors."""
    low = lambda i: -(2**63) if i is None else i
    q = [(low(i), np.floor(256 * np.array(v, float)), y) for i, v, y in rows]
    out, seen = [], set()
    for (i, v, y), asks in zip(q, map(is_anchor, rows), strict=True):
        if not asks or (i, tuple(v), y) in seen:
            continue
        seen.add((i, tuple(v), y))
        width = lambda a, b: float(np.dot(np.pad(a, (0, max(0, len(b) - len(a)))), np.pad(b, (0, max(0, len(a) - len(b))))))
        best = sorted((-int(width(v, w)), j) for j, w, z in q if z == y and j != i)[:positives]
        others = sorted((-int(width(v, w)), j) for j, w, z in q if z != y)
        for p, j in best:
            hits = [(-s, k) for s, k in others if 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out += [(i, j, r + 1, k, -p, s) for r, (s, k) in enumerate(hits)]
    return Counter(out)


def got(df, is_anchor, **sizes):
    rows = hard_negatives.hard_negatives(df, is_anchor, **sizes).collect()
    low = lambda i: -(2**63) if i is None else i
    return Counter((low(r["anchor_id"]), low(r["positive_id"]), r["rank"], low(r["negative_id"]), r["positive_score"], r["negative_score"]) for r in rows)


SCHEMA = "vec_id long, embedding array<float>, label int, key long, score long, block int"


def test_hard_negatives(spark, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 200)
    centers = rng.normal(size=(6, 8))
    vectors = [(centers[i % 6] + rng.normal(size=8) * 0.5).astype(np.float32).tolist() for i in range(900)]
    vectors[100:260] = [vectors[100]] * 160  # one very common vector: ties
    rows = [(i, v, int(rng.integers(0, 4))) for i, v in enumerate(vectors)]
    rows += [rows[3], rows[3], rows[50], (None, vectors[7], 1), (None, vectors[8], 2), (901, vectors[9][:3], 1), (902, [], 0)]
    odd = [(903, None, 1), (904, vectors[1], None), (905, [1.0, None], 1), (906, [float("nan")] * 8, 1), (907, [float("inf")] * 8, 1)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows + odd], SCHEMA)
    want = mined(rows, lambda r: r[0] is not None and r[0] % 25 == 0)
    assert got(df, F.col("vec_id") % 25 == 0) == want and len(want) > 100
    assert got(df, F.col("vec_id") % 25 == 0, positives=2, negatives=1) == mined(rows, lambda r: r[0] is not None and r[0] % 25 == 0, 2, 1)
    assert hard_negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 25 == 0).count() == 0


def test_tree_prunes_and_keeps_exact_numbers():
    rng = np.random.default_rng(1)
    rows = rng.integers(-400, 400, (3000, 4)).astype(float)
    tree = hard_negatives.Tree(rows, np.arange(3000), np.zeros(3000, int))
    q = rng.integers(-400, 400, (40, 4)).astype(float)
    scores, ids = tree.search(q, np.full(40, -(2**62)), np.full(40, 60_000), np.ones(40, int), np.full(40, -1), False, 4)
    exact = q @ rows.T
    for s, i, e in zip(scores, ids, exact, strict=True):
        want = sorted((-int(x), k) for k, x in enumerate(e) if x <= 60_000)[:4]
        assert list(zip(s, i)) == [(-x, k) for x, k in want]
    big = hard_negatives.Tree(np.full((1, 2), 2.0**29), np.array([1]), np.array([0]))
    assert big.search(np.full((1, 2), 2.0**29), np.array([0]), np.array([2**62]), np.array([1]), np.array([5]), False, 1)[0][0, 0] == 2**59
    with pytest.raises(ValueError):
        big.search(np.full((1, 2), 2.0**40), np.array([0]), np.array([1]), np.array([1]), np.array([5]), False, 1)


# 12


def test_filter_audit(spark):
    words = " ".join(f"w{i}" for i in range(210))
    texts = [words, words, words.upper(), "same " * 250, words + " $", "short", None, "", "  \n\t ", "é" * 300, words + " A" * 3, "x " * 40_000 + words]
    docs = [(i, t, ("a", None, "")[i % 3]) for i, t in enumerate(texts)] + [(0, words, "a"), (1, words, None), (None, words, "b"), (None, None, "b"), (20, "é" * 300, "a")]
    labels = [(0, 1, 0), (0, None, 1), (1, 0, 1), (4, 1, 1), (None, 1, 1), (99, 1, 1)]
    df = spark.createDataFrame([(*d, True, True, 5) for d in docs], "doc_id long, text string, source string, A boolean, part boolean, digest int")
    flags = filter_audit.labelled(filter_audit.failure_flags(df), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.audit(flags, filter_audit.FILTERS, ("good", "toxic")).collect()}
    low = lambda i: -(2**63) if i is None else i
    first = {}
    for i, t, _ in docs:
        first[t or ""] = min(first.get(t or "", low(i)), low(i))
    rows = []
    for i, t, s in docs:
        t = t or ""
        ws = t.split()
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * sum(c in string.ascii_uppercase for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": low(i) > first[t]}
        rows.append((s or "", fails, any(d == i and q == 1 for d, q, _ in labels if i is not None), any(d == i and x == 1 for d, _, x in labels if i is not None)))
    parts = {p for p, *_ in rows}
    orders = ["".join(o) for o in permutations("ABCDE")]
    assert set(out) == {(p, o, k) for p in parts for o in orders for k in range(1, 6)} and parts == {"a", "", "b"}
    shap = Counter()
    for p in parts:
        for o in orders:
            left = [r for r in rows if r[0] == p]
            for k, f in enumerate(o, 1):
                gone = [r for r in left if r[1][f]]
                stay = [r for r in left if not r[1][f]]
                r = out[p, o, k]
                failing = [x for x in rows if x[0] == p and x[1][f]]
                assert (r["kept"], r["removed"], r["redundant"], r["lost_good"], r["lost_toxic"]) == (len(stay), len(gone), len(failing) - len(gone), sum(x[2] for x in gone), sum(x[3] for x in gone))
                assert r["unique_fails"] == sum(sum(x[1].values()) == 1 for x in failing)
                shap[p, f] += len(gone)
                left = stay
    assert all(r["shapley"] == shap[p, o[k - 1]] for (p, o, k), r in out.items())
    nothing = spark.createDataFrame([], df.schema)
    assert filter_audit.audit(filter_audit.failure_flags(nothing).withColumn("m", F.lit(True)), filter_audit.FILTERS, ("m",)).count() == 0


# 13


def shared(docs, least=40, many=5):
    low = lambda i: -(2**63) if i is None else i
    key = lambda line: line.strip(" \t\n\v\f\r").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    held = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(low(i))
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and len(held[key(x)]) >= many and max(held[key(x)]) != low(i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def documents(seed):
    rng = random.Random(seed)
    pool = [f"a line that is shared by several documents, number {i} of them é" for i in range(30)] + ["x" * 39, "x" * 40, "é" * 39, "é" * 41, "short", "", " \t"]
    docs = []
    for i in range(120):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 12))] + [f"own {i} " * 8]
        if i % 3:
            lines.append("  A VERY common LINE that a third of all documents or more will have \t")
        rng.shuffle(lines)
        docs.append((i, "\n".join(x.upper() if rng.random() < 0.2 else x for x in lines)))
    docs += [docs[5], docs[5], (5, "another text\n" + pool[0]), (None, pool[1] + "\n" + pool[2]), (None, None), (500, ""), (501, "\n"), (502, None), (503, (pool[3] + "\n") * 20_000), (504, "z" * 200_000)]
    return docs


@pytest.mark.parametrize("chunk, pending", [(1 << 16, 1 << 20), (7, 3)])
def test_line_dedup(spark, monkeypatch, chunk, pending):
    docs = documents(chunk)
    df = spark.createDataFrame([(*d, 1, "k", 9) for d in docs], "doc_id long, text string, place int, keep string, id long")
    monkeypatch.setattr(line_dedup, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(line_dedup, "PENDING_ROWS", pending)
    maps = line_dedup.keep_bitmaps(df)
    rows = line_dedup.kept_texts(df, maps).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in rows) == shared(docs)
    assert sum(r["n_dropped"] for r in rows) > 200
    assert sum(len(r["keep"]) for r in maps.collect()) < 20_000
    few = line_dedup.kept_texts(df, line_dedup.keep_bitmaps(df, 3, 2)).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in few) == shared(docs, 3, 2)
    nothing = spark.createDataFrame([], df.schema)
    assert line_dedup.keep_bitmaps(nothing).count() == 0 and line_dedup.kept_texts(nothing, line_dedup.keep_bitmaps(nothing)).count() == 0


def test_streams_agree_however_rows_are_dealt():
    """The streamed first occurrences of sorted rows, cut into tasks at any place."""
    import pyarrow as pa

    rng = random.Random(4)
    rows = sorted({(rng.randint(0, 12), 0, -rng.randint(0, 9), 1, rng.randint(0, 4)) for _ in range(400)})
    rows = np.array([(a, b, -c, d, e) for a, b, c, d, e in rows], np.int64)
    want = {tuple(r) for r in rows.tolist() if len({x[2] for x in rows.tolist() if x[0] == r[0]}) >= 5 and r[2] != max(x[2] for x in rows.tolist() if x[0] == r[0])}
    for cuts in ([], [100], [1, 2, 3], sorted(rng.sample(range(1, len(rows)), 40))):
        found, sums = [], {}
        for low, high in zip([0, *cuts], [*cuts, len(rows)]):
            batch = pa.RecordBatch.from_arrays([pa.array(rows[low:high, k], pa.int32() if k == 4 else pa.int64()) for k in range(5)], names=["h1", "h2", "id", "mark", "place"])
            for out in line_dedup._streamed(5)([batch]):
                found += [tuple(r.values()) for r in out.to_pylist()]
        gone = {r[:5] for r in found if r[5] == 0}
        for h1, _, first, last, _, n in (r for r in found if r[5] > 0):
            sums.setdefault(h1, []).append((-first, -last, n))
        for h1, parts in sums.items():
            parts.sort()
            docs = sum(n for *_, n in parts) - sum(a[1] == b[0] for a, b in zip(parts, parts[1:]))
            if docs >= 5:
                gone |= {r[:5] for r in found if r[5] == -1 and r[0] == h1 and r[2] != -parts[0][0]}
        assert gone == want


# SQL on the smallest tables


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_filter_audit", "op13_line_dedup"])
def test_same_rows_as_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rows, want = registry.QUERIES[name](spark, sf), duck.sql(registry.ORACLE_SQL[name])
    columns = sorted(rows.columns)
    assert sorted(want.columns) == columns
    assert sorted(map(tuple, rows.select(columns).collect())) == sorted(want.project(", ".join(columns)).fetchall())


# 7


@pytest.mark.parametrize("n", [6, 40, 200, 201, 240, 400, 800, 2000, 10_000])
@pytest.mark.parametrize("letters, chance", [(string.ascii_lowercase, 1 / 26), ("0123456789abcdef", 1 / 16)])
def test_long_secrets_leave_nothing_in_clear(n, letters, chance):
    rng = random.Random(n)
    values = ["".join(rng.choice(letters) for _ in range(n)) for _ in range(max(1, 2000 // n))]
    new = [pii.pseudonymise(f"token={v}")[0][6:] for v in values]
    assert all(len(a) == len(b) for a, b in zip(values, new)) and new == [pii.pseudonymise(f"say token={v}")[0][10:] for v in values]
    same = sum(x == y for a, b in zip(values, new) for x, y in zip(a, b)) / (n * len(values))
    assert same < 2 * chance + 0.01
    k = 10 ** (n // 2)
    assert pii.inverse(pii.permute(12345 % k, k, b"k", b"t"), k, b"k", b"t") == 12345 % k


def test_whole_tokens_and_addresses():
    told, found = pii.pseudonymise("token=eyJhbGciOi.eyJzdWIiOiIx.SflKxwRJSM rest. jörg@example.de")
    assert [k for k, _, _ in found] == ["secret", "email"] and "SflKxwRJSM" not in told and "eyJzdWIiOiIx" not in told and "rg@" not in told and told.endswith(".de")
    assert hashlib.sha256(pii.pseudonymise("secret=" + "aB3+" * 100_000)[0].encode()).digest()
