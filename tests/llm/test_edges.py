"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names in every operator."""

import pytest

from textforge.llm import byte_bpe, fingerprint, host_rules, jaccard_join, packing, pii, sharding, suffix_dedup, token_store, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, node long, gram string, label int, bytes long"
LONG = "The thing is that " * 4000
ROWS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu. " * 5), (2, None), (3, ""), (4, "  \n\t "), (5, LONG), (6, LONG), (6, LONG), (6, "other text under a repeated id"), (None, "a row without id"), (None, None), (7, "é" * 300), (8, "日本語 のテキスト " * 50)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, None, None if i == 3 else f"https://Host{(i or 0) % 2}.example/x", None, 1, "x", 2, "g", 3, None) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, 0, None), (None, None, 1)], "doc_id long, quality int, toxic int")


def run(name, df, spark, labels, tmp_path):
    if name == "token_store":
        folder = str(tmp_path / "tokens")
        return token_store.read_tokens(spark, folder, token_store.write_tokens(df, folder))
    return {
        "sharding": lambda: sharding.shard_documents(df), "fingerprint": lambda: fingerprint.fingerprint_documents(df), "suffix": lambda: suffix_dedup.remove_repeats(df),
        "packing": lambda: packing.pack_documents(df), "jaccard": lambda: jaccard_join.jaccard_components(df), "pii": lambda: pii.pseudonyms(df, b"key"),
        "bpe": lambda: byte_bpe.encode_documents(df), "toxicity": lambda: toxicity.score_documents(df, toxicity.fit(df, labels)), "hosts": lambda: host_rules.host_rules(df),
    }[name]()


NAMES = ("sharding", "fingerprint", "suffix", "packing", "token_store", "jaccard", "pii", "bpe", "toxicity", "hosts")


@pytest.mark.parametrize("name", NAMES)
def test_edge_rows(spark, edges, labels, tmp_path, name):
    rows = run(name, edges, spark, labels, tmp_path).collect()
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {i for i, _ in ROWS}
        assert sum(r["length"] for r in rows if r["doc_id"] in (2, 3, 4)) == 3  # just the end id
    else:
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, nothing, labels, tmp_path, name):
    assert run(name, nothing, spark, labels, tmp_path).count() == 0


def test_defined_results(spark, edges):
    by = {}
    for r in suffix_dedup.remove_repeats(edges).collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert by[2][0]["n_bytes"] == 0 and by[5][0]["n_removed"] == len(LONG) and by[5][0]["n_spans"] == 1 and by[8][0]["n_removed"] > 0
    found = {}
    for r in jaccard_join.jaccard_components(edges).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert found[2][0]["n_shingles"] == 0 and found[2][0]["component_id"] == 2 and found[4][0]["n_shingles"] == 0
    assert [r["component_id"] for r in found[6] if r["n_shingles"] == found[5][0]["n_shingles"]] == [5, 5]
    assert all(r["component_id"] is None for r in found[None])
