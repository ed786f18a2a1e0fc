"""The pipeline's stages that choose and cut rows, where a doc_id is null or repeated."""

import corpus_pipeline as cp
from tests.llm.test_edges import LONG, edges  # noqa: F401

NEAR = " ".join(f"word{i}" for i in range(100))
OTHER = " ".join(f"term{i}" for i in range(100))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


def test_one_row_of_each_group_stays(spark):
    rows = [(None, NEAR + " end"), (5, NEAR), (None, OTHER), (None, "quite another text"), (6, "first of six"), (6, "second of six"), (6, "second of six"), (7, None), (None, None)]
    got = texts(cp.drop_near_duplicates(spark, table(spark, rows), ""))
    assert got == sorted({(i, t) for i, t in rows} - {(5, NEAR)}, key=str)


def test_repeats_are_cut_from_rows_without_id(spark):
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(None, f"alpha {passage} omega"), (1, f"beta {passage} psi"), (None, "left alone"), (2, passage[:100]), (2, f"gamma {passage} chi"), (2, f"gamma {passage} chi")]
    got = texts(cp.cut_repeats(spark, table(spark, rows), ""))
    assert (None, "left alone") in got and (2, passage[:100]) in got
    assert all("shared30" not in t for _, t in got) and len([i for i, _ in got if i is None]) == 2


def test_stages_on_edges(spark, edges):  # noqa: F811
    near = cp.drop_near_duplicates(spark, edges, "")
    want = {(r["doc_id"], r["text"]) for r in edges.collect()} - {(6, LONG)}
    assert set(texts(near)) == want and near.count() == len(want)
    cut = cp.cut_repeats(spark, near, "")
    assert {i for i, _ in texts(cut)} == {None, 2, 3, 4, 6} and len([i for i, _ in texts(cut) if i is None]) == 2  # 1, 5, 7 and 8 repeat themselves
    assert {i for i, _ in texts(cp.pseudonymise(spark, cut, ""))} == {i for i, _ in texts(cut)}
