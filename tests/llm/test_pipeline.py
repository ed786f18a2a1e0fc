"""The pipeline's stages against brute force on the smallest tables."""

import re

import corpus_pipeline as cp
from textforge.llm import common, pii, suffix_dedup, toxicity


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, sf):
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "jaccard_join", "suffix_dedup", "pii", "packing"]
    docs = common.documents(spark, sf)
    columns = docs.columns
    before = rows(docs)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    d1 = common.saved(cp.drop_toxic(spark, docs, sf), "t1")
    clean = {i for i, r in before.items() if model.score(r["text"].encode()) < 0.7}
    assert d1.columns == columns and set(rows(d1)) == clean
    d2 = common.saved(cp.drop_near_duplicates(spark, d1, sf), "t2")
    sets = {i: shingles(before[i]["text"]) for i in clean}
    least = {i: i for i in clean}
    for _ in range(len(clean)):
        new = {i: min([least[i], *(least[j] for j in clean if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))]) for i in clean}
        if new == least:
            break
        least = new
    kept = {i for i in clean if least[i] == i}
    assert d2.columns == columns and set(rows(d2)) == kept
    d3 = common.saved(cp.cut_repeats(spark, d2, sf), "t3")
    cut = {r["doc_id"]: r["kept"].decode("utf-8", "ignore") for r in suffix_dedup.remove_repeats(d2).collect()}
    want = {i: cut[i] if cut[i].encode() != before[i]["text"].encode() else before[i]["text"] for i in kept}
    want = {i: t for i, t in want.items() if t.strip(" ") or t == before[i]["text"]}
    assert {i: r["text"] for i, r in rows(d3).items()} == want and all(r["n_chars"] == len(r["text"]) for r in rows(d3).values())
    d4 = common.saved(cp.pseudonymise(spark, d3, sf), "t4")
    assert d4.columns == columns and {i: r["text"] for i, r in rows(d4).items()} == {i: pii.pseudonymise(t)[0] for i, t in want.items()}
    assert {r["doc_id"] for r in cp.pack(spark, d4, sf).collect()} == set(want)


def test_run_has_the_last_stages_rows(spark, sf):
    assert cp.run(spark, sf).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
