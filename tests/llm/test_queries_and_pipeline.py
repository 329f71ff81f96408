"""Registered corpus queries against their SQL twins, and the pipeline stage by stage."""

import os
import random
from collections import Counter

import pytest
from compare_sql import difference, duck
from test_small_ops import brute_classes, brute_targets, words_of

import corpus_pipeline
from skirmish.llm import decontaminate, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not there")
@pytest.mark.parametrize("name", list(queries.queries()))
def test_query_runs_and_matches_its_twin(spark, name):
    if name in queries.sql_twins():
        assert difference(spark, duck(SF), name, SF) is None
    else:
        assert queries.queries()[name](spark, SF).count() > 0


def tables(spark, folder):
    """A small corpus with toxic documents, copies, leaks and two sources."""
    rng = random.Random(3)
    plain, bad = [f"word{i}" for i in range(400)], ["scoundrelish", "vermincake", "slimeface"]
    items = [" ".join(rng.choice(plain) + "q" for _ in range(20)) for _ in range(4)]
    rows, labels = [], []
    for i in range(500):
        w = [rng.choice(plain) for _ in range(60)]
        if i % 7 == 0:
            w[::12] = [rng.choice(bad) for _ in w[::12]]
        text = " ".join(w)
        if i % 11 == 0 and i:
            text = rows[i - 1][1] if i % 2 else rows[i - 1][1] + " more"
        if i % 13 == 0:
            text += " " + items[i % 4]
        rows.append((i, text, "en", rng.choice(["a", "b"]), len(text)))
        labels.append((i, 1, int(any(b in text for b in bad))))
    rows += [(600, None, None, None, None), (601, "", "en", "a", 0)]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data, schema in (
        ("documents", rows, cols),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", list(enumerate(items)), "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return rows, items


def test_pipeline_stage_by_stage(spark, tmp_path):
    sf = str(tmp_path / "sf")
    rows, items = tables(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after[name] = docs.collect()
    before = {r[0]: r[1] for r in rows}
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rejected = toxicity.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), model).where("predicted = 1")
    gone = {r.doc_id for r in rejected.collect()}
    bad = {i for i, t in before.items() if t and "slimeface" in t}
    assert len(bad & gone) > 0.9 * len(bad)
    assert {r.doc_id for r in after["toxicity"]} == set(before) - gone
    left = [(r.doc_id, r.text) for r in after["toxicity"]]
    heads = {c for _, c in brute_classes(left)}
    assert {r.doc_id for r in after["near_duplicates"]} == heads
    clean = {r.doc_id for r in after["near_duplicates"] if not any(x in (r.text or "") for x in items)}
    assert {r.doc_id for r in after["decontamination"]} == clean
    goal, size = brute_targets([(r.doc_id, r.text, r.source) for r in after["decontamination"]])
    taken, copies = Counter(), Counter()
    for r in after["mixing"]:
        taken[r.source] += len(words_of(r.text))
        copies[r.doc_id] += 1
    largest = max(len(words_of(r.text)) for r in after["decontamination"])
    assert all(abs(taken[s] - goal[s]) <= largest for s in goal) and max(copies.values()) <= 3
    assert Counter(r.doc_id for r in after["sharding"]) == copies
    assert len(decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").collect()) == 0


def test_run_gives_the_last_stage(spark, tmp_path):
    sf = str(tmp_path / "sf")
    tables(spark, sf)
    got = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "text", "shard", "shard_bytes"} <= set(got.columns) and got.count() > 0
