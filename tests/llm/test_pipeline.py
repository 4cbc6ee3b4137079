"""The pipeline against plain Python, stage by stage."""

from collections import Counter

import corpus_pipeline
from test_decontaminate import brute as contaminated
from test_mixing import check
from test_near import brute_classes

from visitlens.llm import mixing, toxicity


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    kept = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = kept[name] = spark.read.parquet(f"file://{tmp_path}/{name}")
    rows = {n: [(r.doc_id, r.text) for r in df.collect()] for n, df in kept.items()}
    bad = {r.doc_id for r in toxicity.score(kept["documents"], labels).where("_score >= 0.5").collect()}
    assert Counter(rows["toxicity"]) == Counter(r for r in rows["documents"] if r[0] not in bad)
    classes = brute_classes(rows["toxicity"])
    assert {i for i, _ in rows["near_duplicates"]} == set(classes.values()) and len(rows["near_duplicates"]) == len(set(classes.values()))
    hit = contaminated(rows["near_duplicates"], items)
    assert Counter(rows["decontamination"]) == Counter(r for r in rows["near_duplicates"] if not hit[r[0]][-1])
    one = kept["decontamination"].coalesce(1)
    mixed = mixing.mix(one).collect()
    check(mixed, [(r.doc_id, r.text, r.source) for r in one.collect()])
    times = Counter(i for i, _ in rows["mixing"])
    assert max(times.values()) <= 3
    loads, seen = Counter(), {}
    for r in kept["sharding"].collect():
        loads[r.shard] += len(r.text.encode()) + 16
        assert seen.setdefault(r.virtual_slot, r.shard) == r.shard
    assert Counter(rows["sharding"]) == Counter(rows["mixing"]) and set(loads) <= set(range(40))


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0


def test_odd_rows(spark, make_docs, clashes, tmp_path):
    """Null, empty, very long, repeated rows and clashing columns go through all stages; an empty table, too."""
    folder = f"file://{tmp_path}"
    words = [f"w{i}" for i in range(40)]
    texts = [None, "", "...", "a b c", "a b c", " ".join(words), "x y z " * 50_000, "A b C!", None] + [f"text number {i} of some words {i * i}" for i in range(30)]
    docs = make_docs(texts, ids=[None, 1, 2, 3, 3, 5, 6, 7, None, *range(100, 130)], sources=["s", None, ""] * 13, **clashes)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(100, 1, 1), (101, 1, 0), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words[3:20])), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, folder)
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        rows = spark.read.parquet(f"{folder}/{name}")
        if name == "near_duplicates":
            kept = Counter(r.text for r in rows.collect())
            assert kept[None] == 2 and kept[""] == 1 and kept["..."] == 1 and kept["a b c"] + kept["A b C!"] == 1
        if name == "decontamination":
            assert all(r.doc_id != 5 for r in rows.collect())
    assert set(docs.columns) <= set(rows.columns) and rows.count() > 0
    assert corpus_pipeline.run(spark, folder).count() == rows.count()
    empty = f"{folder}/empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
