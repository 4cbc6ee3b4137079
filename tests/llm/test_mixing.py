import re
from collections import defaultdict

import pytest

from visitlens.llm import mixing, queries
from visitlens.llm.common import Scratch, numbered
from visitlens.llm.mixing import mix, mix_documents, source_targets, word_count

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), most=3):
    """Sharing and resharing, as it is told."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while True:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]} if total else set()
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in full)
        open_ -= full


def check(rows, docs):
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r, (i, text, source) in zip(sorted(rows, key=lambda r: r.rid), docs, strict=True):
        assert r["size"] == len(WORD.findall(text or "")) and r.doc_id == i
        sizes[source] += r["size"]
        taken[source] += r["size"] * r.copies
        largest[source] = max(largest[source], r["size"])
        assert 0 <= r.copies <= 3
    want = targets(sizes)
    for r, (_, _, source) in zip(sorted(rows, key=lambda r: r.rid), docs, strict=True):
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert abs(taken[source] - r.target) <= largest[source] + 1e-6


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").coalesce(1)
    rows = mix(docs).collect()
    check(rows, [(r.doc_id, r.text, r.source) for r in docs.collect()])
    got = queries.op5_mixing(spark, data)
    assert sorted(got.collect()) == sorted(queries.op5_mixing(spark, data).collect())
    assert got.where("taken > 3 * size").count() == 0


def test_odd_rows(make_docs, clashes):
    texts = ["a b c", None, "", "é x y", "a b c", "w " * 50_000, " \t\n\x0b\x0c\r", "one", "two words"] * 9
    sources = ["b", "b", None, None, "", "a", "a", "\U0001f600", "z"] * 9
    docs = make_docs(texts, ids=[None, 1, 2] * 27, sources=sources, **clashes).coalesce(1)
    rows = mix(docs).collect()
    check(rows, list(zip([None, 1, 2] * 27, texts, sources, strict=True)))
    out = mix_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in rows)
    assert mix(make_docs([])).count() == 0 and mix_documents(make_docs([])).count() == 0
    assert {r.copies for r in mix(make_docs(["", None])).collect()} == {0}


def test_many_levels(make_docs):
    n = 6000
    docs = make_docs(["w " * (1 + i % 7) for i in range(n)], sources=["hot" if i % 3 else f"s{i % 4}" for i in range(n)]).coalesce(1)
    check(mix(docs).collect(), [(r.doc_id, r.text, r.source) for r in docs.collect()])


def test_chances(make_docs):
    """A document's copies are right on average over seeds."""
    docs = make_docs(["w " * (1 + i % 5) for i in range(60)], sources=["a", "b", "c"] * 20).coalesce(1)
    total, due = defaultdict(float), {}
    rows = numbered(docs, Scratch(docs.sparkSession, "rows"))
    for seed in range(40):
        for r in mixing._mix(rows, mixing.WEIGHTS, seed).collect():
            total[r.doc_id] += r.copies / 40
            due[r.doc_id] = r.target / r.source_size
    assert sum(abs(total[i] - due[i]) for i in total) / len(total) < 0.12


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 1, None: 0, "d": 300, "": 70}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    assert {r.source: r.target for r in source_targets(df).collect()} == pytest.approx(targets(sizes))


def test_many_sources(spark):
    """Places of sources are counted across the parts of a sorted table."""
    sizes = {f"s{i:04d}": 1 + (i * 7919) % 500 for i in range(900)} | {None: 3}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long").repartition(9)
    got = source_targets(df).collect()
    assert [r.source for r in sorted(got, key=lambda r: r.source_no)] == [*sorted(s for s in sizes if s), None]
    assert {r.source: r.target for r in got} == pytest.approx(targets(sizes))


def test_words(make_docs):
    texts = ["a b", None, " ", "\x0b\x0c", "a b"]
    got = make_docs(texts)
    assert [r[0] for r in got.orderBy("doc_id").select(word_count(got["text"])).collect()] == [2, 0, 1, 0, 1]
