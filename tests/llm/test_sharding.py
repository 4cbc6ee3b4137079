import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from visitlens.llm import queries
from visitlens.llm.sharding import TOLERANCE, SlotMap, assign, shard_documents

ODD = ["", None, "é" * 5, "a", "a", "x" * 300_000]


def test_whole_table(spark, data):
    got = queries.op1_sharding(spark, data).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    loads = Counter()
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        loads[r.shard] += r["size"]
    assert set(loads) <= set(range(40))
    biggest = max(r["size"] for r in got)
    assert max(loads.values()) - min(loads.values()) <= biggest
    by_text, mean = defaultdict(list), sum(loads.values()) / 40
    for r in got:
        by_text[docs[r.doc_id] if docs[r.doc_id] is not None else r.doc_id].append(r)
    for rows in by_text.values():  # equal texts are together, unless they'd fill half of a shard
        assert len({r.shard for r in rows}) == 1 or sum(r["size"] for r in rows) > mean / 2
    for s in loads:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_odd_rows(make_docs, clashes):
    docs = make_docs(ODD, ids=[1, None, None, 4, 4, 6], **clashes)
    got = shard_documents(docs, 3).collect()
    assert len(got) == 6 and sorted(r["size"] for r in got) == sorted([16, 16, 26, 17, 17, 300_016])
    assert [r.text_crc32 for r in got].count(None) == 1
    assert sorted((r.shard, r.slot) for r in got) == sorted({(r.shard, r.slot) for r in got})
    out = assign(docs, 3)
    assert set(docs.columns) == set(out.columns) and len(out.columns) == len(set(out.columns)) and out.count() == 6
    assert assign(make_docs([]), 3).count() == 0
    assert shard_documents(make_docs([]), 3).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 10_000), min_size=1, max_size=200), st.integers(1, 9))
def test_balance(sizes, shards):
    m = SlotMap.initial(256, shards)
    m.rebalance(dict(enumerate(sizes)))
    loads = Counter()
    for slot, size in enumerate(sizes):
        loads[m.current[slot]] += size
    full = [loads[s] for s in range(shards)]
    assert max(full) - min(full) <= max(sizes)


def test_hot_texts(make_docs, monkeypatch):
    """A text with a third of all rows is dealt over the shards, and numbered in parts; others are whole."""
    monkeypatch.setattr("visitlens.llm.sharding.ROWS_A_TASK", 50)
    texts = ["hot text"] * 500 + [None] * 300 + [f"text {i % 200}" for i in range(700)]
    got = shard_documents(make_docs(texts, ids=[1] * 800 + list(range(700))), 10).collect()
    loads, shards = Counter(), defaultdict(set)
    for r in got:
        loads[r.shard] += r["size"]
        shards[r.text_crc32].add(r.shard)
    assert max(loads.values()) - min(loads.values()) <= max(TOLERANCE * sum(loads.values()) / 10, 24) * 3
    assert len(shards[zlib.crc32(b"hot text")]) > 3
    assert all(len(v) == 1 for k, v in shards.items() if k not in (None, zlib.crc32(b"hot text")))
    for s in loads:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_versions(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    m = SlotMap.initial(64, 4)
    m.store(spark, path)
    m.rebalance({s: 10 + s for s in range(64)})
    second = list(m.current)
    m.store(spark, path)
    moved = m.rebalance({s: 10 + s for s in range(64)}, 5)
    assert 0 < moved < 64 and m.version == 3
    m.store(spark, path)
    assert SlotMap.load(spark, path) == m
    assert SlotMap.load(spark, path, 2) == SlotMap(4, 2, second) and SlotMap.load(spark, path, 1) == SlotMap.initial(64, 4)
    with pytest.raises(LookupError):
        SlotMap.load(spark, path, 4)
    m.rebalance({s: 10 + s for s in range(64)}, 3)  # shards that go are emptied
    assert set(m.current) <= {0, 1, 2}


def test_map_is_kept(spark, make_docs, tmp_path):
    path = f"file://{tmp_path}/map"
    docs = make_docs([f"text {i}" for i in range(300)])
    first = {r.doc_id: (r.virtual_slot, r.shard) for r in assign(docs, 4, store=path).collect()}
    known = SlotMap.load(spark, path)
    assert all(known.current[slot] == shard for slot, shard in first.values())
    grown = {r.doc_id: (r.virtual_slot, r.shard) for r in assign(docs, 5, known=known, store=path).collect()}
    assert {i: s for i, (s, _) in grown.items()} == {i: s for i, (s, _) in first.items()}
    assert sum(grown[i] != first[i] for i in first) < 150 and SlotMap.load(spark, path).version == 3
