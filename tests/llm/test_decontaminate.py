import hashlib
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from visitlens.llm import decontaminate, queries
from visitlens.llm.decontaminate import TestSet, find_matches, remove_contaminated, search_shard, words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, items, window=10):
    owners = defaultdict(set)
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            owners[tuple(w[p : p + n])].add("" if item is None else str(item))
    out = {}
    for i, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(k) for k in owners}:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in owners:
                    hit.update(range(p, p + n))
                    found |= owners[k]
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_whole_table(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op6_decontaminate(spark, data).collect()}
    assert got == brute(docs, items)
    assert any(x[-1] for x in got.values())


@pytest.mark.parametrize("most", [decontaminate.MAX_TEST_BYTES, 40])
def test_odd_rows(spark, make_docs, clashes, most):
    w = [f"w{i}" for i in range(40)]
    texts = [None, "", "...", " ".join(w), "W3, w4; w5 w6 w7 w8 w9 w10 w11 W12!", " ".join(w[:9]), "x " * 100_000 + " ".join(w[5:25]), "été Ä b", "ÉTÉ", " ".join(w[30:] + w[:12])]
    items = [(1, " ".join(w[:20])), (10, " ".join(w[8:30])), (2, None), (3, ""), (4, "été ä"), (5, "été Ä"), (5, "w39 w38"), (None, " ".join(w[28:39]))]
    docs = make_docs(texts, **clashes)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS lang")
    found = find_matches(docs, bench, max_test_bytes=most)
    got = {r.doc_id: (r["_n_words"], r["_n_hit"], len(r["_hit_items"]), decontaminate.item_digest(r["_hit_items"]), r["_n_hit"] > 0) for r in found.collect()}
    want = brute(list(enumerate(texts)), items)
    assert got == want
    clean = remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, x in want.items() if not x[-1]}
    assert find_matches(docs, bench.where("false")).where("_n_hit > 0").count() == 0
    assert find_matches(make_docs([]), bench).count() == 0


TEXT = st.lists(st.sampled_from("abcd"), max_size=30).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=5), st.lists(TEXT, max_size=4), st.integers(1, 6))
def test_shard_is_brute_force(texts, items, window):
    found = search_shard([words(t) for t in texts], TestSet(list(enumerate(items)), window))
    want = brute(list(enumerate(texts)), list(enumerate(items)), window)
    for i, text in enumerate(texts):
        names = [m.item_id for m in found.matches[i]]
        hit = sum(k for _, k in found.spans[i])
        assert (found.counts[i], hit, len(names), decontaminate.item_digest(names)) == want[i][:4] and len(set(names)) == len(names)
        for m in found.matches[i]:
            assert m[1:] == longest(text.split(), items[int(m.item_id)].split())


def longest(a, b):
    """Length and places of the longest run of words that both have; the first of several."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
    return best


def test_matches_do_not_depend_on_passes(spark, make_docs):
    """Windows of different items that touch are one span, however many passes find them; matches are by item."""
    w = [f"w{i}" for i in range(60)]
    docs = make_docs([" ".join(w), " ".join(w[:10] + w[30:40]), " ".join(w[:20] + ["x"] + w[20:])])
    bench = spark.createDataFrame([(i, " ".join(w[10 * i : 10 * i + 10])) for i in range(6)], "item_id long, text string")
    found = [{r.doc_id: r for r in find_matches(docs, bench, max_test_bytes=n).collect()} for n in (decontaminate.MAX_TEST_BYTES, 40)]
    one, many = ({i: [tuple(m) for m in r["_spans"]] for i, r in f.items()} for f in found)
    assert one == many == {0: [(0, 60)], 1: [(0, 20)], 2: [(0, 20), (21, 40)]}
    one, many = ({i: sorted(tuple(m) for m in r["_matches"]) for i, r in f.items()} for f in found)
    assert one == many and one[1] == [("0", 10, 0, 0), ("3", 10, 10, 0)]


def test_long_matches(spark, make_docs):
    """A verbatim match is as long as it is, with its place in both."""
    w = [f"w{i}" for i in range(80)]
    docs = make_docs([" ".join(["a", "b", *w[7:51], "c", *w[60:72]])])
    bench = spark.createDataFrame([("x", " ".join(w))], "item_id string, text string")
    row = find_matches(docs, bench).first()
    assert [tuple(m) for m in row["_matches"]] == [("x", 44, 2, 7)] and row["_n_hit"] == 56
