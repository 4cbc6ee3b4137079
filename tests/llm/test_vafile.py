from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from visitlens.llm import queries
from visitlens.llm.vafile import bounds, cut, scan_block, top_k

INF, NAN = float("inf"), float("nan")


def brute(rows, k=5):
    q = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, v in q.items():
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in q.items() if j != i and len(w) == len(v))
            out += [(i, n, j, -s) for n, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_whole_table(same_as_oracle):
    same_as_oracle(queries.op2_exact_top_k, queries.ORACLE_SQL["op2_exact_top_k"])


def test_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(101)]
    rows += [(150, None), (200, [1.0, None, 1.0, 0.0, 0.0, 0.0]), (250, [INF] * 6), (300, [NAN] * 6), (350, [1.0, 2.0]), (351, [1.0, 1.0]), (352, [2.0, 0.0]), (400, rows[3][1]), (401, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "2 AS lane", "'x' AS q")
    for more in ({}, {"block": 3}, {"block": 20, "query_bytes": 100}):  # one round, several, several blocks of queries
        assert sorted(tuple(r) for r in top_k(df, df.where("vec_id % 50 = 0"), **more).collect()) == brute(rows)
    assert top_k(df.where("false"), df.where("false")).count() == 0
    assert top_k(df, df.where("vec_id = 150")).count() == 0


def test_hot_vectors(spark):
    """Copies tie: the least vec_ids are found, and rows repeated in full as often as they occur."""
    rows = [(i, [1.0, 1.0]) for i in range(400)] + [(7, [1.0, 1.0])] * 3 + [(1000 + i, [float(i % 7), 0.5]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in sorted(top_k(df, df.where("vec_id IN (0, 7, 1003)"), k=9, block=16).collect()):
        got[r.query_id].append((r.vec_id, r.score))
    for query, vector in ((0, [1.0, 1.0]), (7, [1.0, 1.0]), (1003, [3.0, 0.5])):
        scored = sorted((-int(sum(int(256 * a) * int(256 * b) for a, b in zip(vector, v, strict=True))), i) for i, v in rows if i != query)
        assert got[query] == [(i, -s) for s, i in scored[:9]]


NUMBERS = st.one_of(st.integers(-300, 300), st.integers(-(1 << 62), 1 << 62))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(NUMBERS, min_size=3, max_size=3), min_size=1, max_size=40), st.integers(1, 6))
def test_bounds_hold(vectors, k):
    """Cells hold their integers, bounds the exact products, and the best k are among the candidates."""
    v = np.array(vectors, dtype=np.int64)
    low, width, cells = cut(v)
    for row, code in zip(vectors, cells.tolist(), strict=True):
        assert all(int(a) + int(w) * c <= x < int(a) + int(w) * (c + 1) for x, a, w, c in zip(row, low, width, code, strict=True))
    exact = [[sum(a * b for a, b in zip(q, w, strict=True)) for w in vectors] for q in vectors[:2]]
    upper, lower = bounds(v[:2], low, width, cells)
    assert all(lo <= float(x) <= up for xs, los, ups in zip(exact, lower, upper, strict=True) for x, lo, up in zip(xs, los, ups, strict=True))
    sole = np.array([(1, i) for i in range(len(v))])
    found = {(int(a), int(b)) for q, j, _, _ in scan_block(v[:2], np.arange(2)[: len(v)], np.full(2, -np.inf), (sole, low, width, cells), k) for a, b in zip(q, j, strict=True)}
    for i, xs in enumerate(exact):
        assert {(i, j) for _, j in sorted((-x, j) for j, x in enumerate(xs) if j != i)[:k]} <= found


def test_scores_beyond_a_long(spark):
    df = spark.createDataFrame([(0, [1e10, 1.0]), (1, [1e10, 1.0]), (2, [1.0, 1.0]), (3, [-1e10, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.vec_id, r["rank"], r.score) for r in top_k(df, df.where("vec_id = 0")).collect()]
    assert got[0] == (1, 1, 2**63 - 1) and got[1][:2] == (2, 2) and 0 < got[1][2] < 2**60 and got[2] == (3, 3, -(2**63))
