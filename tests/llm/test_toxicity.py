import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from visitlens.llm import queries, toxicity
from visitlens.llm.toxicity import DRIFT, Scores, fit, remove_toxic, score, segments, tokens


def ruzzo_tompa(x):
    """By the definition: the best segment, then the same on either side of it."""
    if not len(x):
        return []
    best = max(((sum(x[a:b]), -(b - a), -a, a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=None)
    if best[0] <= 0:
        return []
    a, b = best[3:]
    return ruzzo_tompa(x[:a]) + [(a, b)] + [(i + b, j + b) for i, j in ruzzo_tompa(x[b:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=14))
def test_segments(x):
    got = segments(np.array(x, dtype=float))
    assert [s for _, _, s in got] == [sum(x[a:b]) for a, b, _ in got]
    want = ruzzo_tompa(x)
    assert sum(s for _, _, s in got) == sum(sum(x[a:b]) for a, b in want)
    assert max((s for _, _, s in got), default=0) == max((sum(x[a:b]) for a, b in want), default=0)
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))


def test_whole_table(spark):
    """Held-out accuracy on the larger table; nothing but the text counts."""
    folder = "/root/testdata/sf0.1"
    got = queries.op10_toxicity(spark, folder).toPandas().set_index("doc_id")
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    assert all(got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index])
    marked = spark.read.parquet(f"{folder}/labels.parquet").toPandas().join(got, on="doc_id")
    test = marked[marked["held_out"]]
    hits = ((test["predicted"] == 1) & (test["toxic"] == 1)).sum()
    assert hits >= 0.9 * test["toxic"].sum() and hits >= 0.9 * test["predicted"].sum()


@pytest.fixture(scope="module")
def marked(spark, make_docs):
    texts = [f"good words here number w{i % 50} and more of them x{i % 31}" + (" awful rotten" if i % 4 == 0 else " kindly") for i in range(400)]
    texts = [t.replace("awful rotten", f"awful{i % 9} rotten") for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int").selectExpr("*", "'a' AS text", "1 AS source")
    return make_docs(texts), labels


def test_odd_rows(spark, make_docs, marked, clashes):
    docs, labels = marked
    odd = make_docs([None, "", "...", "awful rotten awful3", "good words here", "good words " * 100_000 + " rotten awful7 rotten", "ROTTEN awfulness"], ids=[None, 1001, 1002, 1003, 1004, 1005, 1003], **clashes)
    both = odd.unionByName(docs, allowMissingColumns=True)
    rows = score(both, labels).where("doc_id > 1000 OR doc_id IS NULL").collect()
    judged = {(r.doc_id, r.text and r.text[:6]): r["_score"] for r in rows}
    assert len(rows) == 7 and all(0 <= s <= 1 for s in judged.values())
    assert {k for k, s in judged.items() if s >= 0.5} == {(1003, "awful "), (1005, "good w"), (1003, "ROTTEN")}
    kept = remove_toxic(both, labels)
    assert kept.columns == both.columns and kept.count() == 304
    assert score(make_docs([]), labels).count() == 0
    assert score(odd, labels.where("false")).where("_score >= 0.5").count() == 0
    assert score(docs, labels.where("toxic = 0")).where("_score >= 0.5").count() == 0


def test_only_training_rows_count(spark, marked, monkeypatch):
    docs, labels = marked
    lies = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    first = toxicity.report(docs, labels).orderBy("doc_id").collect()
    assert first == toxicity.report(docs, lies).orderBy("doc_id").collect()


def brute_score(text, lexicon, model):
    """From the fitted numbers: every segment by its definition, then the formula."""
    scores = []
    for word in re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower()):
        found = lexicon.get(word)
        for n in (7, 6, 5, 4):
            if found is None and len(word) >= n:
                found = lexicon.get("\x01" + word[:n])
        scores.append((found or 0.0) - DRIFT)
    bits = [model.lam * sum(scores[a:b]) - model.log_k - math.log(len(scores)) for a, b in ruzzo_tompa(scores)]
    bits = [b for b in bits if b > -math.log(0.05)]
    best, total = max(bits, default=0.0), sum(bits)
    z = sum(w * x for w, x in zip(model.weights, (1.0, min(best, 20.0) / 10, math.log1p(best), math.log1p(total)), strict=True))
    return 1 / (1 + math.exp(-z))


def test_query_is_brute_force(spark, make_docs, marked, tmp_path):
    docs, labels = marked
    some = make_docs(["rotten w1 awful3 w2 x3", "good rotten words awfully x1 rotten", "", None, "words here " * 8 + "rotten"], ids=[2001, 2002, 2003, 2004, 2005])
    folder = f"file://{tmp_path}"
    docs.unionByName(some).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    whole = spark.read.parquet(f"{folder}/documents.parquet")
    model, lexicon = fit(whole, labels)
    known = {r.token: r.score for r in lexicon.collect()}
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, folder).collect()}
    assert len(got) == 405 and any(v < 0 for v in known.values()) and any(v > 0 for v in known.values())
    for r in whole.where("doc_id < 20 OR doc_id > 2000").collect():
        assert got[r.doc_id].score == pytest.approx(brute_score(r.text, known, model), abs=1e-9)
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)


def test_lexicon_of_any_size(make_docs, marked):
    """Scores joined to tokens are those of a lexicon that is sent."""
    docs, labels = marked
    first, second = ({r.doc_id: (round(r["_score"], 9), len(r["_passages"])) for r in score(docs, labels, max_lexicon_bytes=n).collect()} for n in (None, 0))
    assert first == second and len(first) == 400


def test_lexicon():
    scores = Scores({"rotten": 3.0, "\x01awful": 2.0, "\x01awfu": -1.0, "\x01éééé": 1.5})
    assert [scores[w] + DRIFT for w in ("rotten", "awfulness", "awfuxx", "rott", "ok", "éééé", "ééé")] == [3.0, 2.0, -1.0, 0.0, 0.0, 1.5, 0.0]
    assert tokens("Ab-é2 \u2028x_Y") == ["ab", "é2", "\u2028x", "y"]
