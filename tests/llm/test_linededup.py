import re
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from visitlens.llm import queries
from visitlens.llm.linededup import dedup_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, min_lines=1, min_words=5):
    """(text, runs) of each document; docs are (doc_id, text) in order.  Every run of lines is looked for among all earlier ones."""
    kept = [[(i, x) for i, x in enumerate((text or "").split("\n")) if WORD.search(x)] for _, text in docs]
    first = {}
    for d, lines in enumerate(kept):
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                first.setdefault(tuple(x for _, x in lines[a:b]), (d, a))
    out = []
    for d, (_, text) in enumerate(docs):
        lines = kept[d]
        spans = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1) if first[tuple(x for _, x in lines[a:b])] != (d, a)]
        spans = [(a, b) for a, b in spans if not any((c, e) != (a, b) and c <= a and b <= e for c, e in spans)]
        spans = [(a, b) for a, b in spans if b - a >= min_lines and sum(len(WORD.findall(x)) for _, x in lines[a:b]) >= min_words]
        runs = sorted((lines[a][0], lines[b - 1][0] + 1) for a, b in spans)
        gone = {i for a, b in runs for i in range(a, b)}
        out.append((text if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone), runs))
    return out


def run(docs, *least):
    rows = sorted(dedup_lines(docs, *least).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    return [(r.text, [tuple(x) for x in r.runs or []]) for r in rows]


def test_whole_table(same_as_oracle):
    same_as_oracle(queries.op4_line_dedup, queries.ORACLE_SQL["op4_line_dedup"])


@pytest.mark.parametrize("least", [(1, 5), (1, 1), (2, 1), (3, 2)])
def test_runs(make_docs, clashes, least):
    texts = ["a\nb\nc\nd\ne\nf", "x\na\nb\nc\nd\ne\nf\ny", "a\nb\nz", "", None, "\n \n\n", "q\nq\nq\nq\nq\nq\nq", "a\nb\nc\nd\ne\nf", "b\nc\n\n\td\ne", "one two three four five", "z\none two three four five\na", "b\n\nc\nd"]
    docs = make_docs(texts, **clashes)
    assert run(docs, *least) == brute(list(enumerate(texts)), *least)
    assert set(docs.columns) == set(dedup_lines(docs, *least).columns)
    assert dedup_lines(make_docs([]), *least).count() == 0


@pytest.mark.parametrize("texts, runs", [(["a\nb", "b\nc", "a\nb\nc"], [(0, 2), (1, 3)]), (["p\nq", "r\ns", "p\nq\nr\ns"], [(0, 2), (2, 4)])])
def test_runs_are_reported_each(make_docs, texts, runs):
    got = run(make_docs(texts), 2, 1)
    assert got[2] == ("", runs) and got[:2] == [(texts[0], []), (texts[1], [])]


def test_repeated_rows(make_docs):
    rows = run(make_docs(["a\nb\nc"] * 3, ids=[7, 7, None]), 2, 1)
    assert sorted(t for t, _ in rows) == ["", "", "a\nb\nc"] and rows[-1] == ("", [(0, 3)])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "", "two words"]), max_size=12), max_size=8), st.sampled_from([(1, 1), (1, 5), (3, 1)]))
def test_is_brute_force(make_docs, lines, least):
    texts = ["\n".join(x) for x in lines]
    assert run(make_docs(texts), *least) == brute(list(enumerate(texts)), *least)


def test_copies_of_a_long_text(make_docs):
    lines = [f"line {i}" for i in range(1500)]
    text = "\n".join(lines)
    counts = defaultdict(int)
    for t, runs in run(make_docs([text] * 20 + ["\n".join([*lines[700:1437], "end"])])):
        counts[t, tuple(runs)] += 1
    assert counts == {(text, ()): 1, ("", ((0, 1500),)): 19, ("end", ((0, 737),)): 1}
