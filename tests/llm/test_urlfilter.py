import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from visitlens.llm import queries, urlfilter
from visitlens.llm.urlfilter import RULES, build, judge, match

CASES = [
    ("http://a.com/x", "com/", "allow"),
    ("http://a.com", None, "allow"),
    ("http://COM/", "com/", "allow"),
    ("http://blog.example.com/en/1", "example.com/en/", "block"),
    ("https://m.www.EXAMPLE.com/en/1?x=/fr/", "www.example.com/en/", "allow"),
    ("http://example.com/en", "com/", "allow"),
    ("http://x.net/es/", "net/es/", "block"),
    ("http://x.net/fr/a#b", "net/fr/", "block"),
    ("http://x.net/de/", None, "allow"),
    ("http://notexample.com/en/", "com/", "allow"),
    ("nothing", None, "allow"),
    (None, None, "allow"),
    ("", None, "allow"),
    ("x?u=http://y.net/es/", "net/es/", "block"),
    ("http://a.com?q=://b.net/es/", None, "allow"),
    ("http://com:80/", None, "allow"),
    ("http://" + "a." * 3000 + "net/es/" + "b/" * 3000, "net/es/", "block"),
]


def test_whole_table(same_as_oracle):
    same_as_oracle(queries.op3_url_filter, queries.ORACLE_SQL["op3_url_filter"])


@pytest.mark.parametrize("most", [urlfilter.MAX_TRIE_BYTES, 0])
def test_cases(spark, monkeypatch, clashes, most):
    monkeypatch.setattr(urlfilter, "MAX_TRIE_BYTES", most)
    pages = spark.createDataFrame([(i, u, "x", "y") for i, (u, _, _) in enumerate(CASES)], "page_id long, url string, _host string, html string")
    clashing = pages.withColumns({k: F.lit(v) for k, v in clashes.items()})
    out = judge(clashing)
    assert set(out.columns) == set(clashing.columns) and len(out.columns) == len(clashing.columns)
    got = {r.page_id: (r["rule"], r["verdict"]) for r in judge(pages).collect()}
    assert got == {r.page_id: (r["rule"], r["verdict"]) for r in out.collect()}
    assert got == {i: (r, v) for i, (_, r, v) in enumerate(CASES)}
    assert judge(pages.where("false")).count() == 0


LABEL = st.sampled_from(["a", "b", "com"])
HOST = st.lists(LABEL, min_size=1, max_size=3).map(".".join)
PATH = st.lists(st.sampled_from(["x", "y", "xy", ""]), max_size=3).map(lambda p: "/" + "/".join(p))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(HOST, PATH, st.sampled_from(["allow", "block"])), max_size=6), HOST, PATH)
def test_longest_match(rules, host, path):
    fit = [(h.count("."), len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    want = max(fit)[3:] if fit else None
    assert match(build(rules), host, path) == want


def test_rules_are_the_contract():
    assert len(RULES) == 5
