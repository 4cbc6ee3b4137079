"""URL filter: a trie over reversed host labels and then path segments, longest match first."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import Scratch, numbered, shield

#: (host, path, verdict); fixed values of the production rule set.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Largest rule set, in bytes of hosts and paths, that is sent to every executor as a trie.
MAX_TRIE_BYTES = 16 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Node:
    """A node of the trie: labels below it, the path trie of the rules that end here, and its verdict."""

    __slots__ = ("below", "paths", "rests", "rule")

    def __init__(self):
        self.below: dict[str, Node] = {}
        self.paths: Node | None = None
        self.rests: dict[str, tuple[str, str]] = {}
        self.rule: tuple[str, str] | None = None


def segments(path: str) -> list[str]:
    """``/en/a`` as ``['/', 'en/', 'a']``; only the last may lack its slash."""
    parts = path.split("/")
    return [x + "/" for x in parts[:-1]] + [x for x in parts[-1:] if x]


def _better(old: tuple[str, str] | None, new: tuple[str, str]) -> tuple[str, str]:
    return new if old is None or new[1] == "block" else old


def build(rules: Iterable[tuple[str, str, str]]) -> Node:
    root = Node()
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.lower().split(".")):
            node = node.below.setdefault(label, Node())
        node.paths = at = node.paths or Node()
        found = (host.lower() + path, verdict)
        for part in segments(path):
            if part.endswith("/"):
                at = at.below.setdefault(part, Node())
            else:
                at.rests[part] = _better(at.rests.get(part), found)
                break
        else:
            at.rule = _better(at.rule, found)
    return root


def match(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """The rule with the most host labels, and among these the longest path; at a tie block wins."""
    node, ends = root, []
    for label in reversed(host.split(".")):
        node = node.below.get(label)
        if node is None:
            break
        if node.paths is not None:
            ends.append(node.paths)
    parts = segments(path) if ends else []
    for at in reversed(ends):
        best = at.rule
        for part in parts:
            for rest in sorted(at.rests, key=len, reverse=True):
                if part.startswith(rest):
                    best = at.rests[rest]
                    break
            at = at.below.get(part)
            if at is None:
                break
            best = at.rule or best
        if best:
            return best
    return None


def host_path(pages: DataFrame) -> DataFrame:
    """``host`` and ``path`` of every url; both empty for a null url or one without ``://``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    rest = F.substring(after, F.length(host) + 1, F.length(after))
    return pages.withColumn("host", F.translate(host, _UPPER, _UPPER.lower())).withColumn("path", F.regexp_extract(rest, r"^[^?#]*", 0))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``, which replace columns of these names.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest rule
    wins, whether it allows or blocks; without one the verdict is ``default`` and the rule null.  A null
    url, an empty one or one without ``://`` has an empty host and path.  Very long urls are read whole.  Of two
    equal rules the one that blocks wins.  Repeated rows are judged each; an empty table stays empty; other
    columns pass through, whatever their names.  Rule sets above MAX_TRIE_BYTES aren't broadcast but joined by host suffix.
    """
    safe, restore = shield(pages, ("url",))
    parsed = host_path(safe)
    if sum(len(h.encode()) + len(p.encode()) for h, p, _ in rules) > MAX_TRIE_BYTES:
        by_join = judge_by_join(host_path(numbered(safe, Scratch(pages.sparkSession, "pages"))), pages.sparkSession.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string"), default)
        return restore(by_join, "host", "path", "rule", "verdict")
    sent = pages.sparkSession.sparkContext.broadcast(build(rules))

    @F.pandas_udf("rule string, verdict string")
    def look(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        root = sent.value
        for host, path in batches:
            found = [match(root, h, p) or (None, default) for h, p in zip(host, path, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    found = parsed.withColumn("found", look("host", "path")).withColumns({"rule": F.col("found.rule"), "verdict": F.col("found.verdict")})
    return restore(found, "host", "path", "rule", "verdict")


def judge_by_join(parsed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for rule sets of any size: host suffixes of a page (with ``rid``, a row number) meet the rules of that host in an equi-join."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    strength = F.struct(F.length("rule_host").alias("h"), F.length("rule_path").alias("p"), (F.col("rule_verdict") == "block").alias("b"))
    best = (
        parsed.select("rid", "path", F.explode(suffixes).alias("suffix"))
        .join(rules.select(F.lower("rule_host").alias("suffix"), "rule_host", "rule_path", "rule_verdict"), "suffix")
        .where(F.col("path").startswith(F.col("rule_path")))
        .groupBy("rid")
        .agg(F.max_by(F.struct(F.concat(F.lower("rule_host"), "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), strength).alias("best"))
    )
    return parsed.join(best, "rid", "left").withColumns({"rule": F.col("best.rule"), "verdict": F.coalesce("best.verdict", F.lit(default))})


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fit AS (
  SELECT page_id, rule_host || rule_path AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS n
  FROM p JOIN rules r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM fit WHERE n = 1) f USING (page_id)
"""
