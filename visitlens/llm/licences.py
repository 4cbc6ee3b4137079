"""Licence scan by canonical digests, in DataFrame operations only.

A text is brought to a canonical form (case, copyright lines, punctuation, equivalent spellings) and its
SHA-256 is looked up among the digests of known licence texts, which go through the same form.

The same is done for the parts of a text, its lines and its paragraphs (blocks of lines between blank ones): a text
contains a licence if each paragraph of the licence is one of its parts.  So a licence or a notice is found within
other text, however its paragraphs are wrapped as long as they are apart.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import if_small, shield
from visitlens.llm.licence_texts import LICENCES, SPELLINGS

#: Lines that only say who holds the copyright, and since when.
COPYRIGHT = r"(?m)^[ \t\x2A\x23/;-]*(copyright|\(c\)|\x{A9})[ \t]*(copyright|\(c\)|\x{A9}|[0-9<\[{]|by )[^\n]*$"
RESERVED = r"(?m)^[ \t\x2A\x23/;-]*all rights reserved[.]?[ \t\r]*$"
#: What isn't part of a word, but for line ends: ASCII but letters and digits, Latin-1 signs, general punctuation.
SEPARATORS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x{BF}\x{2000}-\x{206F}]+"
#: Known parts that are compared within one expression.
GROUP = 2000


def stacked(text: Column) -> Column:
    """Lower case, without copyright lines; words with one space between, lines as they were."""
    lines = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, " "), RESERVED, " ")
    return F.regexp_replace(F.regexp_replace(lines, SEPARATORS, " "), " *\n *", "\n")


def plain(stack: Column) -> Column:
    """All lines as one."""
    return F.trim(F.regexp_replace(stack, "[ \n]+", " "))


def parts(stack: Column) -> Column:
    """Paragraphs and lines, each as one line, without empty ones."""
    blocks = F.transform(F.split(stack, "\n\n+"), lambda p: F.trim(F.replace(p, F.lit("\n"), F.lit(" "))))
    lines = F.transform(F.split(stack, "\n"), lambda p: F.trim(p))
    return F.array_remove(F.array_distinct(F.concat(blocks, lines)), "")


def paragraphs(stack: Column) -> Column:
    return F.array_remove(F.array_distinct(F.transform(F.split(stack, "\n\n+"), lambda p: F.trim(F.replace(p, F.lit("\n"), F.lit(" "))))), "")


def word_total(plain_text: Column) -> Column:
    return F.when(plain_text == "", F.lit(0)).otherwise(F.length(plain_text) - F.length(F.translate(plain_text, " ", "")) + 1)


def digest(plain_text: Column) -> Column:
    """SHA-256 after equivalent spellings are made one."""
    # every word between two spaces of its own
    apart = F.concat(F.lit(" "), F.replace(plain_text, F.lit(" "), F.lit("  ")), F.lit(" "))
    for seldom, common in SPELLINGS.items():
        apart = F.replace(apart, F.lit(f" {seldom} "), F.lit(f" {common} "))
    some = plain_text.rlike(f"(^| )({'|'.join(SPELLINGS)})( |$)")
    return F.sha2(F.when(some, F.trim(F.replace(apart, F.lit("  "), F.lit(" ")))).otherwise(plain_text), 256)


def signature(plain_text: Column) -> Column:
    """Number of words, and the first one in its usual spelling: texts of one digest have one signature."""
    usual = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    first = F.substring_index(plain_text, " ", 1)
    return F.concat(word_total(plain_text).cast("string"), F.lit(" "), F.coalesce(F.try_element_at(usual, first), first))


def known_digests(spark, licences: list[tuple[str, str]] = LICENCES) -> DataFrame:
    """(digest, licence) of the known texts; texts alike in canonical form have the first name."""
    texts = spark.createDataFrame(licences, "licence string, text string")
    return texts.groupBy(digest(plain(stacked(F.col("text")))).alias("digest")).agg(F.min("licence").alias("licence"))


def known_parts(spark, licences: list[tuple[str, str]] = LICENCES) -> tuple[list[tuple[str, list[str]]], list[str]]:
    """(licence, digests of its paragraphs) of each known text, and the signatures of such paragraphs."""
    texts = spark.createDataFrame([(i, *x) for i, x in enumerate(licences)], "i int, licence string, text string").select("i", "licence", F.explode(paragraphs(stacked(F.col("text")))).alias("part"))
    per: dict[int, tuple[str, list[str]]] = {}
    signatures = set()
    for r in texts.select("i", "licence", digest(F.col("part")).alias("digest"), signature(F.col("part")).alias("signature")).collect():  # the list of licences itself
        per.setdefault(r.i, (r.licence, []))[1].append(r.digest)
        signatures.add(r.signature)
    return [(name, sorted(set(found))) for _, (name, found) in sorted(per.items())], sorted(signatures)


def with_contained(docs: DataFrame, known: list[tuple[str, list[str]]], signatures: list[str]) -> DataFrame:
    """``docs`` (with ``stack``) and ``_contained``: sorted names of the licences all of whose paragraphs are parts of a text; one that another of them includes isn't named."""
    none = F.array().cast("array<string>")
    # a digest only for parts that begin like a known one and are as long
    mine = F.transform(F.filter(parts(F.coalesce("stack", F.lit(""))), lambda p: signature(p).isin(signatures)), digest)
    out = docs.withColumn("mine", mine).withColumn("_contained", none)
    groups: list[list[tuple[str, list[str]]]] = [[]]
    for entry in known:
        if sum(len(d) for _, d in groups[-1]) + len(entry[1]) > GROUP:
            groups.append([])
        groups[-1].append(entry)
    for group in filter(None, groups):
        # each a column of its own, so that it is worked out once
        out = out.withColumn("hits", F.when(F.size("mine") > 0, F.array_intersect("mine", F.array(*[F.lit(d) for d in sorted({d for _, ds in group for d in ds})]))).otherwise(none))
        entries = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*[F.lit(d) for d in ds]).alias("digests")) for name, ds in group])
        names = F.transform(F.filter(entries, lambda e: F.size(F.array_except(e["digests"], F.col("hits"))) == 0), lambda e: e["name"])
        out = out.withColumn("_contained", F.when(F.size("hits") > 0, F.concat("_contained", names)).otherwise(F.col("_contained")))
    out = out.withColumn("_contained", F.array_sort(F.array_distinct("_contained")))
    wider = defaultdict(set)
    for name, ds in known:
        for other, more in known:
            if name != other and set(ds) < set(more):
                wider[name].add(other)
    if wider:
        # names that include another, by its name
        above = F.create_map(*[x for name, others in sorted(wider.items()) for x in (F.lit(name), F.array(*[F.lit(o) for o in sorted(others)]))])
        alone = F.filter("_contained", lambda n: ~F.coalesce(F.arrays_overlap(F.try_element_at(above, n), F.col("_contained")), F.lit(False)))
        out = out.withColumn("_contained", F.when(F.size("_contained") > 1, alone).otherwise(F.col("_contained")))
    return out.drop("mine", "hits")


def scan(docs: DataFrame, licences: list[tuple[str, str]] = LICENCES) -> DataFrame:
    """``docs`` with ``_n_words`` and ``_digest`` of the canonical form, ``_licence`` (the whole text is that licence) and ``_contained``.

    Columns of these names are replaced; others pass through.  Null texts have no words, no digest and no
    licence (nulls); texts without words have 0 words and no digest.  Very long texts are taken whole.  Licence
    texts alike in canonical form go by the first name.  Rows repeated in full are looked up each; an empty
    table stays empty.  ``_contained`` is an array, empty without a licence.
    """
    safe, restore = shield(docs, ("text",))
    known, signatures = known_parts(docs.sparkSession, licences)
    found = safe.withColumn("stack", stacked(F.col("text"))).withColumn("plain", plain(F.col("stack")))
    found = found.withColumn("_n_words", word_total(F.col("plain")))
    found = with_contained(found.withColumn("_digest", F.when(F.col("_n_words") > 0, digest(F.col("plain")))), known, signatures)
    names = known_digests(docs.sparkSession, licences).select(F.col("digest").alias("_digest"), F.col("licence").alias("_licence"))
    names = if_small(names, 128 + F.length("_licence"))
    return restore(found.drop("stack", "plain").join(names, "_digest", "left"), "_n_words", "_digest", "_licence", "_contained")


def report(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"))
    inside = F.when(F.size("_contained") > 0, F.array_join("_contained", ","))
    return found.select("doc_id", F.col("_n_words").cast("long").alias("n_words"), F.col("_digest").alias("digest"), F.col("_licence").alias("licence"), inside.alias("contained"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql() -> str:
    def stack(text: str) -> str:
        clean = f"regexp_replace(regexp_replace(regexp_replace(lower({text}), {_literal(COPYRIGHT)}, ' ', 'g'), {_literal(RESERVED)}, ' ', 'g'), {_literal(SEPARATORS)}, ' ', 'g')"
        return f"regexp_replace({clean}, ' *' || chr(10) || ' *', chr(10), 'g')"

    def flat(stack_: str) -> str:
        return f"trim(regexp_replace({stack_}, '[ ' || chr(10) || ']+', ' ', 'g'), ' ')"

    def form(text: str) -> str:
        apart = f"' ' || replace({text}, ' ', '  ') || ' '"
        for a, b in SPELLINGS.items():
            apart = f"replace({apart}, ' {a} ', ' {b} ')"
        return f"sha256(trim(replace({apart}, '  ', ' '), ' '))"

    blocks = "list_transform(regexp_split_to_array(stack, chr(10) || chr(10) || '+'), lambda p: trim(replace(p, chr(10), ' '), ' '))"
    lines = "list_transform(string_split(stack, chr(10)), lambda p: trim(p, ' '))"
    total = "CASE WHEN plain = '' THEN 0 ELSE length(plain) - length(replace(plain, ' ', '')) + 1 END"
    values = ", ".join(f"({i}, {_literal(n)}, {_literal(t)})" for i, (n, t) in enumerate(LICENCES))
    return f"""
WITH k(i, licence, text) AS (VALUES {values}),
ks AS (SELECT i, licence, {stack("text")} AS stack FROM k),
kd AS (SELECT digest, min(licence) AS licence FROM (SELECT licence, {form("plain")} AS digest FROM (SELECT licence, {flat("stack")} AS plain FROM ks)) GROUP BY digest),
kp AS (SELECT DISTINCT i, licence, {form("part")} AS digest FROM (SELECT i, licence, unnest({blocks}) AS part FROM ks) WHERE part <> ''),
kn AS (SELECT i, licence, count(*) AS n FROM kp GROUP BY i, licence),
wider AS (
  SELECT DISTINCT a.licence, b.licence AS other FROM (
    SELECT x.i, y.i AS j, count(*) AS n FROM kp x JOIN kp y ON x.digest = y.digest AND x.licence <> y.licence GROUP BY x.i, y.i
  ) s JOIN kn a ON a.i = s.i JOIN kn b ON b.i = s.j WHERE s.n = a.n AND b.n > a.n
),
d AS (SELECT doc_id, {stack("text")} AS stack FROM documents),
n AS (SELECT doc_id, plain, {total} AS n_words FROM (SELECT doc_id, {flat("stack")} AS plain FROM d)),
f AS (SELECT doc_id, n_words, CASE WHEN n_words > 0 THEN {form("plain")} END AS digest FROM n),
p AS (SELECT doc_id, {form("part")} AS digest FROM (SELECT doc_id, unnest(list_distinct(list_concat({blocks}, {lines}))) AS part FROM d) WHERE part <> ''),
h AS (
  SELECT DISTINCT doc_id, s.licence FROM (SELECT p.doc_id, kp.i, kp.licence, count(DISTINCT kp.digest) AS n FROM p JOIN kp ON p.digest = kp.digest GROUP BY p.doc_id, kp.i, kp.licence) s JOIN kn ON kn.i = s.i AND kn.n = s.n
),
c AS (
  SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS contained FROM h
  WHERE NOT EXISTS (SELECT 1 FROM wider w JOIN h o ON o.licence = w.other WHERE w.licence = h.licence AND o.doc_id = h.doc_id) GROUP BY doc_id
)
SELECT f.doc_id, CAST(f.n_words AS BIGINT) AS n_words, f.digest, kd.licence, c.contained FROM f LEFT JOIN kd ON f.digest = kd.digest LEFT JOIN c ON c.doc_id = f.doc_id
"""


SQL = _sql()
