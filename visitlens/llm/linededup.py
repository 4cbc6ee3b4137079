"""Line dedup by a suffix array over line-ID sequences, in DataFrame operations only.

Each line is an ID, each document a sequence of IDs.  Prefix doubling ranks all suffixes by their first 1,
2, 4, ... lines: a suffix's next rank is the rank of the pair (rank here, rank that many lines on), found by
sorting the distinct pairs over all machines.  A suffix leaves when its prefix is unique; doubling ends when no
rank is shared.  The suffixes of one rank are an interval of the suffix array whose longest common prefix is
at least that long.

For every suffix the longest prefix that also occurs earlier in the corpus follows from these ranks: the last
doubling with an earlier suffix of the same rank gives its highest power of two, and each smaller power is
added where an earlier suffix of the interval found so far goes on with the same rank.  So every such suffix
ends in the deepest longest-common-prefix interval in which it isn't the first.  Runs that no longer run
contains are the maximal repeated runs; these later copies are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.llm.common import SECOND_SEED, Scratch, numbered, shield

#: Lines and words of a run, at least; a run of fewer words says too little to be taken for a copy.
MIN_LINES, MIN_WORDS = 1, 5
WORD = r"[^\x20\x09-\x0D]+"
_PLACE = ("rid", "doc_id", "pos")


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "pos")


def _earliest(place: str) -> Column:
    """Whether this row is the one at ``place``."""
    return (F.col(f"{place}.rid") == F.col("rid")) & (F.col(f"{place}.pos") == F.col("pos"))


def _ranked(keys: DataFrame, names: list[str], scratch: Scratch) -> DataFrame:
    """The keys that several suffixes have, with ranks in their order (gaps don't matter) and the place of the first."""
    several = keys.groupBy(*names).agg(F.count("*").alias("n"), F.min(_place()).alias("first")).where("n > 1").drop("n")
    return scratch.save(several.orderBy(*names).withColumn("next_rank", F.monotonically_increasing_id()), "ranks")


def _joined(keys: DataFrame, names: list[str], scratch: Scratch) -> DataFrame:
    """(rid, doc_id, pos, rank, copy) of the suffixes that share a rank; ``copy`` where it isn't the first."""
    ranks = _ranked(keys, names, scratch)
    out = keys.join(ranks, names).select(*_PLACE, F.col("next_rank").alias("rank"), (~_earliest("first")).alias("copy"))
    out = scratch.save(out, "suffixes")
    scratch.drop(ranks)
    return out


def suffix_ranks(lines: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """For 1, 2, 4, ... lines the suffixes whose prefix of that length is shared, ranked by it."""
    levels = [_joined(lines, ["id", "id2"], scratch)]
    while not levels[-1].isEmpty():
        step = 1 << (len(levels) - 1)
        ahead = Window.partitionBy("rid").orderBy(F.col("pos").cast("long")).rangeBetween(step, step)
        pairs = scratch.save(levels[-1].withColumn("later", F.first("rank").over(ahead)).where("later IS NOT NULL").drop("copy"), "pairs")
        levels.append(_joined(pairs, ["rank", "later"], scratch))
        scratch.drop(pairs)
    return levels[:-1]


def longest_earlier(levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(rid, pos, n): for each suffix with an earlier copy of some of its lines, the most lines."""
    found: list[DataFrame] = []
    carried: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        copies = levels[k].where("copy")
        if k + 1 < len(levels):
            copies = copies.join(levels[k + 1].where("copy").select("rid", "pos"), ["rid", "pos"], "left_anti")
        if k == 0:
            found.append(copies.select("rid", "pos", F.lit(1).alias("n")))
            break
        # suffixes in question, with all that share their rank as possible earlier copies
        asked = scratch.save(copies.select("rid", "pos", "rank"), "asked")
        if carried is None and asked.isEmpty():
            continue
        classes = scratch.save(asked.select("rank").distinct(), "classes")
        marked = levels[k].join(classes, "rank").join(asked.select("rid", "pos", F.lit(True).alias("asked")), ["rid", "pos"], "left")
        fresh = marked.select(*_PLACE, F.lit(1 << k).alias("n"), F.col("rank").alias("interval"), F.coalesce("asked", F.lit(False)).alias("asked"))
        now = scratch.save(fresh if carried is None else carried.unionByName(fresh), "now")
        scratch.drop(asked, classes, *([] if carried is None else [carried]))
        carried = _deeper(now, levels[k - 1], 1 << (k - 1), scratch)
        scratch.drop(now)
    if carried is not None:
        found.append(carried.where("asked").select("rid", "pos", "n"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _deeper(now: DataFrame, level: DataFrame, step: int, scratch: Scratch) -> DataFrame:
    """The intervals of ``now`` (place, n, interval, asked) and, ``step`` lines deeper, those in which a suffix in question still has an earlier one.

    (n, interval) names an interval: an interval is made once, in the step that gives n its lowest bit.
    """
    at = level.select("rid", F.col("pos").alias("to"), F.col("rank").alias("onward"))
    met = scratch.save(now.withColumn("to", F.col("pos") + F.col("n")).join(at, ["rid", "to"], "left").drop("to"), "met")
    names = ["n", "interval", "onward"]
    per = met.where("onward IS NOT NULL").groupBy(*names).agg(F.min(_place()).alias("first"), F.max("asked").alias("any"), F.count("*").alias("size"))
    per = scratch.save(per.where("any AND size > 1").select(*names, "first").withColumn("deeper", F.monotonically_increasing_id()), "deeper")
    moved = F.col("asked") & F.coalesce(~_earliest("first"), F.lit(False))
    split = scratch.save(met.join(per, names, "left").withColumn("moved", moved).drop("first", "onward"), "moved")
    scratch.drop(met, per)
    if step == 1:
        return split.where("asked").select(*_PLACE, F.when(F.col("moved"), F.col("n") + 1).otherwise(F.col("n")).alias("n"), "asked")
    # what nobody asks about any more leaves
    into = split.where("moved").select("deeper").distinct()
    left = split.where("asked AND NOT moved").select("n", "interval").distinct()
    deeper = split.join(into, "deeper").select(*_PLACE, (F.col("n") + step).alias("n"), F.col("deeper").alias("interval"), F.col("moved").alias("asked"))
    stay = split.join(left, ["n", "interval"]).select(*_PLACE, "n", "interval", (F.col("asked") & ~F.col("moved")).alias("asked"))
    out = scratch.save(deeper.unionByName(stay), "carried")
    scratch.drop(split)
    return out


def split_lines(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, pos, line, words, id, id2) of the lines with words; ``pos`` counts these, ``line`` all lines."""
    listed = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words"), F.xxhash64(x).alias("id"), F.xxhash64(x, F.lit(SECOND_SEED)).alias("id2")))
    parts = docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.filter(listed, lambda s: s["words"] > 0)).alias("pos", "s"))
    return parts.select(*_PLACE, "s.line", "s.words", "s.id", "s.id2")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(rid, runs): the maximal runs [first, end) of lines of each document that also occur earlier in the corpus."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.save(split_lines(docs), "lines")
    levels = suffix_ranks(lines.select(*_PLACE, "id", "id2"), scratch)
    if not levels:
        return docs.sparkSession.createDataFrame([], "rid long, runs array<struct<first:int,end:int>>")
    longest = scratch.save(longest_earlier(levels, scratch), "longest")
    scratch.drop(*levels)
    order = Window.partitionBy("rid").orderBy("pos")
    inside = (F.lag("pos").over(order) == F.col("pos") - 1) & (F.lag("n").over(order) > F.col("n"))
    maximal = longest.withColumn("inside", F.coalesce(inside, F.lit(False))).where(~F.col("inside") & (F.col("n") >= min_lines))
    runs = scratch.save(maximal.select("rid", "pos", (F.col("pos") + F.col("n") - 1).alias("last")), "runs")
    # first and last line of each run, and the words up to their ends
    upto = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))
    counted = scratch.save(lines.join(runs.select("rid").distinct(), "rid", "left_semi").select("rid", "pos", "line", "words", upto.alias("upto")), "counted")
    scratch.drop(lines, longest)
    firsts = counted.select("rid", "pos", F.col("line").alias("first"), (F.col("upto") - F.col("words")).alias("before"))
    lasts = counted.select("rid", F.col("pos").alias("last"), (F.col("line") + 1).alias("end"), "upto")
    met = runs.join(firsts, ["rid", "pos"]).join(lasts, ["rid", "last"]).where(F.col("upto") - F.col("before") >= min_words)
    return met.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("runs"))


def _kept(lines: Column, runs: Column) -> Column:
    """The lines between the runs, which are in order and of which none holds another."""

    def between(i: Column) -> Column:
        start = F.coalesce(F.get(runs, i - 1)["end"], F.lit(0))
        stop = F.coalesce(F.get(runs, i)["first"], F.size(lines))
        return F.slice(lines, start + 1, F.greatest(stop - start, F.lit(0)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), between))


def _removed(runs: Column) -> Column:
    """Lines that any of the runs covers."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(runs, start, lambda a, r: F.struct((a["n"] + r["end"] - F.greatest(r["first"], a["end"])).alias("n"), r["end"].alias("end")), lambda a: a["n"])


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later copies of repeated runs cut from ``text``, and ``runs``, what was cut (replacing such a column).

    A run is a stretch of lines, alike to the character, that occurs earlier in the corpus and that no longer such
    stretch contains; it has at least ``min_lines`` lines and ``min_words`` words.  Lines without words are no part of
    the sequence: a run goes on across them, and they are cut with it.  Runs may overlap each other, and their
    earlier copy.  Earlier is: by doc_id (null last), then by place in the table, then by line.  Null texts stay null,
    empty texts empty; texts that lose all lines become empty; rows repeated in full lose all but the first
    copy.  Very long texts are taken whole.  Other columns pass through, whatever their names; an empty table stays empty.
    """
    safe, restore = shield(docs)
    rows = numbered(safe, Scratch(docs.sparkSession, "rows"))
    met = rows.join(repeated_runs(rows.select("rid", "doc_id", "text"), min_lines, min_words), "rid", "left")
    cut = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(_kept(F.split("text", "\n"), F.col("runs")), "\n"))
    return restore(met.withColumn("text", cut), "runs")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed (lines cut), n_runs and the checksum of what is left, for every document."""
    out = dedup_lines(docs.select("doc_id", "text"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")  # noqa: E731
    return out.select("doc_id", count(_removed(F.col("runs"))).alias("n_removed"), count(F.size("runs")).alias("n_runs"), F.md5("text").alias("text_md5"))


#: Not the way above: every pair of equal lines lies on a diagonal (two documents and an offset), and what is left of
#: its stretch of that diagonal is what the later line's suffix has in common with the earlier one's.
SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS content FROM documents WHERE text IS NOT NULL
), c AS (
  SELECT *, len(regexp_extract_all(content, '[^ 	-]+')) AS words FROM l
), s AS (
  SELECT doc_id, line, content, words, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos, sum(words) OVER (PARTITION BY doc_id ORDER BY line) AS upto FROM c WHERE words > 0
), p AS (
  SELECT a.doc_id AS other, a.pos AS other_pos, b.doc_id, b.pos, b.pos - row_number() OVER (PARTITION BY a.doc_id, b.doc_id, b.pos - a.pos ORDER BY b.pos) AS stretch
  FROM s a JOIN s b ON a.content = b.content AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.pos < b.pos))
), d AS (
  SELECT doc_id, pos, max(pos) OVER (PARTITION BY other, doc_id, pos - other_pos, stretch) - pos + 1 AS n FROM p
), longest AS (
  SELECT doc_id, pos, max(n) AS n FROM d GROUP BY doc_id, pos
), m AS (
  SELECT *, lag(pos) OVER w AS pos0, lag(n) OVER w AS n0 FROM longest WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), runs AS (
  SELECT m.doc_id, f.line AS first, e.line + 1 AS stop FROM m JOIN s f ON f.doc_id = m.doc_id AND f.pos = m.pos JOIN s e ON e.doc_id = m.doc_id AND e.pos = m.pos + m.n - 1
  WHERE NOT coalesce(pos0 = m.pos - 1 AND n0 > m.n, false) AND e.upto - f.upto + f.words >= 5
), per AS (
  SELECT doc_id, count(*) AS n_runs FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT l.doc_id, l.line FROM l JOIN runs r ON r.doc_id = l.doc_id AND l.line >= r.first AND l.line < r.stop
), t AS (
  SELECT l.doc_id, count(g.line) AS n_removed, md5(coalesce(string_agg(content, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '')) AS text_md5
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id
)
SELECT doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, text_md5 FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN per USING (doc_id)
"""
