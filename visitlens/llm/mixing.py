"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target of words; a document of a source is due ``target / source size`` copies.
The whole part is given to all, the fraction is rounded by pivotal sampling weighted by size: two
documents meet, and words are moved from one to the other, in a random direction that keeps both
expectations, until one of them is due a whole number.  The other goes on to meet the next.  Blocks of
documents do this in parallel; what is left of each block meets at the next level of a reduction tree,
so that one document per source, the root, is rounded on its own and a source misses its target by
less than its largest document.

All of it is DataFrame and SQL functions; the fold within a block is the built-in ``aggregate``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.llm.common import Scratch, if_small, numbered, shield, unit_interval

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Documents of a block on average, and at most.
BLOCK, BLOCK_MAX = 48, 96
WORD = r"[^\x20\x09-\x0D]+"

_ELEMENT = "struct<h:bigint,rid:bigint,doc_id:bigint,size:bigint,p:double>"
_DECIDED = "struct<rid:bigint,doc_id:bigint,size:bigint,up:int>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _numbered_sources(per: DataFrame, scratch: Scratch) -> DataFrame:
    """Sources with their place ``i`` in the order of names, null last; no task sees more than its part of them.

    The sorted table is written with its rows counted within each part; what precedes a part is a sum over parts.
    """
    sorted_ = scratch.save(per.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sorted")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n_part"))
    # a row for each part of the sorted table, however many sources there are
    ahead = counts.select("part", (F.sum("n_part").over(Window.orderBy("part")) - F.col("n_part")).alias("ahead"))
    return sorted_.withColumn("part", part).join(ahead, "part").withColumn("i", F.col("ahead") + within).drop("at", "part", "ahead")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """A row for each source: its size, rows and target.

    Targets are ``min(most * size, level * weight)`` with the one level that spends the total.  The level starts from
    shares by weight alone; as long as some target is above its cap, the excess of those is shared among the others.
    Each turn is one aggregation to three numbers and fills at least one more source.
    """
    scratch = Scratch(sizes.sparkSession, "targets")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights)).cast("int") + 1)
    per = _numbered_sources(per, scratch).withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    per = scratch.save(per, "sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        above = F.col("cap") <= F.lit(level) * F.col("weight")
        spent, free, now = per.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))).first()
        if now == full or not free:
            break
        level, full = (total - (spent or 0)) / free, now
    target = F.least(F.lit(level) * F.col("weight"), F.col("cap").cast("double"))
    return per.select("source", "source_size", "n", F.col("i").cast("long").alias("source_no"), F.when(above, F.col("cap").cast("double")).otherwise(target).alias("target"))


def _fold(elements: Column, level: int, seed: int) -> Column:
    """(rest, decided) of an array of elements: at each step one of the rest and the next element is decided."""

    def meet(acc: Column, e: Column) -> Column:
        rest = acc["rest"]
        u = unit_interval(e["h"], rest["h"], e["rid"], rest["rid"], F.lit(level), F.lit(seed))
        up_e, down_r = e["size"] * (1 - e["p"]), rest["size"] * rest["p"]
        down_e, up_r = e["size"] * e["p"], rest["size"] * (1 - rest["p"])
        to_e, to_r = F.least(up_e, down_r), F.least(down_e, up_r)
        gains = F.when(to_e + to_r > 0, u * (to_e + to_r) < to_r).otherwise(e["p"] >= 0.5)
        e_done = F.when(gains, up_e <= down_r).otherwise(down_e <= up_r)

        def decided(x: Column, up: Column) -> Column:
            return F.struct(x["rid"].alias("rid"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), up.cast("int").alias("up"))

        def left(x: Column, p: Column) -> Column:
            fair = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
            return F.struct(x["h"].alias("h"), x["rid"].alias("rid"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), fair.alias("p"))

        change_r = F.when(gains, -to_e).otherwise(to_r) / rest["size"]
        change_e = F.when(gains, to_e).otherwise(-to_r) / e["size"]
        new_rest = F.when(e_done, left(rest, rest["p"] + change_r)).otherwise(left(e, e["p"] + change_e))
        done = F.when(e_done, decided(e, gains)).otherwise(decided(rest, ~gains))
        met = F.struct(new_rest.cast(_ELEMENT).alias("rest"), F.concat(acc["done"], F.array(done.cast(_DECIDED))).alias("done"))
        first = F.struct(e.cast(_ELEMENT).alias("rest"), acc["done"].alias("done"))
        return F.when(rest.isNull(), first).otherwise(met)

    start = F.struct(F.lit(None).cast(_ELEMENT).alias("rest"), F.array().cast(f"array<{_DECIDED}>").alias("done"))
    return F.aggregate(elements, start, meet)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """Copies of every document: rid (its row number), doc_id, size, source_size, target, copies.

    Null and empty texts have size 0 and go into the mix as often as the whole part of their source's
    rate says; they take no words.  A null source is a source of its own, the last.  Repeated rows are
    rounded one by one.  Very long texts are counted whole.  The same table gives the same copies; an empty one none.
    Needs doc_id, text and source; other columns aren't read.
    """
    return _mix(numbered(docs.select("doc_id", "text", "source"), Scratch(docs.sparkSession, "rows")), weights, seed)


def _mix(docs: DataFrame, weights: tuple[int, ...], seed: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "mix")
    text_hash = F.xxhash64("doc_id", "text", F.lit(seed))
    sizes = scratch.save(docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), text_hash.alias("h")), "sizes")
    targets = scratch.save(source_targets(sizes, weights), "targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MAX_COPIES)))).otherwise(F.lit(0.0))
    stats = targets.withColumn("base", F.floor(rate).cast("int")).withColumn("p", rate - F.floor(rate)).withColumn("buckets", F.ceil(F.col("n") / BLOCK))
    stats = if_small(stats, 64 + F.coalesce(F.octet_length("source"), F.lit(0)))
    joined = sizes.alias("d").join(stats.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    fractional = (F.col("p") > 0) & (F.col("size") > 0)
    rows = joined.select("source_no", "base", "source_size", "target", "buckets", "h", "rid", "doc_id", "size", "p")

    whole = rows.where(~fractional).select("rid", "doc_id", "size", "source_size", "target", F.col("base").alias("copies"))
    element = F.struct("h", "rid", "doc_id", "size", "p").alias("e")
    shared = ["source_no", "base", "source_size", "target"]
    level_in = rows.where(fractional).select(*shared, "buckets", element)
    most = targets.agg(F.max("n")).first()[0] or 0
    buckets, results, level = math.ceil(most / BLOCK), [whole], 0
    while most:
        # the row's number takes part, so that rows repeated in full are dealt over all buckets
        bucket = F.pmod(F.xxhash64(F.col("e.h"), F.col("e.rid"), F.lit(level)), F.greatest(F.col("buckets"), F.lit(1)))
        dealt = level_in.withColumn("bucket", bucket)
        if buckets > 1:  # else what is left of a source meets in one block
            order = Window.partitionBy("source_no", "bucket").orderBy("e.h", "e.rid")
            dealt = dealt.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK_MAX))
        else:
            dealt = dealt.withColumn("block", F.lit(0).cast("long"))
        folded = dealt.groupBy(*shared, "buckets", "bucket", "block").agg(F.array_sort(F.collect_list("e")).alias("es"))
        folded = scratch.save(folded.select(*shared, "buckets", _fold(F.col("es"), level, seed).alias("f")), f"level{level}")
        done = folded.select(*shared, F.explode("f.done").alias("x"))
        results.append(done.select("x.rid", "x.doc_id", "x.size", "source_size", "target", (F.col("base") + F.col("x.up")).alias("copies")))
        rest = folded.select(*shared, F.ceil(F.col("buckets") / BLOCK).alias("buckets"), F.col("f.rest").alias("e"))
        if buckets <= 1:
            up = (unit_interval(F.col("e.h"), F.col("e.rid"), F.lit(seed), F.lit(-1)) < F.col("e.p")).cast("int")
            results.append(rest.select("e.rid", "e.doc_id", "e.size", "source_size", "target", (F.col("base") + up).alias("copies")))
            break
        level_in, level, buckets = rest, level + 1, math.ceil(buckets / BLOCK)
    out = results[0]
    for x in results[1:]:
        out = out.unionByName(x)
    return out


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """The mix itself: every document as often as ``mix`` says, with the columns of ``docs``.

    Null and empty texts, a null source, ties, repeated rows and an empty table are treated as ``mix`` says;
    columns of any name pass through as they are.
    """
    safe, restore = shield(docs)
    rows = numbered(safe, Scratch(docs.sparkSession, "rows"))
    copies = _mix(rows.select("rid", "doc_id", "text", "source"), weights, seed).where("copies > 0").select(F.col("rid").alias("rid2"), "copies")
    return restore(rows.join(copies, F.col("rid") == F.col("rid2")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
