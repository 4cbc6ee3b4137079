"""From signatures to classes: what colliding bands, verification and components have in common.

Members of a colliding band are not paired with each other.  Each band's members first meet its hub, the
member that shares most bands; what that verifies is joined into components.  A second round does the
same for those outside the band's largest component.  In the end all pairs across components
that can be alike enough are verified, so no link between components is lost, while a
large group of copies costs about one verification a member.

Which pairs can be alike is bounded from what each has alone: shingles that no other candidate has are in no
intersection, and of the others two documents differ by at least the differences of their counts in blocks.
So variants of one text that each have edits of their own meet only where they can be alike.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import Scratch
from visitlens.llm.components import components

#: Rounds of hubs before all pairs across components are verified.
ROUNDS = 2
#: Blocks that shared shingles are counted in, to bound how many two nodes have in common.
BLOCKS = 128


def colliding(bands: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows (node, band) whose band has another node."""
    # min and max differ where there are two nodes; partial aggregates keep hot bands small
    shared = scratch.save(bands.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("band"), "shared")
    members = scratch.save(bands.join(shared, "band").select("node", "band").distinct(), "members")
    scratch.drop(shared)
    return members


def profiles(shingles: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, n, e, plain, counts) from (node, shingle, weight).

    n is the total weight, e the weight of the shingles that another of the nodes has too, plain whether
    all weights are one, and counts how many of those shared shingles fall into each of BLOCKS blocks.
    """
    shingles = scratch.save(shingles, "shingles")
    shared = scratch.save(shingles.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1").select("shingle"), "known")
    block = F.pmod(F.xxhash64("shingle"), F.lit(BLOCKS)).cast("int")
    both = shingles.join(shared, "shingle").groupBy("node").agg(F.sum("weight").alias("e"), F.collect_list(block).alias("blocks"))

    @F.pandas_udf("array<int>")
    def count(blocks: pd.Series) -> pd.Series:
        return pd.Series([np.bincount(np.asarray(b, dtype=np.int64), minlength=BLOCKS).astype(np.int32) for b in blocks], dtype=object)

    per = shingles.groupBy("node").agg(F.sum("weight").alias("n"), (F.max("weight") == 1).alias("plain"))
    out = both.select("node", "e", count("blocks").alias("counts")).join(per, "node").select("node", "n", "e", "plain", "counts")
    out = scratch.save(out, "profiles")
    scratch.drop(shingles, shared)
    return out


def can_be_alike(similarity: float, also: Column) -> Column:
    """Whether the candidates (n, e, plain, counts) and (n2, ...) may reach ``similarity``, by bounds that never lose a pair; ``also`` is checked before the dearest.

    Probability Jaccard is at most the share of either side's weight that the other can have.  For plain
    sets, shingles of one side alone are in no intersection, and of the others at least the differences
    of the block counts are missing on one side.
    """
    least = F.lit(similarity - 1e-9)
    shares = (F.col("e") >= least * F.col("n")) & (F.col("e2") >= least * F.col("n2"))
    # Jaccard s of sets of n and n2 members leaves (n + n2) (1 - s) / (1 + s) members in one set only
    most = (F.col("n") + F.col("n2")) * F.lit((1 - similarity) / (1 + similarity) + 1e-9)
    alone = F.col("n") - F.col("e") + F.col("n2") - F.col("e2")
    apart = F.aggregate(F.zip_with("counts", "counts2", lambda a, b: F.abs(a - b)), F.lit(0), lambda x, y: x + y)
    plain = F.col("plain") & F.col("plain2")
    near = ~plain | (alone + F.abs(F.col("e") - F.col("e2")) <= most)
    return shares & near & also & (~plain | (alone + apart <= most))


def classes(members: DataFrame, verify: Callable[[DataFrame], DataFrame], profile: Callable[[DataFrame], DataFrame], similarity: float, scratch: Scratch) -> DataFrame:
    """(node, label) of all nodes with a verified link.

    ``verify`` keeps the pairs (u, v) that are alike enough; ``profile`` gives (node, shingle, weight) of some nodes.
    """
    first_members = members
    sizes = scratch.save(members.groupBy("band").agg(F.count("*").alias("n")), "sizes")
    degrees = scratch.save(members.join(sizes, "band").groupBy("node").agg(F.sum("n").alias("degree"), F.collect_list("band").alias("bands")), "degrees")
    members = scratch.save(members.join(degrees, "node"), "members")
    scratch.drop(first_members, sizes, degrees)
    label = members.sparkSession.createDataFrame([], "node long, label long")
    links = tried = None
    for turn in range(ROUNDS + 1):
        marked = members.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        open_, done = None, []
        if turn:
            per = marked.groupBy("band", "label").agg(F.count("*").alias("n"))
            top = per.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").select("band", "top")
            # written first: a join of two plain tables can be split where a band is hot
            top = scratch.save(top, "open")
            open_ = scratch.save(marked.join(top, "band"), "marked")
            done += [top, open_]
            if open_.isEmpty():
                scratch.drop(*done)
                break
        if turn == ROUNDS:
            weights = profiles(profile(open_.select("node").distinct()), scratch)
            able = scratch.save(open_.join(weights.where(F.col("e") >= F.lit(similarity - 1e-9) * F.col("n")), "node"), "able")
            done += [weights, able]
            other = able.select(F.col("band").alias("band2"), F.col("node").alias("v"), F.col("label").alias("other"), (F.col("label") != F.col("top")).alias("minor"), *[F.col(c).alias(f"{c}2") for c in ("n", "e", "plain", "counts", "bands")])
            mine = able.where("label <> top").select("band", F.col("node").alias("u"), "label", "n", "e", "plain", "counts", "bands")
            across = (F.col("label") != F.col("other")) & (~F.col("minor") | (F.col("u") < F.col("v")))
            # a pair meets in one of its bands only
            first = F.col("band") == F.array_min(F.array_intersect("bands", "bands2"))
            pairs = mine.join(other, (F.col("band") == F.col("band2")) & across & can_be_alike(similarity, first)).select("u", "v")
        else:
            left = marked if open_ is None else open_.where("label <> top")
            hub = left.groupBy("band").agg(F.max(F.struct("degree", (-F.col("node")).alias("least"), "label")).alias("c"))
            hub = scratch.save(hub.select("band", (-F.col("c.least")).alias("v"), F.col("c.label").alias("other")), "hubs")
            done.append(hub)
            pairs = left.join(hub, "band").where("label <> other").select(F.col("node").alias("u"), "v")
        pairs = scratch.save(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "pairs")
        scratch.drop(*done)
        if tried is not None:
            met = pairs
            pairs = scratch.save(met.join(tried, ["u", "v"], "left_anti"), "new")
            scratch.drop(met)
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = scratch.save(verify(pairs), "links")
        if found.isEmpty() and links is not None:
            continue
        links = found if links is None else links.unionByName(found)
        label = scratch.save(components(links, scratch), "labels")
    scratch.drop(members)
    return label
