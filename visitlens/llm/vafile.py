"""Exact top-k search by a vector-approximation file.

The approximation file holds a byte for each component of a vector: the number of one of 256 cells, which a block of
vectors cuts the range of that component into.  It is written apart from the exact integers.  Queries come in
blocks of bounded size, which are sent to the tasks; a scan of the cells bounds every inner product from both sides.
The file is scanned in rounds of growing size: the k-th best lower bound that the rounds before have found is
carried into the next, and only vectors whose upper bound reaches it become candidates.  The exact vectors of
candidates are then read in the order of their upper bounds, until that of the next is below the k-th exact score.

Vectors alike are one entry of the file, with the few least vec_ids that could be in a result, so that copies,
which all tie, cost no more than one vector.  Neither vectors nor cells move after they are written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.llm.common import SECOND_SEED, Scratch

SCALE = 256
#: Vectors of a block of cells, at most, and queries that a task compares with a block at a time.
BLOCK, TOGETHER = 4096, 256
#: Bytes of queries that are sent to every executor, on average at most.
QUERY_BYTES = 4 << 20
#: A round scans so many times as many vectors as the one before; the first about a block.
GROWTH = 8
#: Exact vectors that a query reads first; later reads are larger.
READ = 16
_RESULT = "query_id long, rank int, vec_id long, score long"


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and ``q``, the floor of ``scale`` times each component, of the usable vectors."""
    kept = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    return kept.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * float(scale)).cast("long")).alias("q"))


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """(q, ids): each distinct vector with the vec_ids that can be in a result.

    These are its k + 1 least (one may be the query's own), each as often as it occurs, k times at most.  Ranks are
    limited before rows move, so a vector with a third of all rows is no larger than others.
    """
    keyed = vectors.withColumn("h1", F.xxhash64("q")).withColumn("h2", F.xxhash64("q", F.lit(SECOND_SEED)))
    copy = F.row_number().over(Window.partitionBy("h1", "h2", "vec_id").orderBy("h1"))
    few = keyed.withColumn("copy", copy).where(F.col("copy") <= k)
    place = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    fewer = few.withColumn("place", place).where(F.col("place") <= k + 1)
    return fewer.groupBy("h1", "h2").agg(F.first("q").alias("q"), F.array_sort(F.collect_list("vec_id")).alias("ids")).select("q", "ids")


def approximate(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """The approximation file of (entry, round, ids, q): blocks of at most ``size`` vectors of one round and dimension.

    A block has its cells (n x dim bytes), the lower end and the width of the cells of each component, the entries, and
    the sole vec_id of each entry that has only one.
    """

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list] = {}

        def block(key: tuple[int, int]) -> pd.DataFrame:
            part = held.pop(key)
            q = np.array([x[2] for x in part], dtype=np.int64).reshape(len(part), key[1])
            low, width, cells = cut(q)
            sole = np.array([(1, x[1][0]) if x[1][0] == x[1][-1] else (0, 0) for x in part], dtype=np.int64)
            return pd.DataFrame([(key[0], key[1], np.array([x[0] for x in part], dtype=np.int64).tobytes(), sole.tobytes(), low.tobytes(), width.tobytes(), cells.tobytes())], columns=names)

        for batch in batches:
            for entry, round_, ids, q in zip(batch["entry"], batch["round"], batch["ids"], batch["q"], strict=True):
                key = (int(round_), len(q))
                held.setdefault(key, []).append((entry, ids, q))
                if len(held[key]) >= size:
                    yield block(key)
        for key in list(held):
            yield block(key)

    names = ["round", "dim", "entries", "sole", "low", "width", "cells"]
    return rows.select("entry", "round", "ids", "q").mapInPandas(fill, "round int, dim int, entries binary, sole binary, low binary, width binary, cells binary")


def cut(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, width, cells) of integers: q lies in low + width * cell + [0, width)."""
    low = q.min(axis=0) if len(q) else np.zeros(q.shape[1], dtype=np.int64)
    span = q.astype(np.uint64) - low.astype(np.uint64)  # right even where int64 would overflow
    width = span.max(axis=0, initial=0) // np.uint64(256) + np.uint64(1)
    return low, width, (span // width).astype(np.uint8)


def bounds(queries: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(upper, lower) bounds of the inner products of queries and the vectors in these cells."""
    q, base, w = queries.astype(np.float64), low.astype(np.float64), width.astype(np.float64)
    size = float((np.abs(q).max(axis=0, initial=0) * (np.abs(base) + 256 * w)).sum())
    # sums of integers are exact in these types; beyond that, a margin covers the rounding
    kind = np.float32 if size < 1 << 24 else np.float64
    corner = (q * w).astype(kind) @ cells.astype(kind).T + (q @ base)[:, None].astype(kind)
    margin = size * 2.0**-40 if size >= 1 << 53 else 0.0
    upper = corner + (np.maximum(q, 0) @ (w - 1) + margin)[:, None]
    return upper, corner + (np.minimum(q, 0) @ (w - 1) - margin)[:, None]


def scan_block(queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, block: tuple, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, vector, upper, lower) of the candidates of a block, by places in it; ``least`` is a bound of the k-th score so far."""
    sole, low, width, cells = block
    for first in range(0, len(queries), TOGETHER):
        some = slice(first, first + TOGETHER)
        upper, lower = bounds(queries[some], low, width, cells)
        own = (sole[:, 0] == 1) & (query_ids[some, None] == sole[:, 1])
        lower = np.where(own, -np.inf, lower)
        kth = np.partition(lower, len(sole) - k, axis=1)[:, len(sole) - k] if len(sole) >= k else np.full(len(lower), -np.inf)
        q, v = np.nonzero(~own & (upper >= np.maximum(kth, least[some])[:, None]))
        yield q + first, v, upper[q, v], lower[q, v]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors with the largest inner product for each query.

    Both frames have vec_id and embedding; other columns aren't read, so their names don't matter.  A query never finds
    its own vec_id; ties go to the smaller vec_id; fewer than k others give fewer rows.  Vectors that are null, or
    hold null or non-finite components, take no part, as a row without a vec_id; vectors of different length don't
    meet; very long vectors are compared whole; rows repeated in full are found each, with ranks of their own, but asked
    once.  A score beyond a long is the nearest long.  Empty tables give no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vafile")
    exact = scratch.save(entries(quantised(vectors), k).withColumn("entry", F.monotonically_increasing_id()), "exact")
    n = exact.count()
    rounds = 1 + max(0, math.ceil(math.log(max(1, n / block), GROWTH)))
    # round r has GROWTH ** r parts of all
    ends = np.cumsum([GROWTH**r for r in range(rounds)])
    share = F.pmod(F.xxhash64("entry"), F.lit(int(ends[-1])))
    round_ = F.lit(0)
    for e in ends[:-1].tolist():
        round_ = round_ + (share >= e).cast("int")
    cells = scratch.save(approximate(exact.withColumn("round", round_), block), "cells", by="round")
    asked = quantised(queries).dropDuplicates(["vec_id", "q"])
    size = asked.agg(F.sum(F.size("q") * 8 + 16)).first()[0] or 0
    blocks = max(1, -(-size // query_bytes))
    dealt = scratch.save(asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "q"), F.lit(blocks))), "queries", by="block")
    found = [_search(dealt.where(F.col("block") == b), exact, cells, rounds, k, scratch) for b in range(blocks)]
    out = spark.createDataFrame([], _RESULT)
    for x in found:
        out = out.unionByName(x)
    return out


def _search(queries: DataFrame, exact: DataFrame, cells: DataFrame, rounds: int, k: int, scratch: Scratch) -> DataFrame:
    """The results of one block of queries, which fits in the memory of the driver and of every task."""
    spark = queries.sparkSession
    by_dim: dict[int, list] = {}
    for r in queries.select("vec_id", "q").collect():  # about QUERY_BYTES
        by_dim.setdefault(len(r.q), []).append((r.vec_id, r.q))
    packed, numbered_, at = {}, [], 0
    for dim, rows in sorted(by_dim.items()):
        packed[dim] = (at, np.array([i for i, _ in rows], dtype=np.int64), np.array([q for _, q in rows], dtype=np.int64).reshape(len(rows), dim))
        numbered_ += [(at + j, i, q) for j, (i, q) in enumerate(rows)]
        at += len(rows)
    if not at:
        return spark.createDataFrame([], _RESULT)
    least = np.full(at, -np.inf)
    candidates: DataFrame | None = None
    for r in range(rounds):
        sent = spark.sparkContext.broadcast((packed, least))
        new = scratch.save(_scan(cells.where(F.col("round") == r), sent, k), "candidates")
        sent.destroy()
        candidates = new if candidates is None else candidates.unionByName(new)
        least = np.maximum(least, _kth(candidates, "lower", k, at))
    bound = spark.createDataFrame(list(enumerate(least.tolist())), "query int, least double")
    order = Window.partitionBy("query").orderBy(F.desc("upper"), "entry")
    kept = candidates.join(F.broadcast(bound), "query").where("upper >= least").select("query", "entry", "upper")
    ordered = scratch.save(kept.withColumn("place", F.row_number().over(order)), "ordered")
    asked = F.broadcast(spark.createDataFrame(numbered_, "query int, query_id long, asked array<long>"))
    exactly = F.aggregate(F.zip_with("q", "asked", lambda a, b: F.try_multiply(a, b)), F.lit(0).cast("long"), lambda x, y: F.try_add(x, y))
    about = F.aggregate(F.zip_with("q", "asked", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda x, y: x + y)
    product = F.coalesce(exactly, F.when(about < 0, F.lit(-(2**63))).otherwise(F.lit(2**63 - 1)))
    scored, done, read = None, 0, READ
    while True:
        bound = F.broadcast(spark.createDataFrame(list(enumerate(least.tolist())), "query int, least double"))
        more = ordered.where(F.col("place") > done).join(bound, "query").where("upper >= least")
        if scored is not None and more.isEmpty():
            break
        next_ = more.where(F.col("place") <= done + read).select("query", "entry").join(exact, "entry").join(asked, "query")
        next_ = scratch.save(next_.select("query", "query_id", "ids", product.alias("score")), "scored")
        scored = next_ if scored is None else scored.unionByName(next_)
        # no vector beyond this one is certain to be left out before its bound is below the k-th exact score
        least = np.maximum(least, _kth(scored, "score", k, at))
        done, read = done + read, read * 4
    pairs = scored.select("query", "query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _kth(rows: DataFrame, column: str, k: int, n: int) -> np.ndarray:
    """The k-th largest value of ``column`` for each of ``n`` queries, as each row is one vector at least."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("v")))
    out = np.full(n, -np.inf)
    for r in rows.select("query", F.col(column).cast("double").alias("v")).withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).collect():
        out[r.query] = r.v * (1 + 1e-15 * np.sign(-r.v)) if abs(r.v) >= 1 << 53 else r.v
    return out


def _scan(cells: DataFrame, sent, k: int) -> DataFrame:
    """(query, entry, upper, lower) of the candidates in a round's cells."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed, least = sent.value
        for batch in batches:
            for dim, entry, sole, low, width, codes in batch.itertuples(index=False):
                if dim not in packed:
                    continue
                first, ids, queries = packed[dim]
                entry = np.frombuffer(entry, dtype=np.int64)
                block = (np.frombuffer(sole, dtype=np.int64).reshape(-1, 2), np.frombuffer(low, dtype=np.int64), np.frombuffer(width, dtype=np.uint64), np.frombuffer(codes, dtype=np.uint8).reshape(len(entry), dim))
                for q, v, upper, lower in scan_block(queries, ids, least[first : first + len(ids)], block, k):
                    yield pd.DataFrame({"query": (q + first).astype(np.int32), "entry": entry[v], "upper": upper.astype(np.float64), "lower": lower.astype(np.float64)})

    return cells.select("dim", "entries", "sole", "low", "width", "cells").mapInPandas(scan, "query int, entry long, upper double, lower double")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
