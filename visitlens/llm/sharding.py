"""Sharding by fixed virtual slots.

Every record is hashed into one of a fixed number of virtual slots; the bytes of each slot are
summed; a versioned map sends slots to shards.  Balancing or growing the cluster edits the map and
never rehashes a record.  The map has ``n_slots`` entries whatever the size of the corpus, so it is
gathered on the driver, stored with its version in the shared folder, and broadcast from there.

Texts alike share a slot, and so a shard.  Only a text whose copies alone take more than half of a shard's
fair share of bytes is dealt over several slots, in pieces of that size: kept whole it would make its
shard larger than the others.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from visitlens.llm.common import SECOND_SEED, Scratch, numbered, shield

N_SLOTS = 8192
ROW_OVERHEAD = 16
#: Shards are balanced when the largest and the smallest differ by no more than this part of the mean.
TOLERANCE = 0.001
#: A text is whole up to this part of a shard's fair share.
WHOLE = 0.5
#: Rows that are numbered within one task, about.
ROWS_A_TASK = 50_000
MAP_SCHEMA = T.StructType(
    [
        T.StructField("version", T.IntegerType(), False),
        T.StructField("n_shards", T.IntegerType(), False),
        T.StructField("virtual_slot", T.IntegerType(), False),
        T.StructField("shard", T.IntegerType(), False),
    ]
)


@dataclass
class SlotMap:
    """One version of a slot-to-shard map; editing it makes the next version."""

    n_shards: int
    version: int
    current: list[int]

    @classmethod
    def initial(cls, n_slots: int, n_shards: int) -> SlotMap:
        return cls(n_shards, 1, [s * n_shards // n_slots for s in range(n_slots)])

    def rebalance(self, slot_bytes: dict[int, int], n_shards: int | None = None) -> int:
        """Edit the map until shard sizes are near equal; return the number of slots moved.

        Slots go, one by one, from the fullest shard to the emptiest, always the slot whose size is
        nearest to half of their difference; where no single slot helps, two slots change places.  Every move
        lowers the sum of squared sizes, so it ends: within TOLERANCE, or where no move helps any more.
        """
        self.n_shards = n_shards or self.n_shards
        shard_of = list(self.current)
        held: list[list[tuple[int, int]]] = [[] for _ in range(max(self.n_shards, max(shard_of) + 1))]
        for slot, shard in enumerate(shard_of):
            if slot_bytes.get(slot, 0):
                held[shard].append((slot_bytes[slot], slot))
        loads = [sum(b for b, _ in x) for x in held]
        for x in held:
            x.sort()

        def nearest(items, want, below):
            at = bisect.bisect_left(items, (want, -1))
            near = [items[i] for i in (at - 1, at) if 0 <= i < len(items) and 0 < items[i][0] < below]
            return min(near, key=lambda i: abs(i[0] - want), default=None)

        def move(item, a, b):
            held[a].remove(item)
            bisect.insort(held[b], item)
            loads[a] -= item[0]
            loads[b] += item[0]
            shard_of[item[1]] = b

        for gone in range(self.n_shards, len(held)):  # shards that are no more
            for item in list(held[gone]):
                move(item, gone, min(range(self.n_shards), key=lambda s: (loads[s], s)))
        for slot, shard in enumerate(shard_of):
            if shard >= self.n_shards:
                shard_of[slot] = slot % self.n_shards
        tolerance = TOLERANCE * sum(loads) / self.n_shards
        while True:
            hi = max(range(self.n_shards), key=lambda s: (loads[s], -s))
            lo = min(range(self.n_shards), key=lambda s: (loads[s], s))
            gap = loads[hi] - loads[lo]
            if gap <= tolerance:
                break
            if item := nearest(held[hi], gap // 2, gap):
                move(item, hi, lo)
                continue
            best = None
            for mine in held[lo]:
                other = nearest([(b - mine[0], s) for b, s in held[hi] if b > mine[0]], gap // 2, gap)
                if other and (best is None or abs(other[0] - gap / 2) < best[0]):
                    best = (abs(other[0] - gap / 2), (other[0] + mine[0], other[1]), mine)
            if best is None:
                break
            move(best[1], hi, lo)
            move(best[2], lo, hi)
        moved = sum(a != b for a, b in zip(shard_of, self.current, strict=True))
        self.current, self.version = shard_of, self.version + 1
        return moved

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.n_shards, slot, shard) for slot, shard in enumerate(self.current)]
        return spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1)

    def store(self, spark: SparkSession, path: str) -> None:
        """Add this version to the table; other versions stay as they are, the same version is written anew."""
        self.frame(spark).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given version, else the last; no other version is read."""
        held = spark.read.parquet(path)
        if version is None:
            version = held.agg(F.max("version")).first()[0]
        rows = sorted((r.virtual_slot, r.shard, r.n_shards) for r in held.where(F.col("version") == version).collect())
        if not rows:
            raise LookupError(f"no version {version} of the map in {path}")
        return cls(rows[0][2], version, [shard for _, shard, _ in rows])


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")) + F.lit(ROW_OVERHEAD)


def _text_key(docs: DataFrame) -> list[Column]:
    """128 bits of the text; of the doc_id, where the text is null."""
    what = F.coalesce(docs["text"], F.concat(F.lit("null text of "), F.coalesce(docs["doc_id"].cast("string"), F.lit("null"))))
    return [F.xxhash64(what).alias("k1"), F.xxhash64(what, F.lit(SECOND_SEED)).alias("k2")]


@dataclass
class Slots:
    """Where records go: the map, the texts that are dealt over several slots, and rows by slot."""

    map: SlotMap
    split: list[tuple[int, int, int]]
    rows: dict[int, int]
    n_slots: int

    def virtual_slot(self, docs: DataFrame, rid: str) -> DataFrame:
        """``docs`` with ``virtual_slot``: by the text alone, or by text and row number for a split text."""
        key = _text_key(docs)
        keyed = docs.withColumn("k1__", key[0]).withColumn("k2__", key[1])
        if self.split:  # at most n_shards / WHOLE texts
            split = docs.sparkSession.createDataFrame(self.split, "k1__ long, k2__ long, pieces__ int")
            keyed = keyed.join(F.broadcast(split), ["k1__", "k2__"], "left")
            piece = F.coalesce(F.pmod(F.xxhash64(rid), F.col("pieces__")), F.lit(0))
        else:
            piece = F.lit(0).cast("long")
        # piece 0 is where the whole text would be
        at = F.when(piece == 0, F.col("k1__")).otherwise(F.xxhash64("k1__", piece))
        return keyed.withColumn("virtual_slot", F.pmod(at, F.lit(self.n_slots)).cast("int")).select(*docs.columns, "virtual_slot")


def fit_map(docs: DataFrame, n_shards: int, n_slots: int = N_SLOTS, known: SlotMap | None = None, rid: str = "rid") -> Slots:
    """The map for these records, edited from ``known`` (or from the even initial map), and the rows of each slot."""
    sized = docs.select(*_text_key(docs), size_of(docs["text"]).alias("size"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    share = max(1.0, WHOLE * total / n_shards)
    heavy = sized.groupBy("k1", "k2").agg(F.sum("size").alias("size"), F.count("*").alias("n")).where((F.col("size") > share) & (F.col("n") > 1))
    split = [(r.k1, r.k2, int(-(-r["size"] // share))) for r in heavy.collect()]  # fewer than n_shards / WHOLE rows
    out = Slots(known or SlotMap.initial(n_slots, n_shards), split, {}, n_slots)
    keyed = out.virtual_slot(docs, rid)
    sums = keyed.groupBy("virtual_slot").agg(F.sum(size_of(keyed["text"])).alias("bytes"), F.count("*").alias("rows")).collect()  # at most n_slots rows
    out.map.rebalance({r.virtual_slot: r.bytes for r in sums}, n_shards)
    out.rows = {r.virtual_slot: r["rows"] for r in sums}
    return out


def _stored(spark: SparkSession, slots: SlotMap, store: str | None) -> DataFrame:
    """The map's rows, read from where they are kept."""
    store = store or Scratch(spark, "slots").base
    slots.store(spark, store)
    return spark.read.parquet(store).where(F.col("version") == slots.version).select("virtual_slot", "shard")


def assign(docs: DataFrame, n_shards: int, n_slots: int = N_SLOTS, known: SlotMap | None = None, store: str | None = None) -> DataFrame:
    """``docs`` with ``virtual_slot``, ``map_version`` and ``shard``, which replace columns of these names.

    The map is fitted on ``docs`` (edited from ``known``, if given) and kept under ``store``.  Null and empty texts
    count ROW_OVERHEAD bytes; a null text goes by its doc_id; rows alike share a slot unless their text is split.
    Very long texts are one record each; an empty table stays empty.
    """
    safe, restore = shield(docs)
    rows = numbered(safe, Scratch(docs.sparkSession, "rows"))
    slots = fit_map(rows, n_shards, n_slots, known)
    placed = slots.virtual_slot(rows, "rid").join(F.broadcast(_stored(docs.sparkSession, slots.map, store)), "virtual_slot")
    return restore(placed.withColumn("map_version", F.lit(slots.map.version)), "virtual_slot", "map_version", "shard")


def shard_documents(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS, store: str | None = None) -> DataFrame:
    """Place of every document: shard and, within it, a gapless position ``slot``.

    Law ``bytes``: shard sizes (UTF-8 bytes of the text, null none, plus 16 a row) are near equal.  Equal texts
    share a shard, unless their copies take more than half of a shard's share of all bytes.  Null texts count 16
    bytes, have a null checksum and go by their doc_id; rows repeated in full are records of their own, with
    places of their own.  Very long texts are one record each.  An empty table gives no rows; columns other than
    doc_id and text are not read.
    """
    spark = docs.sparkSession
    rows = numbered(docs.select("doc_id", "text"), Scratch(spark, "rows"))
    slots = fit_map(rows, n_shards, n_slots)
    shards = _stored(spark, slots.map, store)
    counts = spark.createDataFrame([(s, -(-n // ROWS_A_TASK)) for s, n in sorted(slots.rows.items())], "virtual_slot int, subs int")  # at most n_slots rows
    lookup = F.broadcast(shards.join(counts, "virtual_slot"))
    # a slot of many rows is numbered in several parts
    placed = slots.virtual_slot(rows, "rid").join(lookup, "virtual_slot").withColumn("sub", F.pmod(F.xxhash64("rid"), F.col("subs")))
    placed = placed.select("doc_id", size_of(F.col("text")).alias("size"), F.crc32("text").alias("text_crc32"), "shard", "virtual_slot", "sub", "rid")
    per = placed.groupBy("shard", "virtual_slot", "sub").agg(F.count("*").alias("n"))
    ahead = per.select("virtual_slot", "sub", (F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot", "sub")) - F.col("n")).alias("base"))
    order = Window.partitionBy("virtual_slot", "sub").orderBy(F.col("doc_id").asc_nulls_last(), "rid")
    return (
        placed.withColumn("place", F.row_number().over(order))
        .join(ahead, ["virtual_slot", "sub"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("base") + F.col("place") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
            F.lit(slots.map.version).alias("map_version"),
        )
    )
