"""Near-duplicate documents by ProbMinHash.

Each shingle of a document is a Poisson process whose rate is its weight; every arrival falls into one of
the signature's components at random, and each component keeps the shingle that arrives first.  Two
documents agree in a component with the probability Jaccard similarity of their weighted shingles.  A
process stops as soon as its next arrival is later than the latest first arrival, so long documents cost
about one arrival a shingle.  Signatures are cut into bands; documents that share one are verified on
their texts, and verified links are joined into classes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.llm.candidates import classes, colliding
from visitlens.llm.common import Scratch, if_few, numbered, shield, slices
from visitlens.llm.shingles import CHUNK, fold, jaccard, mix64, numbers_of, probability_jaccard, shingle_numbers, weighted_shingles

SIMILARITY = 0.8
#: A pair at the threshold shares one of 20 bands of 4 with probability 1 - (1 - 0.8 ** 4) ** 20 > 0.99998.
BANDS, ROWS = 20, 4
#: Shingles that a verifying task remembers, since documents of a group come again and again.
HELD_SHINGLES = 1_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PART = np.uint64(0xD1B54A32D192ED03)


def signature(keys: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """The shingle that arrives first in each of ``size`` components; at least one shingle is needed."""
    first = np.full(size, np.inf)
    out = np.zeros(size, dtype=np.uint64)
    rate, time = weights.astype(np.float64), np.zeros(len(keys))
    step = 0
    while len(keys):
        # a few arrivals of every process at a time: more for short documents, which need many
        m = max(1, min(64, 3 * size // len(keys))) if step == 0 else max(1, min(64, size // len(keys)))
        numbers = (np.arange(step + 1, step + m + 1, dtype=np.uint64) * _STEP)[None, :] + keys[:, None]
        draws = mix64(numbers)
        waits = -np.log(((draws >> np.uint64(11)).astype(np.float64) + 1.0) / 9007199254740993.0) / rate[:, None]
        times = time[:, None] + np.cumsum(waits, axis=1)
        where = (mix64(draws ^ _PART) % np.uint64(size)).astype(np.int64)
        flat_t, flat_w = times.ravel(), where.ravel()
        early = np.flatnonzero(flat_t < first[flat_w])
        early = early[np.argsort(-flat_t[early], kind="stable")]  # of several, the earliest is written last
        first[flat_w[early]] = flat_t[early]
        out[flat_w[early]] = keys[early // m]
        on = times[:, -1] < first.max()
        keys, rate, time, step = keys[on], rate[on], times[on, -1], step + m
    return out


def band_numbers(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64) * _STEP
    for i in range(rows):
        out = mix64(out ^ parts[:, i]) + _PART
    return out.view(np.int64)


def words_key(text: bytes) -> bytes:
    """Of the word sequence; of the text itself, where it has no words."""
    words = b" ".join(fold(text).split()) if len(text) <= CHUNK else re.sub(rb" {2,}", b" ", fold(text)).strip(b" ")
    return b"\x02" + xxhash.xxh128_digest(words) if words else b"\x01" + xxhash.xxh128_digest(text)


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """rid, doc_id, key of the word sequence (of the text, where it has no words; null for null) and bands."""
    columns = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                numbers, counts = numbers_of(texts)
                found, at = [], 0
                for n in counts.tolist():
                    if n:
                        shingles, weights = np.unique(shingle_numbers(numbers[at : at + n]), return_counts=True)
                        found.append(band_numbers(signature(shingles, weights, bands * rows), bands, rows))
                    at += n
                offsets = np.concatenate(([0], np.cumsum(np.where(counts > 0, bands, 0))))
                flat = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
                keys = pa.array([None if t is None else words_key(t) for t in texts], type=pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(flat, type=pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), keys, lists], schema=columns)

    return docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, "rid long, doc_id long, key binary, bands array<long>")


def alike(a: tuple, b: tuple, similarity: float) -> bool:
    """Whether the probability Jaccard similarity of (shingles, weights, all weights are one) is large enough."""
    if a[2] and b[2]:  # plain Jaccard, at most the ratio of the sizes
        few, many = sorted((len(a[0]), len(b[0])))
        return few >= similarity * many and jaccard(a[0], b[0]) >= similarity
    return probability_jaccard(a[:2], b[:2]) >= similarity


def verifier(texts: DataFrame, similarity: float):
    """Keeps the pairs whose texts have at least this probability Jaccard similarity."""

    def verify(pairs: DataFrame) -> DataFrame:
        with_text = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u")
        with_text = with_text.join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
        columns = pa.schema([("u", pa.int64()), ("v", pa.int64())])

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple] = {}
            room = HELD_SHINGLES

            def shingles(node: int, text: bytes) -> tuple:
                nonlocal room
                if node not in held:
                    keys, weights = weighted_shingles(text)
                    if room < len(keys):
                        held.clear()
                        room = HELD_SHINGLES
                    room -= len(keys)
                    held[node] = (keys, weights, len(keys) == int(weights.sum()))
                return held[node]

            for batch in batches:
                for part, texts_u in slices(batch, "text_u"):
                    us, vs = part.column("u").to_pylist(), part.column("v").to_pylist()
                    texts_v = part.column("text_v").cast(pa.large_binary())
                    alike_ = [alike(shingles(u, a), shingles(v, texts_v[i].as_py() if v not in held else b""), similarity) for i, (u, v, a) in enumerate(zip(us, vs, texts_u, strict=True))]
                    yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v")], schema=columns).filter(pa.array(alike_, type=pa.bool_()))

        return with_text.select("u", "v", "text_u", "text_v").mapInArrow(keep, "u long, v long")

    return verify


def list_shingles(texts: DataFrame) -> DataFrame:
    """(node, shingle, weight) of texts (node, text)."""
    columns = pa.schema([("node", pa.int64()), ("shingle", pa.int64()), ("weight", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, some in slices(batch):
                found = [weighted_shingles(t) for t in some]
                nodes = np.repeat(part.column("node").to_numpy(), [len(k) for k, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate([k for k, _ in found]).view(np.int64)), pa.array(np.concatenate([w for _, w in found]).astype(np.int64))], schema=columns)

    return texts.select("node", "text").mapInArrow(read, "node long, shingle long, weight long")


def classify(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """rid, doc_id, class_id, class_size, kept for every document; ``docs`` has rid, doc_id and text.

    A class holds documents that a chain of links joins: the same words in the same order, or shingles at
    least ``similarity`` alike.  class_id is its least doc_id (null only if it has no other), and one document, the
    first by doc_id, then by place in the table, is ``kept``.  Texts of fewer than five words are one
    shingle.  Texts without words are alike only if equal; null texts are alike to none.  Very long texts are
    taken whole.  Rows repeated in full are of one class.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near")
    signed = scratch.save(sign(docs, bands, rows), "signed")
    # one node for each word sequence, named by the row id of its first document
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    nodes = signed.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct(order.alias("o"), "bands")).alias("f"), F.count("*").alias("n"))
    nodes = scratch.save(nodes.select("key", F.col("f.o.rid").alias("node"), F.col("f.o.doc_id").alias("doc_id"), "n", F.col("f.bands").alias("bands")), "nodes")
    members = colliding(nodes.select("node", F.explode("bands").alias("band")), scratch)
    wanted = if_few(members.select(F.col("node").alias("rid")).distinct())
    texts = scratch.save(docs.select("rid", "text").join(wanted, "rid", "left_semi").select(F.col("rid").alias("node"), "text"), "texts")
    label = classes(members, verifier(texts, similarity), lambda some: list_shingles(texts.join(some, "node", "left_semi")), similarity, scratch)
    scratch.drop(texts)
    known = scratch.save(nodes.join(label, "node", "left").select("key", "node", "doc_id", "n", F.coalesce("label", "node").alias("label")), "known")
    scratch.drop(nodes, label)
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    per = scratch.save(known.groupBy("label").agg(F.min(least).alias("first"), F.sum("n").alias("class_size")), "per")
    named = known.join(per, "label").select("key", F.col("first.doc_id").alias("class_id"), F.col("first.node").alias("first_rid"), "class_size")
    named = scratch.save(named, "named")
    scratch.drop(known, per)
    copies = signed.select("rid", "doc_id", "key").where(F.col("key").isNotNull()).join(named, "key")
    alone = signed.where(F.col("key").isNull()).select("rid", "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return copies.select("rid", "doc_id", "class_id", "class_size", (F.col("rid") == F.col("first_rid")).alias("kept")).unionByName(alone)


def remove_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each class, the one ``classify`` keeps, with the columns of ``docs``.

    Null texts all stay, as they are alike to none; of empty texts, texts without words and rows repeated in
    full one stays.  Ties go to the least doc_id (null last), then to the first row.  Columns of any name pass
    through as they are; an empty table stays empty.
    """
    safe, restore = shield(docs)
    scratch = Scratch(docs.sparkSession, "others")
    rows = numbered(safe, scratch)
    others = scratch.save(classify(rows.select("rid", "doc_id", "text")).where("NOT kept").select("rid"), "others")
    return restore(rows.join(if_few(others), "rid", "left_anti"))


def report(docs: DataFrame) -> DataFrame:
    rows = numbered(docs.select("doc_id", "text"), Scratch(docs.sparkSession, "rows"))
    return classify(rows).select("doc_id", "class_id", "class_size", "kept")
