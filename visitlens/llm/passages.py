"""Substring dedup by MinHash banding of paragraphs.

A paragraph is a stretch of WORDS words that begins where the text says: at the word pair with the least hash of some
SPAN pairs in a row.  Every SPAN pairs hold such a beginning, and it depends on those words alone, so a passage
has the same paragraphs wherever it is pasted, whatever sentences, lines or script it is written in.  A passage of
SPAN + WORDS words or more holds a whole paragraph for certain.

Paragraphs that share a band and whose sets of five-word shingles have an exact Jaccard similarity of SIMILARITY are joined into
classes.  WORDS words are 12 shingles, so sets that are SIMILARITY alike differ in one shingle at most (0.846): the first or
last word may be another, and all but one word of each, its head or its tail, stand in both.  So bands are only held against
each other among paragraphs that share a head or tail (see ``ends``) or, where words are repeated inside and shingles
say less of the order, all but one or two shingles (see ``set_windows``).  At other similarities paragraphs meet in whole bands and
are verified by their sets.
A passage with edits inside is found by its paragraphs between them.  Neighbours in a document are linked where another document has paragraphs of the same two classes
with the same words between them; linked paragraphs make up a run, which is followed word by word beyond its ends,
as far as another document has the same words there.  Runs of MIN_RUN words or more are repeated passages; in
every class the first paragraph is kept and the others are removed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.llm.candidates import classes, colliding
from visitlens.llm.common import Scratch, numbered, shield, slices
from visitlens.llm.components import components
from visitlens.llm.shingles import SHINGLE, fold, hash_words, mix64, numbers_of, shingle_numbers

SIMILARITY = 0.8
#: A pair at the threshold shares one of 6 bands of 2 with probability 1 - (1 - 0.8 ** 2) ** 6 = 0.998; equal ones always.
BANDS, ROWS = 6, 2
#: Words of a paragraph; word pairs in a row of which one begins a paragraph; words of a repeated passage, at least.
WORDS, SPAN, MIN_RUN = 16, 34, 50
#: Words in a row that a paragraph has once: where all are different, its shingles say its order.
GRAM = SHINGLE - 2
#: Bits for the bands of a paragraph in its sketch, and marks of its words: head or tail without repeated grams, repeated grams anywhere.
SKETCH, HEAD, TAIL, ODD = 60, 1, 2, 4

_STEP = np.uint64(0x9E3779B97F4A7C15)
_PAIR = np.uint64(0xD1B54A32D192ED03)


def _seed(i: int) -> np.uint64:
    return np.uint64(i * int(_STEP) % (1 << 64))


def _ordered(numbers: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each row's numbers in their order."""
    place = mix64(np.arange(1, numbers.shape[1] + 1, dtype=np.uint64) * _STEP + _seed(seed)) | np.uint64(1)
    return mix64((mix64(numbers ^ _seed(seed)) * place).sum(axis=1, dtype=np.uint64))


class Paragraphs(NamedTuple):
    """Paragraphs of some documents: first word, counted over all documents, and document of each."""

    starts: np.ndarray
    doc: np.ndarray


def find_starts(words: np.ndarray, counts: np.ndarray) -> Paragraphs:
    """The paragraphs of documents whose words stand in a row, ``counts`` words each."""
    doc = np.repeat(np.arange(len(counts)), counts)
    n = len(words) - SPAN  # windows of SPAN pairs
    if n <= 0:
        return Paragraphs(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
    pairs = mix64(words[:-1] * _PAIR + mix64(words[1:]))
    least = np.lib.stride_tricks.sliding_window_view(pairs, SPAN).argmin(axis=1)
    inside = doc[:n] == doc[SPAN : SPAN + n]
    starts = np.unique((np.arange(n) + least[:n])[inside])
    ends = np.cumsum(counts)
    starts = starts[starts + WORDS <= ends[doc[starts]]]
    return Paragraphs(starts, doc[starts])


def paragraph_shingles(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of shingles for each paragraph."""
    if not len(starts):
        return np.empty((0, WORDS - SHINGLE + 1), dtype=np.uint64)
    return shingle_numbers(words)[starts[:, None] + np.arange(WORDS - SHINGLE + 1)]


def paragraph_bands(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(shingles), bands), dtype=np.int64)
    for b in range(bands):
        value = np.full(len(shingles), _seed(b + 1))
        for r in range(rows):
            value = mix64(value ^ mix64(shingles ^ _seed(b * rows + r + 1)).min(axis=1, initial=~np.uint64(0)))
        out[:, b] = value.view(np.int64)
    return out


def marks_of(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """HEAD, TAIL and ODD of each paragraph."""
    width = WORDS - GRAM + 1
    if not len(starts):
        return np.empty(0, dtype=np.int8)
    grams = words[: len(words) - GRAM + 1]
    for i in range(1, GRAM):
        grams = mix64(grams * _PAIR + mix64(words[i : len(words) - GRAM + 1 + i]))
    own = grams[starts[:, None] + np.arange(width)]

    def repeats(x: np.ndarray) -> np.ndarray:
        x = np.sort(x, axis=1)
        return (x[:, 1:] == x[:, :-1]).any(axis=1)

    out = np.full(len(starts), HEAD | TAIL, dtype=np.int8)
    odd = np.flatnonzero(repeats(own))
    out[odd] = ODD + HEAD * ~repeats(own[odd, :-1]) + TAIL * ~repeats(own[odd, 1:])
    return out


def sketches(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The last bits of all bands of a paragraph in one number."""
    bits = SKETCH // bands
    values = paragraph_bands(shingles, bands, rows) & np.int64((1 << bits) - 1)
    return (values << (np.arange(bands, dtype=np.int64) * bits)).sum(axis=1)


_UNITS = pa.schema(
    [("rid", pa.int64()), ("doc_id", pa.int64()), ("seq", pa.int32()), ("first_word", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("gap", pa.int64()), ("marks", pa.int8()), ("sketch", pa.int64()), ("shingles", pa.list_(pa.int64()))]
)


def find_paragraphs(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, plain: bool = True) -> DataFrame:
    """rid, doc_id, seq (number among the document's paragraphs), first_word, k1, k2, gap (of the words up to the next), marks, sketch, shingles.

    k1 and k2 are 64 bits each of all words but the last and of all but the first; both are alike in equal paragraphs alone,
    or else in some that differ in an end word.  ``shingles``, where paragraphs are odd, are given once for the same
    paragraphs of some documents.  Unless ``plain``, all are odd and have no head or tail.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                words, counts = numbers_of(texts)
                p = find_starts(words, counts)
                heads = np.cumsum(counts) - counts
                own = words[p.starts[:, None] + np.arange(WORDS)] if len(p.starts) else np.empty((0, WORDS), dtype=np.uint64)
                # words between a paragraph and the next, by prefix sums; none where they overlap
                sums = np.concatenate(([np.uint64(0)], np.cumsum(mix64(words), dtype=np.uint64)))
                ends = p.starts + WORDS
                after = np.append(p.starts[1:], 0)
                between = np.where(after > ends, sums[after] - sums[ends], np.uint64(0))
                gap = mix64(between + (after - p.starts).astype(np.uint64) * _STEP).view(np.int64)
                shingles = paragraph_shingles(words, p.starts)
                marks = marks_of(words, p.starts) if plain else np.full(len(p.starts), ODD, dtype=np.int8)
                sketch = sketches(shingles, bands, rows) if plain else np.zeros(len(p.starts), dtype=np.int64)
                head, tail = _ordered(own[:, :-1], 1).view(np.int64), _ordered(own[:, 1:], 1).view(np.int64)
                odd = np.flatnonzero(marks & ODD)
                given = np.zeros(len(p.starts), dtype=bool)
                given[odd[np.unique(np.stack((head[odd], tail[odd])), axis=1, return_index=True)[1]]] = True
                offsets = pa.array(np.concatenate(([0], np.cumsum(given * shingles.shape[1]))).astype(np.int32), mask=np.append(~given, False))
                values = [
                    part.column("rid").take(pa.array(p.doc)),
                    part.column("doc_id").take(pa.array(p.doc)),
                    pa.array((np.arange(len(p.doc)) - np.searchsorted(p.doc, p.doc)).astype(np.int32)),
                    pa.array((p.starts - heads[p.doc]).astype(np.int32)),
                    pa.array(head),
                    pa.array(tail),
                    pa.array(gap),
                    pa.array(marks),
                    pa.array(sketch),
                    pa.ListArray.from_arrays(offsets, pa.array(shingles[given].ravel().view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(values, schema=_UNITS)

    cols = docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cols.mapInArrow(read, "rid long, doc_id long, seq int, first_word int, k1 long, k2 long, gap long, marks byte, sketch long, shingles array<long>")


def ends(nodes: DataFrame) -> DataFrame:
    """(node, sketch, window, own) of heads and tails without repeated grams.

    Such a head or tail is 11 different shingles, so sets that share it are 11/13 alike at least.  The other way round, let one
    of two different paragraphs have no gram twice.  The other's shingles are 12 that follow each other by four words; those that
    the first has, too, stand there in the same order.  So if 11 are shared, the one that isn't is at an end, and the
    others make up a head or tail of both; with 10 shared the sets are 10/13 alike at most.  For similarities above 10/13
    and up to 11/13, what is missing here are pairs of which both have a gram twice.
    """
    marked = lambda mark, key: F.when(F.col("marks").bitwiseAND(F.lit(mark).cast("byte")) > 0, F.col(key))
    windows = F.explode(F.array_compact(F.array(marked(HEAD, "k1"), marked(TAIL, "k2"))))
    return nodes.select("node", "sketch", windows.alias("window"), F.lit(True).alias("own"))


def set_windows(sets: DataFrame, similarity: float) -> DataFrame:
    """(node, sketch, window, own) of different sets of shingles (node, sketch, shingles), for a similarity above 10/13.

    Two sets of 12 at most that are so alike differ in one or two shingles: either has one other, or one of them has one or two more.
    So they share a window, which is a set without one or two of its shingles: with all sets of that size,
    or with the set that is the same in full, which owns it.
    """
    columns = pa.schema([("node", pa.int64()), ("sketch", pa.int64()), ("window", pa.int64()), ("own", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            flat, sizes = mix64(lists.flatten().to_numpy().view(np.uint64)), np.asarray(lists.value_lengths())
            heads = np.cumsum(sizes) - sizes
            for n in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == n)
                values = flat[heads[rows][:, None] + np.arange(n)]
                total = values.sum(axis=1, keepdims=True, dtype=np.uint64)
                less = total - values
                windows = [(total, 2 * n, True)]
                if n - 1 >= similarity * (n + 1):
                    windows.append((less, 2 * n + 1, True))
                if n - 1 >= similarity * n:
                    windows.append((less, 2 * (n - 1), False))
                if n - 2 >= similarity * n:
                    i, j = np.triu_indices(n, 1)
                    windows.append((less[:, i] - values[:, j], 2 * (n - 2), False))
                for sums, kind, own in windows:
                    of = pa.array(np.repeat(rows, sums.shape[1]))
                    keys = mix64(sums + _seed(kind + 1)).ravel().view(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column("node").take(of), batch.column("sketch").take(of), pa.array(keys), pa.array(np.full(len(keys), own))], schema=columns)

    return sets.select("node", "sketch", "shingles").mapInArrow(read, "node long, sketch long, window long, own boolean")


def linked(windows: DataFrame, bands: int, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) that join every (node, sketch, window, own) to the owners of its window that share a band with it."""
    bits = SKETCH // bands
    # partial aggregates keep hot windows small
    shared = windows.groupBy("window").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.max("own").alias("own")).where("a <> b AND own").select("window")
    shared = scratch.save(shared, "windows")
    band = F.explode(F.array(*[F.xxhash64("window", F.lit(b), F.shiftright("sketch", b * bits).bitwiseAND(F.lit((1 << bits) - 1))) for b in range(bands)]))
    members = scratch.save(windows.join(shared, "window").select("node", "own", band.alias("band")), "members")
    # owners of a window are alike, so one is linked to each of the others
    least = members.groupBy("band").agg(F.min(F.when(F.col("own"), F.col("node"))).alias("v"), F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b AND v IS NOT NULL").select("band", "v")
    least = scratch.save(least, "least")
    links = scratch.save(members.join(least, "band").where("node <> v").select(F.col("node").alias("u"), "v").distinct(), "links")
    scratch.drop(shared, members, least)
    return links


def shingle_sets(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, sketch, shingles) of odd paragraphs; a shingle that a paragraph has twice counts once."""
    given = units.where("shingles IS NOT NULL").groupBy("k1", "k2").agg(F.first("shingles").alias("shingles"))
    odd = nodes.where(F.col("marks").bitwiseAND(F.lit(ODD).cast("byte")) > 0).select("k1", "k2", "node", "sketch")
    return odd.join(given, ["k1", "k2"]).select("node", "sketch", F.array_sort(F.array_distinct("shingles")).alias("shingles"))


def set_bands(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """(node, band) of the paragraphs (node, shingles)."""
    width = WORDS - SHINGLE + 1
    columns = pa.schema([("node", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            sizes = np.asarray(lists.value_lengths())
            # a shorter set is filled with its last shingle: that leaves the least as they are
            at = (np.cumsum(sizes) - sizes)[:, None] + np.minimum(np.arange(width), sizes[:, None] - 1)
            found = paragraph_bands(lists.flatten().to_numpy()[at].view(np.uint64), bands, rows)
            offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], schema=columns)

    return sets.mapInArrow(read, "node long, bands array<long>").select("node", F.explode("bands").alias("band"))


def verifier(sets: DataFrame, similarity: float):
    """Keeps the pairs whose shingle sets have at least this Jaccard similarity."""

    def verify(pairs: DataFrame) -> DataFrame:
        met = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
        both = F.size(F.array_intersect("a", "b"))
        return met.where(both >= F.lit(similarity) * (F.size("a") + F.size("b") - both)).select("u", "v")

    return verify


def classified(docs: DataFrame, scratch: Scratch, similarity: float, bands: int, rows: int) -> DataFrame:
    """The paragraphs whose class lies in several documents: rid, doc_id, seq, first_word, gap, class_id, class_size, first_rid (the class's first document)."""
    plain = 10 / 13 < similarity <= 11 / 13 and bands <= SKETCH // 8
    units = scratch.save(find_paragraphs(docs, bands, rows, plain), "paragraphs")
    per = units.groupBy("k1", "k2").agg(F.min("rid").alias("low"), F.max("rid").alias("high"), F.count("*").alias("n"), F.min("marks").alias("marks"), F.min("sketch").alias("sketch"))
    # one number for each distinct paragraph
    nodes = scratch.save(per.withColumn("node", F.monotonically_increasing_id()), "nodes")
    sets = scratch.save(shingle_sets(units, nodes), "shingles")
    if plain:
        first = scratch.save(sets.groupBy("shingles").agg(F.min("node").alias("v"), F.min("sketch").alias("sketch")), "sets")
        same = sets.join(first.select("shingles", "v"), "shingles").where("node <> v").select(F.col("node").alias("u"), "v")
        met = linked(ends(nodes).unionByName(set_windows(first.withColumnRenamed("v", "node"), similarity)), bands, scratch)
        label = components(met.unionByName(same), scratch)
        scratch.drop(first, met)
    else:
        flat = sets.select("node", F.explode("shingles").alias("shingle"), F.lit(1).cast("long").alias("weight"))
        label = classes(colliding(set_bands(sets, bands, rows), scratch), verifier(sets, similarity), lambda x: flat.join(x, "node", "left_semi"), similarity, scratch)
    # a paragraph of one document alone that is like no other has no class
    known = nodes.join(label, "node", "left").where("low <> high OR label IS NOT NULL").select("k1", "k2", "low", "high", "n", F.coalesce("label", "node").alias("label"))
    known = scratch.save(known, "known")
    scratch.drop(sets, nodes)
    per = known.groupBy("label").agg(F.min("low").alias("first_rid"), F.max("high").alias("high"), F.sum("n").alias("class_size")).where("first_rid <> high")
    per = scratch.save(per.drop("high"), "per")
    several = scratch.save(known.select("k1", "k2", "label").join(per, "label").withColumnRenamed("label", "class_id"), "classes")
    scratch.drop(known, per)
    out = scratch.save(units.drop("marks", "sketch", "shingles").join(several, ["k1", "k2"]).drop("k1", "k2"), "hits")
    scratch.drop(units, several)
    return out


def repeated(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, min_run: int = MIN_RUN) -> DataFrame:
    """A row for each paragraph of a repeated passage: rid, doc_id, seq, first_word, n_words, class_id, class_size, kept, passage, passage_first_word, passage_words, cuts.

    ``docs`` has rid, doc_id and text.  A paragraph is ``kept`` in the first document of its class, by place in the table.
    ``passage`` numbers the runs of a document by their first paragraph, ``cuts`` has the words of the passage beside its
    paragraphs that an earlier document has too.  Passages repeated within one document alone are left alone, as are
    null, empty and short texts; very long ones are taken whole.  Rows repeated in full, and documents alike in doc_id
    or without one, are documents of their own.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    hits = classified(docs, scratch, similarity, bands, rows)
    at = Window.partitionBy("rid").orderBy("seq")
    joint = F.when(F.lag("seq").over(at) == F.col("seq") - 1, F.xxhash64(F.lag("class_id").over(at), F.lag("gap").over(at), "class_id"))
    pairs = hits.withColumn("joint", joint).withColumn("ahead", F.lag("first_word").over(at)).withColumn("class_ahead", F.lag("class_id").over(at))
    pairs = scratch.save(pairs.drop("gap"), "pairs")
    scratch.drop(hits)
    several = pairs.where("joint IS NOT NULL").groupBy("joint").agg(F.min("rid").alias("joint_rid"), F.max("rid").alias("high")).where("joint_rid <> high")
    several = scratch.save(several.drop("high"), "joints")
    linked = pairs.join(several, "joint", "left")
    run = linked.withColumn("run", F.sum(F.when(F.col("joint_rid").isNull(), 1).otherwise(0)).over(at)).drop("joint")
    run = scratch.save(run, "runs")
    scratch.drop(pairs, several)
    edge = F.col("first_word") + WORDS
    per = run.groupBy("rid", "run").agg(
        F.min("seq").alias("passage"),
        F.min("first_word").alias("start"),
        F.max(edge).alias("end"),
        F.min_by("class_id", "seq").alias("head"),
        F.max_by("class_id", "seq").alias("tail"),
        # words between two paragraphs that an earlier document has, too
        F.collect_list(F.when((F.col("joint_rid") != F.col("rid")) & (F.col("first_word") > F.col("ahead") + WORDS), F.struct((F.col("ahead") + WORDS).alias("a"), F.col("first_word").alias("b")))).alias("gaps"),
    )
    per = scratch.save(per, "islands")
    both = lambda start, head, end, tail: F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.expr(at_).alias("at"), F.col(c).alias("class_id")) for i, at_, c in ((0, start, head), (1, end, tail))]))
    ends = per.select("rid", "run", both("start", "head", "end", "tail").alias("e")).select("rid", "run", "e.*")
    ends = scratch.save(ends, "ends")
    # a run may end where another document's goes on: of every link, the first document shows what is beside its paragraphs
    shown = run.where(F.col("rid") == F.col("joint_rid")).select("rid", "run", both("first_word", "class_id", f"ahead + {WORDS}", "class_ahead").alias("e")).select("rid", "run", "e.*")
    shown = shown.join(ends.select("side", "class_id").distinct(), ["side", "class_id"], "left_semi")
    edges = scratch.save(ends.withColumn("own", F.lit(True)).unionByName(shown.withColumn("own", F.lit(False))).withColumn("edge", F.monotonically_increasing_id()), "edges")
    grown = edges.where("own").select("rid", "run", "side", "edge").join(extensions(docs, edges, scratch), "edge")
    by_side = grown.groupBy("rid", "run").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}{s}") for s in (0, 1) for c in ("n", "cut")])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    met = per.join(by_side, ["rid", "run"], "left").withColumn("passage_words", (F.col("end") - F.col("start") + zero("n0") + zero("n1")).cast("long")).where(F.col("passage_words") >= min_run)
    before = F.when(zero("cut0") > 0, F.struct((F.col("start") - zero("cut0")).alias("a"), F.col("start").alias("b")))
    behind = F.when(zero("cut1") > 0, F.struct(F.col("end").alias("a"), (F.col("end") + zero("cut1")).alias("b")))
    met = met.select("rid", "run", "passage", (F.col("start") - zero("n0")).cast("int").alias("passage_first_word"), "passage_words", F.concat("gaps", F.array_compact(F.array(before, behind))).alias("cuts"))
    kept = F.col("first_rid") == F.col("rid")
    return run.join(met, ["rid", "run"]).select("rid", "doc_id", "seq", "first_word", F.lit(WORDS).alias("n_words"), "class_id", "class_size", kept.alias("kept"), "passage", "passage_first_word", "passage_words", "cuts")


def extensions(docs: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(edge, n, cut) of edges (edge, rid, side, at, class_id, own): how many words on from there another document has beside the same class, and an earlier one.

    Side 0 goes back, side 1 forward, SPAN words at most: were more the same, they would hold a paragraph of the run.
    Edges that aren't a run's own only serve others.
    """
    per = edges.groupBy("rid").agg(F.collect_list(F.struct("edge", "side", "at", "class_id", "own")).alias("edges"))  # a few for each paragraph
    columns = pa.schema([("edge", pa.int64()), ("rid", pa.int64()), ("own", pa.bool_()), ("keys", pa.list_(pa.int64()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                words, counts = numbers_of(texts)
                lists = part.column("edges")
                doc = np.repeat(np.arange(len(texts)), np.asarray(lists.value_lengths()))
                flat = lists.flatten()
                side, at, label = (flat.field(k).to_numpy() for k in ("side", "at", "class_id"))
                heads = np.cumsum(counts) - counts
                size = np.minimum(np.where(side == 0, at, counts[doc] - at), SPAN)
                origin, step = heads[doc] + np.where(side == 0, at - 1, at), np.where(side == 0, -1, 1)
                begin = np.cumsum(size) - size
                which = np.repeat(np.arange(len(size)), size)
                place = np.arange(int(size.sum())) - begin[which]
                values = mix64(words[origin[which] + step[which] * place] + (place + 1).astype(np.uint64) * _STEP)
                sums = np.concatenate(([np.uint64(0)], np.cumsum(values, dtype=np.uint64)))
                seed = mix64(mix64(label.view(np.uint64)) + side.astype(np.uint64))
                keys = mix64((sums[1:] - sums[begin[which]]) ^ seed[which]).view(np.int64)
                some = np.flatnonzero(size)
                offsets = np.append(begin[some], len(keys)).astype(np.int32)
                own, edge = (flat.field(k).take(pa.array(some)) for k in ("own", "edge"))
                yield pa.RecordBatch.from_arrays([edge, part.column("rid").take(pa.array(doc[some])), own, pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))], schema=columns)

    cols = docs.select("rid", "text").join(per, "rid").select("text", "rid", "edges")
    beside = scratch.save(cols.mapInArrow(read, "edge long, rid long, own boolean, keys array<long>"), "beside")

    def shared(keys: DataFrame, name: str) -> DataFrame:
        several = keys.groupBy("key").agg(F.min("rid").alias("first"), F.max("rid").alias("last")).where("first <> last")
        return scratch.save(several.select("key", "first"), name)

    # most end at the first word
    one = shared(beside.select("rid", F.col("keys")[0].alias("key")), "one")
    some = scratch.save(beside.withColumn("key", F.col("keys")[0]).join(one.select("key"), "key").drop("key"), "some")
    scratch.drop(beside, one)
    several = shared(some.select("rid", F.explode("keys").alias("key")), "shared")
    met = some.where("own").select("edge", "rid", F.posexplode("keys").alias("n", "key")).join(several, "key").withColumn("n", F.col("n") + 1)
    out = scratch.save(met.groupBy("edge").agg(F.max("n").alias("n"), F.max(F.when(F.col("first") < F.col("rid"), F.col("n")).otherwise(0)).alias("cut")), "extended")
    scratch.drop(some, several)
    return out


def remove_passages(docs: DataFrame) -> DataFrame:
    """``docs`` without the later copies of repeated passages; documents that lose nothing keep their text as it is.

    Words of a paragraph in the first document of its class stay, even where another passage overlaps it.  What ``repeated``
    says of null, empty, very long and repeated texts holds; columns of any name pass through; an empty table stays empty.
    """
    safe, restore = shield(docs)
    rows = numbered(safe, Scratch(docs.sparkSession, "rows"))
    found = repeated(rows.select("rid", "doc_id", "text"))
    span = F.struct(F.col("first_word").alias("a"), (F.col("first_word") + F.col("n_words")).alias("b"))
    gone = found.groupBy("rid").agg(F.collect_list(F.when(~F.col("kept"), span)).alias("gone"), F.collect_list(F.when(F.col("kept"), span)).alias("stay"), F.flatten(F.collect_set("cuts")).alias("beside"))

    @F.pandas_udf("string")
    def cut(texts, gone_, stay, beside):
        pairs = [[[(x["a"], x["b"]) for x in s] for s in (g, k, e)] if g is not None else None for g, k, e in zip(gone_, stay, beside, strict=True)]
        return texts.__class__([t if p is None or t is None else cut_words(t, [*p[0], *p[2]], p[1]) for t, p in zip(texts, pairs, strict=True)], dtype=object)

    return restore(rows.join(gone, "rid", "left").withColumn("text", cut("text", "gone", "stay", "beside")))


def cut_words(text: str, gone: Sequence[tuple[int, int]], stay: Sequence[tuple[int, int]] = ()) -> str:
    """``text`` without the words ``gone``, but with those in ``stay``; what follows a word goes with it."""
    raw = text.encode("utf-8", "surrogatepass")
    starts = hash_words(fold(raw))[1]
    drop = np.zeros(len(starts) + 1, dtype=bool)  # what leads up to the first word stays
    for a, b in gone:
        drop[a + 1 : b + 1] = True
    for a, b in stay:
        drop[a + 1 : b + 1] = False
    sizes = np.diff(np.concatenate(([0], starts, [len(raw)])))
    keep = np.repeat(~drop, sizes)
    return np.frombuffer(raw, dtype=np.uint8)[keep].tobytes().decode("utf-8", "surrogatepass")


def report(docs: DataFrame) -> DataFrame:
    """The paragraphs of every repeated passage."""
    rows = numbered(docs.select("doc_id", "text"), Scratch(docs.sparkSession, "rows"))
    return repeated(rows).drop("rid", "cuts")
