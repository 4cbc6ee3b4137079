"""Benchmark decontamination with suffix arrays over training shards.

A shard is a group of documents.  Its words are numbered by the benchmark's vocabulary, and a suffix
array is built, by prefix doubling, over the positions from which a benchmark window could start: a
word that no benchmark text has ends every match, so all other suffixes can be left out without loss.
Every test suffix is then binary-searched in the array of every shard by its first WINDOW words; the range gives
all places where a match of an item begins or goes on.  Places that lie in a row in the document and in the item
are one verbatim match; the longest of each item is reported with its place in both.  Nothing is shuffled.

A benchmark larger than MAX_TEST_BYTES is taken in blocks, one after another; a block is the only part of it
that driver and executors hold at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.llm.common import Scratch, shield, slices

WINDOW = 10
#: Bytes of benchmark text that one pass sends to every executor; larger benchmarks take several passes.
MAX_TEST_BYTES = 4 << 20
#: Words of a shard; a longer document is a shard of its own.
SHARD_WORDS = 1 << 17
#: Pairs of a place in a document and one in an item that are compared together, but for a single item.
PAIRS = 1 << 20

#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z is lower-cased.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words(text: bytes | str | None) -> list[bytes]:
    if isinstance(text, str):
        text = text.encode("utf-8", "surrogatepass")
    return text.translate(_FOLD).split() if text else []


class TestSet:
    """The benchmark's distinct windows as word numbers (from 1), and where each window stands in which item."""

    __test__ = False

    def __init__(self, items: list[tuple[int | str | None, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.window = window
        # items alike in name are one; a null name is the empty string
        self.names = sorted({"" if item is None else str(item) for item, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        rows, where = [np.empty((0, window), dtype=np.int32)], [np.empty((0, 3), dtype=np.int32)]
        for text_no, (item, text) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], dtype=np.int32)
            if len(ids):
                # a shorter item is one window that ends in zeros
                full = np.pad(ids, (0, max(0, window - len(ids))))
                rows.append(np.lib.stride_tricks.sliding_window_view(full, window))
                at = np.arange(len(rows[-1]), dtype=np.int32)
                where.append(np.column_stack((np.full_like(at, number["" if item is None else str(item)]), np.full_like(at, text_no), at)))
        windows = np.concatenate(rows)
        self.suffixes, which = np.unique(windows, axis=0, return_inverse=True) if len(windows) else (windows, np.empty(0, dtype=np.int64))
        self.lengths = np.count_nonzero(self.suffixes, axis=1)
        #: (item, text, word) of every window, and where those of each distinct window begin
        self.where = np.concatenate(where)[np.argsort(which.ravel(), kind="stable")]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(which.ravel(), minlength=len(self.suffixes))))).astype(np.int64)
        self.least = int(self.lengths.min()) if len(windows) else 0


def suffix_array(ids: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the ``depth`` numbers from each position on; ``ids`` ends in a 0.  Prefix doubling."""
    rank, k = ids.astype(np.int64), 1
    n = len(ids)
    while k < depth:
        later = np.zeros(n, dtype=np.int64)
        if k < n:
            later[: n - k] = rank[k:]
        # a 0 ends a suffix: what follows it doesn't count, so a rank stays 0 from there on
        both = rank * (int(rank.max()) + 1) + np.where(ids > 0, later, 0)
        rank = np.unique(both, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return at[np.argsort(rank[at], kind="stable")]


def _prefix_less(ids: np.ndarray, start: np.ndarray, tests: np.ndarray, lengths: np.ndarray, or_equal: bool) -> np.ndarray:
    """Whether the suffix at ``start``, cut to the test's length, is smaller than the test (or the same)."""
    less = np.zeros(len(start), dtype=bool)
    open_ = np.ones(len(start), dtype=bool)
    last = len(ids) - 1
    for d in range(tests.shape[1]):
        more = open_ & (d < lengths)
        if not more.any():
            break
        mine = ids[np.minimum(start + d, last)]
        less |= more & (mine < tests[:, d])
        open_ &= ~more | (mine == tests[:, d])
    return less | open_ if or_equal else less


def search(ids: np.ndarray, array: np.ndarray, test: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """For every test suffix the range [low, high) of the array with the training suffixes that begin with it."""
    bounds = []
    for or_equal in (False, True):
        low = np.zeros(len(test.lengths), dtype=np.int64)
        high = np.full(len(test.lengths), len(array), dtype=np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            right = _prefix_less(ids, array[mid], test.suffixes[open_], test.lengths[open_], or_equal)
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
        bounds.append(low)
    return bounds[0], bounds[1]


class Match(NamedTuple):
    """The longest verbatim match of an item in a document: places and length in words."""

    item_id: str
    n_words: int
    first_word: int
    item_word: int


class Found(NamedTuple):
    """What a shard has of a test set: words by document, hit spans (first word, words) and a match for each item."""

    counts: np.ndarray
    spans: list[list[tuple[int, int]]]
    matches: list[list[Match]]


def _spread(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers low, low + 1, ... of each of several ranges, and which range each is of."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + low[which]


def _longest(test: TestSet, window: np.ndarray, place: np.ndarray, doc: np.ndarray, start: np.ndarray, out: list[list[Match]]) -> None:
    """Add to ``out`` the longest match of each item, from all (window, place) that agree."""
    sizes = test.first[window + 1] - test.first[window]
    which, at = _spread(test.first[window], sizes)
    item, text, word = test.where[at].T
    # a few items at a time, however often their windows occur
    per = np.bincount(item, minlength=len(test.names))
    group = (np.cumsum(per) - per) // PAIRS
    for g in np.unique(group[per > 0]):
        mine = np.flatnonzero(group[item] == g)
        p, i, t, w = place[which[mine]], item[mine], text[mine], word[mine]
        order = np.lexsort((p, p - w, t, i))
        p, i, t, w, n = p[order], i[order], t[order], w[order], test.lengths[window[which[mine]]][order]
        new = np.concatenate(([True], (i[1:] != i[:-1]) | (t[1:] != t[:-1]) | (p[1:] - w[1:] != p[:-1] - w[:-1]) | (p[1:] != p[:-1] + 1)))
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(p))) + n[begin] - 1
        i, w, d, first = i[begin], w[begin], doc[p[begin]], p[begin]
        best = np.lexsort((w, first, -length, i, d))
        head = np.concatenate(([True], (d[best][1:] != d[best][:-1]) | (i[best][1:] != i[best][:-1])))
        for x in best[head].tolist():
            out[d[x]].append(Match(test.names[i[x]], int(length[x]), int(first[x] - start[d[x]]), int(w[x])))


def search_shard(docs: list[list[bytes]], test: TestSet) -> Found:
    counts = np.array([len(d) for d in docs], dtype=np.int64)
    out = Found(counts, [[] for _ in docs], [[] for _ in docs])
    total = int(counts.sum())
    if not total or not test.least:
        return out
    get = test.vocabulary.get
    # a 0 after every document keeps matches inside it
    flat = np.fromiter((i for d in docs for i in (*map(get, d, repeat(0)), 0)), dtype=np.int64, count=total + len(docs))
    starts = np.cumsum(counts + 1) - counts - 1
    zero = np.flatnonzero(flat == 0)
    run = zero[np.searchsorted(zero, np.arange(len(flat)))] - np.arange(len(flat))  # words up to the next 0
    keep = run >= test.least
    if not keep.any():
        return out
    # the words that some kept suffix can reach, each run closed by a 0
    reach = (flat > 0) & (np.maximum.accumulate(np.where(keep, np.arange(len(flat)) + run, 0)) > np.arange(len(flat)))
    close = np.zeros_like(reach)
    close[1:] = reach[:-1] & ~reach[1:]
    where = np.flatnonzero(reach | close)
    ids = np.append(np.where(reach[where], flat[where], 0), 0)
    array = suffix_array(ids, np.flatnonzero(np.append(keep[where] & reach[where], False)), test.window)
    low, high = search(ids, array, test)
    hits = np.flatnonzero(low < high)
    if not len(hits):
        return out
    which, at = _spread(low[hits], high[hits] - low[hits])
    window, place = hits[which], where[array[at]]
    hit = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(hit, place, 1)
    np.add.at(hit, place + test.lengths[window], -1)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(hit[:-1]) > 0).astype(np.int8), [0]))))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        d = int(np.searchsorted(starts, a, side="right")) - 1
        out.spans[d].append((a - int(starts[d]), b - a))
    doc = np.repeat(np.arange(len(docs)), counts + 1)
    _longest(test, window, place, doc, starts, out.matches)
    return out


_SPAN = T.StructType([T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])
_MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("item_word", T.LongType())])
_ADDED = T.StructType([T.StructField("_n_words", T.LongType(), False), T.StructField("_spans", T.ArrayType(_SPAN), False), T.StructField("_matches", T.ArrayType(_MATCH), False)])
_ARROW = pa.schema(
    [
        ("_n_words", pa.int64()),
        ("_spans", pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))),
        ("_matches", pa.list_(pa.struct([("item_id", pa.string()), ("n_words", pa.int64()), ("first_word", pa.int64()), ("item_word", pa.int64())]))),
    ]
)


def _test_blocks(benchmark: DataFrame, window: int, most: int) -> Iterator[TestSet]:
    """The benchmark in blocks by item, each read when it is its turn."""
    rows = benchmark.select("item_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 if size <= most else -(-size // (most // 2))
    for b in range(blocks):
        block = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        yield TestSet([(r[0], r[1]) for r in block.collect()], window)


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_test_bytes: int = MAX_TEST_BYTES) -> DataFrame:
    """``docs`` with ``_n_words``, ``_n_hit``, ``_hit_items``, ``_spans`` and ``_matches``, which replace columns of these names.

    Spans are the unions of the windows hit in a document, where they overlap or touch, whatever their items are;
    ``_n_hit`` counts their words.  ``_matches`` has the longest verbatim match of each item (struct of item_id, n_words,
    first_word in the document, item_word; ties to the first place), ``_hit_items`` their names, sorted.

    Null and empty texts have no words and no hits; a null or empty item has no window; an item shorter than
    ``window`` is one window.  Items alike in item_id are one item, a null item_id is the empty string.  Repeated
    documents are searched each; very long ones as a shard of their own.  Matches never cross documents.  An empty
    benchmark leaves every document clean, an empty table stays empty.  Passes over the documents grow with the
    benchmark alone; what one finds is carried in the rows, written between passes.
    """
    spark = docs.sparkSession
    safe, restore = shield(docs, ("text",))
    scratch = Scratch(spark, "matches")
    found = safe
    blocks = iter(_test_blocks(benchmark, window, max_test_bytes))
    block, sent = next(blocks), None
    while block is not None:
        sent = spark.sparkContext.broadcast(block)
        found = _search(found, safe.columns, sent)
        block = next(blocks, None)
        if block is not None:
            found = scratch.save(found, "found")
            sent.destroy()
    added = found.withColumn("_n_hit", F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["n_words"]))
    added = added.withColumn("_hit_items", F.array_sort(F.transform("_matches", lambda m: m["item_id"])))
    return restore(added, "_n_words", "_n_hit", "_hit_items", "_spans", "_matches")


def _search(docs: DataFrame, columns: list[str], sent) -> DataFrame:
    """``docs`` with what the test set sent has to add to ``_spans`` and ``_matches``."""
    schema = T.StructType([*[f for f in docs.schema.fields if f.name in columns], *_ADDED.fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = sent.value

        def found(part: pa.RecordBatch, shard: list[list[bytes]]) -> pa.RecordBatch:
            got = search_shard(shard, test)
            spans, matches = got.spans, got.matches
            if "_spans" in part.schema.names:
                held = part.column("_spans").to_pylist()
                spans = [_merged([*s, *((x["first_word"], x["n_words"]) for x in h)]) if h else s for s, h in zip(spans, held, strict=True)]
                matches = [[*({**x} for x in h), *m] for m, h in zip(matches, part.column("_matches").to_pylist(), strict=True)]
            values = [
                got.counts.tolist(),
                [[{"first_word": a, "n_words": n} for a, n in s] for s in spans],
                [[x if isinstance(x, dict) else x._asdict() for x in m] for m in matches],
            ]
            more = [pa.array(v, type=f.type) for v, f in zip(values, _ARROW, strict=True)]
            return pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *more], names=[*columns, *_ARROW.names])

        for batch in batches:
            for part, texts in slices(batch):
                shard: list[list[bytes]] = []
                held = first = 0
                for i, text in enumerate(texts):
                    shard.append(words(text))
                    held += len(shard[-1])
                    if held >= SHARD_WORDS or i + 1 == len(texts):
                        yield found(part.slice(first, i + 1 - first), shard)
                        shard, held, first = [], 0, i + 1

    return docs.mapInArrow(scan, schema)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, n in sorted(spans):
        if out and a <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n - out[-1][0])
        else:
            out.append([a, n])
    return [(a, n) for a, n in out]


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark window, with their own columns, whatever their names.

    Null and empty texts stay, as do all documents where the benchmark is empty; of rows repeated in full all stay or
    all go.  Very long texts are searched whole.  An empty table stays empty.
    """
    safe, restore = shield(docs)
    return restore(find_matches(safe, benchmark).where("_n_hit = 0"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_matches(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_hit_items", ","), 256).alias("items_sha256"),
        (F.col("_n_hit") > 0).alias("contaminated"),
        F.col("_spans").alias("spans"),
        F.col("_matches").alias("matches"),
    )


def item_digest(items: list) -> str:
    return hashlib.sha256(",".join(sorted("" if i is None else str(i) for i in items)).encode()).hexdigest()
