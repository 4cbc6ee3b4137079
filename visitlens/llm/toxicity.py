"""Toxicity by maximum-scoring segments.

Every token has a log-odds score, the log of its chance in toxic over that in clean text by the labels, with an
informative Dirichlet prior on both, less a constant drift.  Tokens of either class keep their sign and size; one
whose log-odds the sample isn't sure of (SURE standard errors) has that of its longest stem that the sample is sure
of, or else the drift alone, which makes clean text score below zero.  Stems are the first STEMS characters of words.
One linear scan finds all maximal segments of positive total (the passages); under clean text the best total
follows an extreme-value law, whose two parameters are fitted here, so every passage has a significance of its
own.  A document's passages are aggregated and calibrated to a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.llm.common import Scratch, numbered, shield, slices

#: Bound of the sample of labelled rows that the classifier is fitted on; taken by a hash of doc_id.
MAX_FIT_ROWS = 24_000
#: Strength of the prior, in documents; standard errors from zero of a log-odds that counts; drift of a token.
PRIOR, SURE, DRIFT = 100.0, 3.5, 0.5
#: Characters of the stems of a word, longest first.
STEMS = (7, 6, 5, 4)
#: Words whose scores a worker remembers.
MEMO = 100_000
#: Bytes of tokens that are sent to every executor; scores of a larger lexicon are joined to the tokens.
MAX_LEXICON_BYTES = 16 << 20
#: Distinct tokens that a worker counts before it hands them on.
HELD_TOKENS = 50_000
#: A passage is significant below this number of such passages expected in a clean text of its length.
SIGNIFICANT = 0.05
EULER = 0.5772156649015329
HELD_OUT_OF = 5

#: Letters, digits and all beyond ASCII make words.
_WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")
_STEM = "\x01"


def tokens(text: bytes | str | None) -> list[str]:
    if isinstance(text, bytes):
        text = text.decode("utf-8", "replace")
    return _WORD.findall(text.lower()) if text else []


def stems(word: str) -> list[str]:
    return [_STEM + word[:n] for n in STEMS if len(word) >= n]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_OF == 0, F.lit(False))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, total) in linear time.

    Only tokens above zero can begin or end one, so the scan steps from one to the next; the totals
    in between come from prefix sums.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    held: list[tuple[int, int, float, float]] = []  # start, end, sum before it, sum up to its end
    for i in at.tolist():
        start, end, left, right = i, i + 1, sums[i], sums[i + 1]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j -= 1
            if j < 0 or held[j][3] >= right:
                held.append((start, end, left, right))
                break
            start, left = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, float(r - f)) for a, b, f, r in held]


def log_odds(c1: Column, c0: Column, n1: float, n0: float) -> Column:
    """Signed score of a token from its documents in either class, before the drift; 0 where the sample isn't sure."""
    prior = F.lit(PRIOR / (n1 + n0)) * (c1 + c0)
    y1, y0 = c1 + prior, c0 + prior
    delta = F.log(y1 / F.lit(n1 + PRIOR)) - F.log(y0 / F.lit(n0 + PRIOR))
    return F.when(F.abs(delta) > F.lit(SURE) * F.sqrt(1 / y1 + 1 / y0), delta).otherwise(F.lit(0.0))


class Scores(dict):
    """Scores of words, drift included; those of words not in the lexicon are remembered up to a bound."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.words = {w: v - DRIFT for w, v in lexicon.items() if w[0] != _STEM}
        by_length: dict[int, dict[str, float]] = {n: {} for n in STEMS}
        for w, v in lexicon.items():
            if w[0] == _STEM:
                by_length[len(w) - 1][w[1:]] = v - DRIFT
        self.stems = [(n, d) for n, d in by_length.items() if d]

    def __missing__(self, word: str) -> float:
        found = self.words.get(word)
        if found is None:
            found = -DRIFT
            for n, known in self.stems:
                if len(word) >= n and word[:n] in known:
                    found = known[word[:n]]
                    break
        if len(self) >= MEMO:
            self.clear()
        self[word] = found
        return found


def gumbel(scores: dict[float, int], maxima: list[tuple[int, float]]) -> tuple[float, float]:
    """(lambda, ln K): the positive root of E[exp(lambda score)] = 1 over clean tokens, and the location of the maxima."""
    top = max(scores, default=0.0)
    values = np.array([*scores.keys(), max(top, 1.0)], dtype=float)  # one more positive token, so that there is a root
    weights = np.array([*scores.values(), 1.0], dtype=float)
    weights /= weights.sum()
    lam = 1.0
    if (values * weights).sum() < 0:
        low, high = 1e-6, 1.0
        while (weights * np.exp(np.minimum(high * values, 700))).sum() < 1 and high < 64:
            high *= 2
        for _ in range(80):
            lam = (low + high) / 2
            low, high = (lam, high) if (weights * np.exp(np.minimum(lam * values, 700))).sum() < 1 else (low, lam)
    seen = [(n, s) for n, s in maxima if n > 0]
    log_k = float(np.mean([lam * s - math.log(n) for n, s in seen])) - EULER if seen else 0.0
    return lam, min(log_k, 0.0)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Extreme-value parameters and calibration, and the lexicon if it is small enough to be sent."""

    def __init__(self, words: dict[str, float] | None):
        self._scores: Scores | None = None
        self.words, self.lam, self.log_k, self.weights = words, 1.0, 0.0, np.array([-4.0, 0.0, 1.0, 0.5])

    def __getstate__(self):
        return self.__dict__ | {"_scores": None}

    def token_scores(self, text: bytes | str | None) -> np.ndarray:
        if self._scores is None:
            self._scores = Scores(self.words)
        found = tokens(text)
        return np.fromiter(map(self._scores.__getitem__, found), dtype=np.float64, count=len(found))

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """Significant segments (start, end, minus the log of the number expected by chance)."""
        n, least = len(scores), -math.log(SIGNIFICANT)
        found = ((a, b, self.lam * s - self.log_k - math.log(n)) for a, b, s in segments(scores))
        return [x for x in found if x[2] > least]

    def inputs(self, found: list[tuple[int, int, float]]) -> list[float]:
        best, total = max((x[2] for x in found), default=0.0), sum(x[2] for x in found)
        return [min(best, 20.0) / 10, math.log1p(best), math.log1p(total)]

    def score(self, scores: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
        found = self.passages(scores)
        z = float(self.weights @ np.array([1.0, *self.inputs(found)]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), found


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int, scratch: Scratch) -> DataFrame:
    """(text, toxic) of at most ``max_rows`` labelled documents, none of them held out; copies count once."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    met = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return scratch.save(met.groupBy("text").agg((F.max("toxic") > 0).alias("toxic")), "sample")


def _count_tokens(rows: DataFrame) -> DataFrame:
    """(token, c1, c0): documents of either class that have the token or stem; the empty token is in every document."""
    columns = pa.schema([("token", pa.string()), ("toxic", pa.bool_()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {False: Counter(), True: Counter()}

        def out() -> Iterator[pa.RecordBatch]:
            for toxic, c in held.items():
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), type=pa.string()), pa.array([toxic] * len(c)), pa.array(list(c.values()), type=pa.int64())], schema=columns)
                c.clear()

        for batch in batches:
            for part, texts in slices(batch):
                for text, toxic in zip(texts, part.column("toxic").to_pylist(), strict=True):
                    found = set(tokens(text))
                    held[toxic].update(found | {s for w in found for s in stems(w)} | {""})
                    if len(held[False]) + len(held[True]) > HELD_TOKENS:
                        yield from out()
        yield from out()

    per = rows.mapInArrow(count, "token string, toxic boolean, n long")
    return per.groupBy("token").agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("c1"), F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("c0"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS, max_bytes: int | None = None) -> tuple[Model, DataFrame]:
    """The model and its lexicon (token, score), fitted on at most ``max_rows`` labelled rows, those with the least hashes of doc_id.

    A doc_id labelled more than once counts as toxic if any label says so; null labels and doc_ids are left out.
    Where no token is surely of one class, as without documents of both classes, the model finds nothing and every text is clean.
    """
    spark = docs.sparkSession
    max_bytes = MAX_LEXICON_BYTES if max_bytes is None else max_bytes
    scratch = Scratch(spark, "toxicity")
    rows = _sample(docs, labels, max_rows, scratch)
    counts = scratch.save(_count_tokens(rows), "counts")
    every = counts.where(F.length("token") == 0).first()
    n1, n0 = (float(every.c1), float(every.c0)) if every else (0.0, 0.0)
    score_ = log_odds(F.col("c1"), F.col("c0"), n1, n0) if n1 and n0 else F.lit(0.0)
    lexicon = scratch.save(counts.where(F.length("token") > 0).select("token", score_.alias("score")).where("score <> 0"), "lexicon")
    scratch.drop(counts)
    size = lexicon.agg(F.sum(F.octet_length("token") + 8)).first()[0] or 0
    model = Model({r.token: r.score for r in lexicon.collect()} if size <= max_bytes else None)
    if size:
        # written, so that no task needs two Python workers at a time
        scored = scratch.save(with_scores(rows, model, lexicon).select("scores", "toxic"), "scored")
        _calibrate(model, scored)
        scratch.drop(scored)
    scratch.drop(rows)
    return model, lexicon


def _calibrate(model: Model, scored: DataFrame) -> None:
    """Fit the extreme-value law on the clean rows and the calibration on all rows of the bounded sample."""
    clean = scored.where("NOT toxic")
    kinds = clean.select(F.explode(F.transform("scores", lambda s: F.round(s, 1))).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    found = {r.s: r.n for r in kinds.collect()}  # scores to one place: a few hundred numbers

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.array(s) for s in batch.column("scores").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in each], type=pa.int64()), pa.array([max((x[2] for x in segments(s)), default=0.0) for s in each], type=pa.float64())], names=["n", "most"])

    maxima = [(r.n, r.most) for r in clean.select("scores").mapInArrow(highest, "n long, most double").collect()]  # a row for each of the sample
    model.lam, model.log_k = gumbel(found, maxima)

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [model.inputs(model.passages(np.array(s))) for s in batch.column("scores").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *[pa.array([x[i] for x in each], type=pa.float64()) for i in range(3)]], names=["toxic", "a", "b", "c"])

    words, model.words = model.words, None  # scores are there already
    seen = scored.select("scores", "toxic").mapInArrow(inputs, "toxic boolean, a double, b double, c double").toPandas()
    model.words = words
    if 0 < seen["toxic"].sum() < len(seen):
        model.weights = _logistic(seen[["a", "b", "c"]].to_numpy(), seen["toxic"].to_numpy(dtype=float))


def with_scores(docs: DataFrame, model: Model, lexicon: DataFrame) -> DataFrame:
    """``docs`` with ``scores``, of their tokens in order; the lexicon is sent, or joined where it is too large for that."""
    if model.words is not None:
        sent = docs.sparkSession.sparkContext.broadcast(model)
        schema = T.StructType([*docs.schema.fields, T.StructField("scores", T.ArrayType(T.DoubleType()))])

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in slices(batch):
                    scores = pa.array([sent.value.token_scores(t) for t in texts], type=pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*part.columns, scores], names=[*part.schema.names, "scores"])

        return docs.mapInArrow(look, schema)
    rows = numbered(docs, Scratch(docs.sparkSession, "rows"), "row__")
    columns = pa.schema([("row__", pa.int64()), ("place", pa.int32()), ("turn", pa.int32()), ("token", pa.string())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                for row, text in zip(part.column("row__").to_pylist(), texts, strict=True):
                    # the word, then its stems
                    found = [(i, j, x) for i, w in enumerate(tokens(text)) for j, x in enumerate((w, *stems(w)))]
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), type=pa.int64()), *[pa.array([x[i] for x in found], type=columns.field(i + 1).type) for i in range(3)]], schema=columns)

    listed = rows.select("row__", "text").mapInArrow(split, "row__ long, place int, turn int, token string").join(lexicon, "token", "left")
    each = listed.groupBy("row__", "place").agg(F.min(F.when(F.col("score").isNotNull(), F.struct("turn", "score"))).alias("best"))
    per = each.groupBy("row__").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("best.score", F.lit(0.0)).alias("score")))).alias("s"))
    scores = F.coalesce(F.transform("s", lambda x: x["score"] - F.lit(DRIFT)), F.array().cast("array<double>"))
    return rows.join(per, "row__", "left").select(*docs.columns, scores.alias("scores"))


_PASSAGE = T.StructType([T.StructField("first_token", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("significance", T.DoubleType())])


def score(docs: DataFrame, labels: DataFrame, max_lexicon_bytes: int | None = None) -> DataFrame:
    """``docs`` with ``_score`` in [0, 1] and ``_passages`` (first token, tokens, significance), which replace columns of these names.

    Only the text counts.  Null and empty texts get the score of a text without passages.  Very long texts are scanned
    whole.  Labels without both classes leave a model that finds nothing.  Rows repeated in full are scored each; an
    empty table stays empty; other columns pass through, whatever their names.
    """
    safe, restore = shield(docs, ("doc_id", "text"))
    model, lexicon = fit(safe, labels, max_bytes=max_lexicon_bytes)
    joined = model.words is None
    rows = with_scores(safe, model, lexicon) if joined else safe
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*safe.schema.fields, T.StructField("_score", T.DoubleType()), T.StructField("_passages", T.ArrayType(_PASSAGE))])
    kinds = pa.list_(pa.struct([("first_token", pa.int64()), ("n_tokens", pa.int64()), ("significance", pa.float64())]))
    columns = safe.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                scores = (np.array(s) for s in part.column("scores").to_pylist()) if joined else map(sent.value.token_scores, texts)
                found = [sent.value.score(s) for s in scores]
                passages = [[{"first_token": a, "n_tokens": b - a, "significance": v} for a, b, v in p] for _, p in found]
                added = [pa.array([s for s, _ in found], type=pa.float64()), pa.array(passages, type=kinds)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *added], names=[*columns, "_score", "_passages"])

    return restore(rows.mapInArrow(judge, schema), "_score", "_passages")


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below 0.5, with their own columns, whatever their names.

    Null and empty texts are scored as texts without passages, so they stay wherever clean text does.  Rows repeated in
    full all stay or all go; very long texts are scanned whole; a score of 0.5 exactly goes; an empty table stays empty.
    """
    safe, restore = shield(docs)
    return restore(score(safe, labels).where(F.col("_score") < 0.5))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs.select("doc_id", "text"), labels)
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
        F.size("_passages").alias("n_passages"),
    )
