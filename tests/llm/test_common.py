"""Row numbers, slices and word numbers."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from visitlens.llm import common, shingles
from visitlens.llm.common import Scratch, numbered, shared_dir, slices


def test_numbers_of_files(spark, tmp_path):
    """The same numbers whatever the splits, the columns and the order of evaluation; paths with blanks."""
    path = f"file://{tmp_path}/a b/docs.parquet"
    spark.range(1000).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(7).write.parquet(path)
    docs = spark.read.parquet(path)
    scratch = Scratch(spark, "test")
    first = {r.rid: r.doc_id for r in numbered(docs, scratch).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        again = {r.rid: r.doc_id for r in numbered(docs.select("doc_id"), scratch).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert first == again and len(first) == 1000 and scratch.n == 0


def test_numbers_of_other_plans(spark, tmp_path):
    """Rows that come out of a shuffle or a random filter are written with their numbers."""
    path = f"file://{tmp_path}/docs"
    spark.range(500).write.parquet(path)
    for docs in (spark.range(500), spark.read.parquet(path).groupBy("id").count(), spark.read.parquet(path).where(F.rand() < 0.5), spark.read.parquet(path).withColumn("_metadata", F.lit(1))):
        rows = numbered(docs, Scratch(spark, "test"))
        once = {r.rid: r.id for r in rows.collect()}
        assert once == {r.rid: r.id for r in rows.collect()} and len(once) == len(set(once.values()))


def test_no_shared_folder(spark, monkeypatch):
    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "_jsc": spark.sparkContext._jsc})

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(RuntimeError):
            shared_dir(Elsewhere)
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=20), st.integers(0, 5))
def test_slices(texts, skip):
    whole = [None if t is None else t.encode("utf-8", "replace").decode("utf-8", "replace") for t in texts]
    batch = pa.RecordBatch.from_pydict({"i": list(range(len(whole))), "text": pa.array(whole, type=pa.string())}).slice(min(skip, len(whole)))
    before = common.SLICE_BYTES
    common.SLICE_BYTES = 40
    try:
        parts = list(slices(batch))
    finally:
        common.SLICE_BYTES = before
    assert [i for p, _ in parts for i in p.column("i").to_pylist()] == batch.column("i").to_pylist()
    assert [t if t is None else t.decode() for _, ts in parts for t in ts] == batch.column("text").to_pylist()


def test_word_numbers():
    """Words alike have one number, wherever they stand; others differ."""
    rng = random.Random(2)
    words = [f"{rng.choice('abé')}{rng.randrange(3000)}" for _ in range(120_000)] + ["z" * 400_000, "y" * 400_000]
    text = " ".join(words)
    numbers = shingles.word_numbers(text)
    seen = {}
    assert len(numbers) == len(words)
    for w, n in zip(words, numbers.tolist(), strict=True):
        assert seen.setdefault(w, n) == n
    assert len(set(seen.values())) == len(seen)
    flat, counts = shingles.numbers_of(["One two", None, "", "...", "TWO, one", text])
    assert counts.tolist() == [2, 0, 0, 0, 2, len(words)] and flat[:4].tolist() == [flat[0], flat[1], flat[1], flat[0]]
    assert (flat[4:] == numbers).all()
    assert len({int(shingles.word_numbers(w)[0]) for w in ("ab", "ba", "abc", "acb", "cab", "a", "aa", "aaa")}) == 8


def test_folding_is_plain():
    text = "A-b C\u00e9\u2028d \x00x9\n_z"
    assert shingles.fold(text).split() == [w.lower().encode() if w.isascii() else w.encode().lower() for w in re.findall("[0-9A-Za-z\x80-\U0010ffff]+", text)]
    assert np.array_equal(shingles.word_numbers(text), shingles.word_numbers(text.encode()))
