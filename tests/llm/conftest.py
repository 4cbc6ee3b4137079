import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, sources=None, **extra):
        """documents from texts; more columns by name."""
        ids = list(range(len(texts))) if ids is None else ids
        sources = ["s"] * len(texts) if sources is None else sources
        rows = [(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources, strict=True)]
        df = spark.createDataFrame(rows, DOCS)
        for name, value in extra.items():
            df = df.withColumn(name, F.lit(value))
        return df

    return make


#: Extra columns whose names the operators use inside, or add.
CLASHES = {
    **dict.fromkeys(["rid", "node", "shard", "label", "size", "virtual_slot", "rank", "n", "copies", "h", "band", "map_version", "copy", "sub", "line", "pos", "n_removed"], 1),
    **dict.fromkeys(["rule", "verdict", "host", "path", "found", "file__", "row_index__", "row__", "k1__", "stack", "plain", "runs", "passage", "cuts", "scores", "kept", "class_id"], "x"),
    **dict.fromkeys(["_licence", "_digest", "_n_words", "_contained", "_n_hit", "_hit_items", "_matches", "_spans", "_passages", "_metadata", "x0__"], "y"),
    **dict.fromkeys(["score", "_score"], 1.5),
}


@pytest.fixture(scope="session")
def clashes():
    return CLASHES
