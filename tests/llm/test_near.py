"""Near duplicates, passages and components."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from visitlens.llm import candidates, passages, queries
from visitlens.llm.common import Scratch, numbered
from visitlens.llm.components import components
from visitlens.llm.passages import MIN_RUN, cut_words, remove_passages, repeated
from visitlens.llm.probminhash import classify, remove_near_duplicates, signature
from visitlens.llm.shingles import jaccard, numbers_of, probability_jaccard, weighted_shingles

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def word_list(text):
    return WORD.findall((text or "").translate(LOWER))


def with_row_id(docs):
    return numbered(docs, Scratch(docs.sparkSession, "test"))


def shingle_counts(text):
    words = word_list(text)
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def alike(a, b):
    """Probability Jaccard similarity by its definition; plain Jaccard for sets."""
    both = a.keys() & b.keys()
    if set(a.values()) | set(b.values()) <= {1}:
        return len(both) / len(a.keys() | b.keys())
    if min(sum(a[x] for x in both) / sum(a.values()), sum(b[x] for x in both) / sum(b.values())) < 0.75:
        return 0.0  # it is at most that
    pairs = Counter((a[x], b[x]) for x in a.keys() | b.keys())
    return sum(m / sum(max(x / p, y / q) * n for (x, y), n in pairs.items()) for (p, q), m in pairs.items() if p and q)


class Sets(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            self[x] = x = self[self[x]]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def brute_classes(docs, similarity=0.8):
    """Least doc_id of the class of each document, from all pairs that share a shingle."""
    sets, by_words, owners, shingles = Sets(), {}, defaultdict(list), {}
    for i, text in docs:
        sets.find(i)
        if text is None:
            continue
        key = tuple(word_list(text)) or ("", text)
        if key in by_words:
            sets.join(i, by_words[key])
            continue
        by_words[key] = i
        shingles[i] = shingle_counts(text)
        for s in shingles[i]:
            owners[s].append(i)
    pairs = {(a, b) for v in owners.values() for n, a in enumerate(v) for b in v[:n]}
    for a, b in pairs:
        if alike(shingles[a], shingles[b]) >= similarity:
            sets.join(a, b)
    return {i: sets.find(i) for i, _ in docs}


def text_of(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def test_whole_table(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = queries.op8_near_duplicates(spark, data).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(docs) and len(got) == len(docs)
    assert sum(r.kept for r in got) == len({r.class_id for r in got})


@pytest.mark.parametrize("rounds", [1, 2])
def test_chains_and_groups(make_docs, monkeypatch, rounds):
    """Chains whose ends are unlike, a large group of near copies, and texts in between."""
    monkeypatch.setattr(candidates, "ROUNDS", rounds)
    rng = random.Random(3)
    texts = []
    for _ in range(3):
        words = text_of(rng, 200)
        for _ in range(6):
            texts.append(" ".join(words))
            words = edited(rng, words, 3)
    base = text_of(rng, 150)
    texts += [" ".join(edited(rng, base, 1)) for _ in range(60)] + [" ".join(base)] * 20
    texts += [" ".join(base[:75] + text_of(rng, 75)) for _ in range(10)]
    rng.shuffle(texts)
    docs = make_docs(texts)
    got = {r.doc_id: r.class_id for r in classify(with_row_id(docs)).collect()}
    assert got == brute_classes(list(enumerate(texts)))


def test_odd_rows(make_docs, clashes):
    long = " ".join(text_of(random.Random(1), 60_000))
    texts = [None, None, "", "", " ", "...", "one two", "One, two!", "one three", "a a a a a a a", "a a a a a", long, long + " end", "!!!", "!!!"]
    docs = make_docs(texts, **clashes)
    got = {r.doc_id: r.class_id for r in classify(with_row_id(docs.select("doc_id", "text"))).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9, 10: 9, 11: 11, 12: 11, 13: 13, 14: 13}
    left = remove_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(set(got.values()))
    assert classify(with_row_id(make_docs([]))).count() == 0
    same = classify(with_row_id(make_docs(["x y"] * 4, ids=[None, 5, 5, None]))).collect()
    assert {r.class_id for r in same} == {5} and sum(r.kept for r in same) == 1


def test_signature_estimates():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
    a = (keys[:50], rng.integers(1, 4, 50))
    b = (keys[10:], rng.integers(1, 4, len(keys) - 10))
    alike = [(signature(x[0], x[1], 20000)) for x in (a, b)]
    assert abs((alike[0] == alike[1]).mean() - probability_jaccard(a, b)) < 0.02
    ones = np.ones(len(keys))
    assert probability_jaccard((keys[:50], ones[:50]), (keys[10:], ones[10:])) == pytest.approx(jaccard(keys[:50], keys[10:]))
    for n in (1, 2, 7, 3000):
        k = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        assert set(signature(k, np.ones(n), 80).tolist()) <= set(k.tolist())


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)] + [(200, 200 + i) for i in range(1, 30)]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.label for r in components(df, Scratch(spark, "test")).collect()}
    assert got == {n: sets.find(n) for n in {x for a, b in edges if a != b for x in (a, b)}}
    assert components(df.where("false"), Scratch(spark, "test")).count() == 0


def sentence(rng, n):
    return " ".join(text_of(rng, n)) + "."


def shared_windows(docs, n):
    """Documents that have n words in a row with another."""
    owners = defaultdict(set)
    for i, text in docs:
        words = word_list(text)
        for at in range(len(words) - n + 1):
            owners[tuple(words[at : at + n])].add(i)
    return {i for v in owners.values() if len(v) > 1 for i in v}


def test_passages(make_docs, clashes):
    rng = random.Random(7)
    passage = " ".join(sentence(rng, 15) for _ in range(5))
    host = [" ".join(sentence(rng, 14) for _ in range(5)) for _ in range(8)]
    short = sentence(rng, 12)
    texts = [host[0] + " " + passage, host[1], "some words " + passage + " " + host[2], host[3] + "\n" + short, host[4] + "\n" + short, None, "", passage.replace(passage.split()[70], "other") + host[5], host[6] + " " + host[6], host[7]]
    docs = make_docs(texts, **clashes)
    got = repeated(with_row_id(docs.select("doc_id", "text"))).collect()
    assert {r.doc_id for r in got} == {0, 2, 7}
    assert all(r.kept == (r.doc_id == 0) for r in got)
    left = remove_passages(docs)
    assert left.columns == docs.columns
    out = {r.doc_id: r.text for r in left.collect()}
    assert [out[i] for i in (0, 1, 3, 4, 5, 6, 8, 9)] == [texts[i] for i in (0, 1, 3, 4, 5, 6, 8, 9)]
    # a paragraph with one other word at its end is still alike, so a word beside the passage may go
    assert abs(len(word_list(out[2])) - 72) <= 2 and word_list(out[2])[-69:] == word_list(host[2])[1:] and word_list(out[2])[0] == "some"
    assert abs(len(word_list(out[7])) - (len(word_list(texts[7])) - 70)) <= 2
    assert repeated(with_row_id(make_docs([]))).count() == 0


def test_passage_table(spark, data):
    """Against all windows of words, by a tokeniser of its own."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows = queries.op7_passages(spark, data).collect()
    named = {r.doc_id for r in rows}
    over, most = shared_windows(docs, MIN_RUN + 1), shared_windows(docs, MIN_RUN - 10)
    clean = {i for i, _ in docs} - most
    assert len(over) > 20 and len(named & over) >= 0.95 * len(over)
    assert len(named & clean) <= 0.03 * len(clean)
    words = {i: word_list(t) for i, t in docs}
    by_class = defaultdict(set)
    for r in rows:
        assert r.passage_words >= MIN_RUN and r.passage_first_word <= r.first_word and r.first_word + r.n_words <= r.passage_first_word + r.passage_words <= len(words[r.doc_id])
        by_class[r.class_id].add(tuple(words[r.doc_id][r.first_word : r.first_word + r.n_words]))
    for parts in by_class.values():  # each is alike to another of its class, by single links
        sets = [{p[i : i + 5] for i in range(len(p) - 4)} for p in parts]
        assert all(any(len(a & b) / len(a | b) >= 0.8 for m, b in enumerate(sets) if n != m) for n, a in enumerate(sets)) or len(sets) == 1
    assert {r.class_id for r in rows if r.kept} <= set(by_class)


@pytest.mark.parametrize("size, found", [(51, True), (60, True), (120, True), (36, False)])
def test_every_place(make_docs, size, found):
    """Passages pasted at random places, between words without sentences, into hosts of any length; scripts without case."""
    rng = random.Random(size)
    texts, want = [], {}
    for n in range(40):
        passage = text_of(rng, size, 50 if n % 4 == 0 else 4000) if n % 2 else [chr(0x4E00 + rng.randrange(3000)) for _ in range(size)]
        for _ in range(2 + n % 3):
            ahead, behind = (text_of(rng, rng.randrange(120), 10**6) for _ in range(2))
            want[len(texts)] = (len(ahead), size)
            texts.append(" ".join(ahead + passage + behind))
    got = repeated(with_row_id(make_docs(texts))).collect()
    spans = {r.doc_id: (r.passage_first_word, r.passage_words) for r in got}
    assert spans.keys() == (want.keys() if found else set()) and len({(r.doc_id, r.passage) for r in got}) == len(spans)
    # one other word at either end leaves a paragraph alike
    assert all(want[i][0] - 1 <= a <= want[i][0] and want[i][0] + size <= a + n <= want[i][0] + size + 1 for i, (a, n) in spans.items())


def test_near_passages(make_docs):
    """A passage in many versions, each edited in a few words, among documents that share nothing."""
    rng = random.Random(23)
    base = text_of(rng, 400)
    texts = [" ".join(edited(rng, base, 4)) for _ in range(30)] + [" ".join(text_of(rng, 300, 10**6)) for _ in range(30)]
    named = {r.doc_id for r in repeated(with_row_id(make_docs(texts))).collect()}
    assert shared_windows(list(enumerate(texts)), 51) <= named and named <= set(range(30))


@pytest.mark.parametrize("vocabulary", [3, 40])
def test_repeated_words(make_docs, vocabulary):
    """Paragraphs that repeat words and lines inside, against all pairs of paragraphs."""
    rng = random.Random(vocabulary)
    texts = []
    for period in range(1, 19):
        line = text_of(rng, period, vocabulary)
        for n in range(4):
            words = (line * 60)[n : n + 60]
            texts.append(" ".join(text_of(rng, 20, 10**6) + edited(rng, words, n) + text_of(rng, 20, 10**6)))
    texts += [" ".join(text_of(rng, 60, vocabulary)) for _ in range(20)]
    sets, owners, shingles = Sets(), defaultdict(set), {}
    for i, text in enumerate(texts):
        words = word_list(text)
        for at in passages.find_starts(*numbers_of([text])).starts.tolist():
            owners[tuple(words[at : at + passages.WORDS])].add((i, at))
    for words in owners:
        shingles[words] = {words[i : i + 5] for i in range(passages.WORDS - 4)}
    for a in owners:
        for b in owners:
            if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                sets.join(a, b)
    want = defaultdict(set)
    for words, places in owners.items():
        want[sets.find(words)] |= places
    got = defaultdict(set)
    for r in repeated(with_row_id(make_docs(texts)), min_run=passages.WORDS).collect():
        got[r.class_id].add((r.doc_id, r.first_word))
    many = {frozenset(v) for v in want.values() if len({i for i, _ in v}) > 1}
    assert {frozenset(v) for v in got.values()} == many and len(many) > 10


def test_variants_cost_rows_in_proportion(make_docs, monkeypatch):
    """Paragraphs that are edited inside share bands with many, but no table has more than a few rows for each of them."""
    rng = random.Random(29)
    base = text_of(rng, 800, 10**6)
    texts = [" ".join(f"e{rng.randrange(10**6)}" if rng.random() < 0.1 else w for w in base) for _ in range(60)]
    rows, save = Counter(), Scratch.save

    def counted(self, df, name, by=None):
        out = save(self, df, name, by)
        rows[name] = max(rows[name], out.count())
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    repeated(with_row_id(make_docs(texts))).count()
    assert rows["paragraphs"] > 2000 and max(rows.values()) <= 2 * rows["paragraphs"], rows


def test_cut_keeps_the_rest():
    text = "  One two three, four five. Six seven!\nEnd"
    assert cut_words(text, []) == text
    assert cut_words(text, [(1, 3), (5, 7)]) == "  One four five. End"
    assert cut_words(text, [(0, 8)], [(3, 5)]) == "  four five. "
    assert cut_words("", []) == ""


def test_bands_at_the_threshold():
    """Of 2,000 paragraphs that differ in their last word, at Jaccard 0.85, almost all share a band with their origin."""
    rng = random.Random(17)
    pairs = []
    for _ in range(2000):
        words = text_of(rng, passages.WORDS, 10**6)
        pairs += [words, [*words[:-1], "edit"]]
    assert 0.8 <= jaccard(*(weighted_shingles(" ".join(w))[0] for w in pairs[:2])) < 0.86
    numbers, _ = numbers_of([" ".join(w) for w in pairs])
    bands = passages.paragraph_bands(passages.paragraph_shingles(numbers, np.arange(4000) * passages.WORDS), passages.BANDS, passages.ROWS)
    missed = int((bands[::2] != bands[1::2]).all(axis=1).sum())
    assert missed <= 8
