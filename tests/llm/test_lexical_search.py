"""Ranked lexical search against a plain count over all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from shardflow.llm import lexical_search as L
from shardflow.scratch import materialise

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """``docs`` and ``items``: lists of (id, text)."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    total = sum(bool(c) for _, c in counts)
    length = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        scores = []
        for doc, c in counts:
            n, s = sum(c.values()), 0
            for t in terms(text):
                if c[t]:
                    m = 75 + 25 * n * total // length
                    s += math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if s > 0:
                scores.append((-s, doc is not None, doc or 0))
        out += [(item, r, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k=20, partitions=3):
    d = spark.createDataFrame(docs, "doc_id long, text string, score long, rank int, terms string, block int, item string").repartition(partitions)
    i = spark.createDataFrame([(*x, 1, "t") for x in items], "item_id long, text string, block int, terms string")
    out = L.search(materialise(L.build_index(d), "index"), i, k)
    return sorted((tuple(r) for r in out.collect()), key=repr)


def wide(rows):
    return [(i, t, 7, 7, "x", 1, "y") for i, t in rows]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    word = lambda: f"w{int(rng.zipf(1.3)) % 400}"
    rows = [(k, " ".join(word() for _ in range(int(rng.integers(0, 90))))) for k in range(700)]
    items = [(k, " ".join(word() for _ in range(12))) for k in range(25)]
    items += [(100, rows[40][1]), (101, rows[41][1] + " " + rows[42][1])]
    return rows, items


@pytest.mark.parametrize("k", [1, 20, 900])
def test_against_plain_count(spark, corpus, k):
    rows, items = corpus
    assert found(spark, wide(rows), items, k) == brute(rows, items, k)


def test_many_small_blocks(spark, corpus, monkeypatch):
    rows, items = corpus
    monkeypatch.setattr(L, "ITEM_TERMS", 40)  # items in several blocks too
    assert found(spark, wide(rows), items, partitions=23) == brute(rows, items, 20)


def test_odd_rows(spark):
    long = " ".join(f"t{k % 9000}" for k in range(40_000))
    rows = [
        (None, "null id here"),
        (None, "null id here"),  # a document of its own
        (1, None),
        (2, ""),
        (3, " .,; \n"),
        (4, "Tie one"),
        (5, "tie ONE"),
        (5, "tie ONE"),
        (6, long),
        (7, "Über ÜBER über naïve 東京"),
        (8, "a_b-c.d"),
    ]
    items = [(None, "id here"), (1, None), (2, ""), (3, "tie one one"), (3, "tie one one"), (3, "t1 t2"), (4, "über 東京"), (5, "a b c d"), (6, long), (7, "nowhere")]
    assert found(spark, wide(rows), items) == brute(rows, items, 20)


def test_nothing(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, wide([(1, None), (2, " ")]), [(1, "a")]) == []
    assert found(spark, wide([(1, "a")]), []) == []


def test_long_words_are_compared_by_content(spark):
    """Words of 4,096 letters that a polynomial hash modulo 2**64 cannot tell apart."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(4096))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one + " x"), (2, other + " x"), (3, "x y")]
    assert found(spark, wide(rows), [(1, one)]) == brute(rows, [(1, one)], 20)


def test_treap_paths():
    rng = np.random.default_rng(1)
    rows, columns = rng.integers(0, 300, 900), rng.integers(0, 37, 900)
    key, at = np.unique((L.spread(rows) << np.uint64(1)) | L.spread(columns), return_index=True)
    value = rng.integers(1, 1000, len(key))
    treap = L.Treap(key, value, 37)
    assert (L.gather(key) == columns[at]).all()
    for r in range(0, 310, 7):
        roots = treap.roots(np.array([r]))
        cells = {0: roots}
        for level in range(treap.depth, 0, -1):
            cells = {
                start + half * (1 << (level - 1)): treap.down(cell, np.array([(r >> (level - 1) & 1) << 1 | half]))
                for start, cell in cells.items()
                for half in (0, 1)
            }
        plain = {int(c): int(v) for c, rr, v in zip(columns[at], rows[at], value) if rr == r}
        assert {s: int(treap.most[c[0]]) for s, c in cells.items() if c[0] != treap.none} == plain


def test_one_block_travels_at_a_time(spark, corpus, monkeypatch):
    """A task holds one block of the index, not all that its file has, and the session's setting comes back."""
    rows, items = corpus
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame(wide(rows), "doc_id long, text string, score long, rank int, terms string, block int, item string")
    index = materialise(L.build_index(docs.repartition(40)).coalesce(1), "index")
    frame = type(index)
    real, most = frame.mapInArrow, spark.sparkContext.accumulator(0)

    def spied(self, func, schema, *rest):
        def run(batches):
            def told():
                for batch in batches:
                    if len(batch) > 1:
                        most.add(1)
                    yield batch

            return func(told())

        return real(self, run, schema, *rest)

    monkeypatch.setattr(frame, "mapInArrow", spied)
    before = spark.conf.get(key)
    out = L.search(index, spark.createDataFrame(items, "item_id long, text string"), 20)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(rows, items, 20)
    assert most.value == 0 and spark.conf.get(key) == before
