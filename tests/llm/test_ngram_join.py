import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import base  # noqa: F401

from shardflow.llm import ngram_join
from shardflow.llm.components import components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n):
    words = re.findall("[^ \t-\r]+", (text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}


def brute(rows, n, num, den):
    """Smallest id reachable, by comparing all pairs."""
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if x and y and den * both >= num * (len(x) + len(y) - both):
                u, v = root(i), root(j)
                parent[max(u, v)] = min(u, v)
    return {(i, len(s), root(i)) for i, s in sets}


def answers(df):
    return {tuple(r) for r in df.collect() if r.doc_id is not None}


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 4, 5)])
def test_against_all_pairs(spark, n, num, den):
    rng = random.Random(n)
    rows, k = [], 0
    for size in (3, 6, 8, 11, 20, 40, 90, 300):
        for _ in range(4):
            words = [f"v{rng.randrange(10**6)}" for _ in range(size)]
            for _ in range(5):
                copy = list(words)
                for _ in range(rng.randrange(0, 1 + size // 25 + 1)):
                    copy[rng.randrange(size)] = f"n{rng.randrange(10**6)}"
                rows.append((k, " ".join(copy)))
                k += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert answers(ngram_join.ngram_jaccard_groups(df, n=n, num=num, den=den, block=8)) == brute(rows, n, num, den)


def test_odd_rows_and_empty_table(odd, odd_rows, nothing):
    got = ngram_join.ngram_jaccard_groups(odd, n=4, num=85, den=100)
    assert got.count() == len(odd_rows)
    assert answers(got) == brute([(r[0], r[1]) for r in odd_rows], 4, 85, 100)
    assert sorted((r.n_shingles, r.component_id) for r in got.where("doc_id is null").collect()) == [(0, None), (197, None)]
    assert ngram_join.ngram_jaccard_groups(nothing).collect() == []


@pytest.mark.parametrize("num,den", [(85, 100), (4, 5), (1, 2), (95, 100)])
def test_linked_sets_share_a_signature(num, den):
    """Sets at the very edge of a link, of all small sizes."""
    rng = np.random.default_rng(7)
    bands = ngram_join.Bands(num, den)
    for size in [*range(1, 60), 100, 333, 1000]:
        for extra in range(0, size):
            low, high = size - extra, size  # a subset: similarity low / high
            if den * low < num * high:
                break
            elements = rng.integers(1, 2**63, high).astype(np.uint64)
            grams = np.concatenate([np.sort(elements), np.sort(elements[:low])])
            row = np.repeat([0, 1], [high, low])
            sig, owner = ngram_join.signatures(grams, row, np.array([high, low]), bands)
            assert set(sig[owner == 0]) & set(sig[owner == 1])


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (200, 200)]
    random.Random(1).shuffle(chain)
    got = {tuple(r) for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {(k, 1) for k in range(1, 41)} | {(k, 100) for k in (100, 101, 102)}


def test_sets_of_short_texts():
    grams, row, size = ngram_join.sets_of(pa.array(["a b c d e", "a b", None, "  ", "A B"]), 4, True)
    assert size.tolist() == [2, 1, 0, 0, 1] and grams[row == 1] == grams[row == 4]


def test_no_pair_is_compared_twice(spark, monkeypatch):
    """Versions of a text that are near, but mostly not linked, meet in many buckets and turns."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        words = [f"b{j}" for j in range(200)]
        for j in rng.choice(200, 3, replace=False):
            words[j] = f"x{rng.integers(1 << 30)}"
        rows.append((k, " ".join(words)))
    seen, real = [], ngram_join.verified

    def verified(pairs, *rest):
        seen.extend((r.a, r.b) for r in pairs.collect())
        return real(pairs, *rest)

    monkeypatch.setattr(ngram_join, "verified", verified)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in ngram_join.ngram_jaccard_groups(docs, n=5, num=4, den=5).collect()}
    assert got == brute(rows, 5, 4, 5)
    assert len(seen) > 100 and len(set(seen)) == len(seen)


def test_buckets_with_the_same_texts_become_one(spark):
    """A family of near copies shares one signature or hundreds: it is one bucket."""
    buckets = {k: [1, 2, 3] for k in range(300)} | {1000 + k: [4, 5] for k in range(40)} | {2000 + k: [100 + k] for k in range(50)} | {3000: [1, 2], 3001: list(range(200, 400))}
    rows = spark.createDataFrame([(s, i) for s, ids in buckets.items() for i in ids], "sig long, id long").repartition(5)
    want = sorted([[1, 2, 3], [4, 5], [1, 2], list(range(200, 400))])
    for hold, batch in ((1 << 16, 10_000), (16, 7), (0, 1)):
        told = {}
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            for r in ngram_join._shared(rows, hold=hold).distinct().collect():
                told.setdefault(r.sig, []).append(r.id)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        groups = sorted(sorted(ids) for ids in told.values() if len(ids) > 1)
        assert [g for k, g in enumerate(groups) if g not in groups[:k]] == want
        if hold > 1000:
            assert groups == want  # one task or many: one name


def test_texts_travel_to_python_in_small_batches(spark, monkeypatch):
    """Texts and sets are long: a session's batches of 10,000 rows are not for them."""
    rows = [(k, f"a family of {k % 7} words that stand in a few texts and are told by {k % 3} or {k % 2}") for k in range(60)]
    given, real = {}, ngram_join.materialise

    def materialise(df, label, batch_rows=None):
        given.setdefault(label, set()).add(batch_rows)
        return real(df, label, batch_rows)

    monkeypatch.setattr(ngram_join, "materialise", materialise)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert answers(ngram_join.ngram_jaccard_groups(docs, n=4, num=1, den=2)) == brute(rows, 4, 1, 2)
    for label in ("set-keys", "shared-signatures", "histograms", "star-pairs", "whole-sets", "near-pairs"):
        assert given[label] == {ngram_join.BATCH_ROWS}, label


def test_one_pair_joins_two_components(spark, monkeypatch):
    """Texts that are all linked are joined by about as many pairs as texts, and not by all pairs."""
    rng = random.Random(5)
    rows = []
    for k in range(80):
        words = base(400, 1)
        words[rng.randrange(400)] = f"x{k}"
        rows.append((k, " ".join(words)))
    tested, near, real, wrote = [], [], ngram_join.verified, ngram_join._close_pairs
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *rest: (tested.append(pairs.count()), real(pairs, *rest))[1])
    monkeypatch.setattr(ngram_join, "_close_pairs", lambda *a: (near.append(wrote(*a).count()), wrote(*a))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert answers(ngram_join.ngram_jaccard_groups(docs, n=5, num=4, den=5)) == brute(rows, 5, 4, 5)
    assert sum(tested) <= 3 * len(rows) and near == [0]


def test_a_pair_is_found_once_however_many_buckets_it_shares(spark):
    """Buckets of one family, in many partitions: 31 texts that share 300 buckets are 465 pairs, not 465 for each task."""
    members = [(1000 * b, k, k) for b in range(300) for k in range(31)]
    left = spark.createDataFrame(members, "sig long, id long, label long").repartition(40)
    cells = spark.createDataFrame([(k, 100, bytearray(ngram_join.CELLS)) for k in range(31)], "id long, size long, cells binary")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for block, most in ((2048, 465), (8, 465)):
            rows = ngram_join._lead_blocks(left, block).join(cells, "id")
            got = [(r.a, r.b) for r in ngram_join._close_pairs(rows, 4, 5).collect()]
            assert len(got) <= most and set(got) == {(a, b) for b in range(31) for a in range(b)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_verified_pairs_join_all_that_link_and_no_more_rows_than_texts(spark):
    """Of 780 linked pairs at one place 39 rows come back; texts without a word link with nothing."""
    rows = [(k, " ".join([*base(300, 1), f"x{k}"])) for k in range(40)] + [(50, ""), (51, None), (52, "other words altogether here now")]
    docs = spark.createDataFrame(rows, "id long, text string")
    ids = [r[0] for r in rows]
    pairs = spark.createDataFrame([(a, b, 7) for a in ids for b in ids if a < b], "a long, b long, place long")
    got = [(r.a, r.b) for r in ngram_join.verified(pairs, docs, 5, True, 4, 5).collect()]
    assert len(got) == 39 and {x for p in got for x in p} == set(range(40))
    assert {tuple(r) for r in components(spark.createDataFrame(got, "a long, b long")).collect()} == {(k, 0) for k in range(40)}
