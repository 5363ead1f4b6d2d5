import re
from collections import Counter, defaultdict

import pytest

from shardflow.llm import mixing


def wanted(sizes, weights, share, cap):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full, target = share * sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: cap * sizes[s] for s in full} | {s: rest * w[s] / sum(w[o] for o in open_) for s in open_}
        above = {s for s in open_ if target[s] > cap * sizes[s]}
        if not above:
            return target
        full |= above


def check(rows, got, weights=(3, 1, 2), share=1.5, cap=2):
    sizes = [len(re.findall("[^ \t-\r]+", t or "")) for _, t, _ in rows]
    per = defaultdict(int)
    for (_, _, s), n in zip(rows, sizes):
        per[s] += n
    target = wanted(per, weights, share, cap)
    assert Counter((i, n) for (i, _, _), n in zip(rows, sizes)) == Counter((r.doc_id, r.size) for r in got)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= cap * r.size and r.taken == r.copies * r.size
        assert any(abs(r.target - t) < 1e-6 and r.source_size == per[s] for s, t in target.items())
        taken[(r.source_size, round(r.target, 6))] += r.taken
    return taken


def test_documents(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text", "source").collect()]
    got = mixing.mixture(documents).collect()
    for (size, target), taken in check(rows, got).items():
        assert abs(taken - target) <= 0.02 * target + 50
    again = mixing.mixture(documents.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_odd_rows(odd, odd_rows, nothing):
    got = mixing.mixture(odd).collect()
    check([(r[0], r[1], r[3]) for r in odd_rows], got)
    copies = Counter()
    for r in got:
        copies[r.doc_id] += r.copies
    rows = mixing.mixed(odd)
    assert rows.columns == odd.columns
    assert Counter(r.doc_id for r in rows.collect()) == +copies
    assert mixing.mixture(nothing).collect() == [] and mixing.mixed(nothing).collect() == []


def test_rates_are_tilted(spark):
    """One source far below its size: the rate falls with the exponent of the size."""
    import math

    docs = [(k, "w " * (1 + k % 50), "a") for k in range(1000)] + [(5000 + k, "w " * 30, "b") for k in range(1000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = [r for r in mixing.mixture(df, weights=(1, 6), share=0.8).collect() if r.source_size == sum(1 + k % 50 for k in range(1000))]
    by = {r.size: r.rate for r in got}
    slopes = [math.log(by[n + 1] / by[n]) for n in range(1, 50)]
    assert max(slopes) - min(slopes) < 1e-3 and slopes[0] < 0
    assert sum(r.rate * r.size for r in got) == pytest.approx(got[0].target, rel=1e-4)
