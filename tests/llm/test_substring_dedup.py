import hashlib
import random

import pytest

from shardflow.llm import substring_dedup


def brute(rows, window):
    seen, out = {}, []
    held = sorted(((i, (t or "").encode().split()) for i, t in rows if i is not None), key=lambda r: r[0])
    for i, words in held:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            first = seen.setdefault(tuple(words[k : k + window]), (i, k))
            if first < (i, k):
                gone[k : k + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def answers(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect() if r.doc_id is not None)


@pytest.mark.parametrize("window,seed", [(20, 6), (8, 3), (5, 5)])
def test_against_every_window(spark, window, seed):
    rng = random.Random(window)
    pool = [[f"p{j}_{rng.randrange(4)}" for _ in range(rng.randrange(10, 80))] for j in range(12)]
    rows = []
    for k in range(120):
        words = []
        for _ in range(rng.randrange(0, 8)):
            words += rng.choice(pool) if rng.random() < 0.5 else [f"u{rng.randrange(30)}" for _ in range(rng.randrange(1, 40))]
            if words and rng.random() < 0.3:
                words = words[rng.randrange(len(words)) :]
        rows.append((rng.randrange(1000) * 1000 + k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert answers(substring_dedup.without_repeats(df, window=window, seed=seed)) == brute(rows, window)


def test_odd_rows_and_empty_table(odd, odd_rows, nothing):
    # rows that share an id are not earlier than each other
    rows = [(r[0], r[1]) for r in odd_rows]
    got = answers(substring_dedup.without_repeats(odd, window=20))
    want = brute([r for k, r in enumerate(rows) if k != 3], 20)
    assert sorted(set(got)) == want and len(got) == len(want) + 1
    nameless = substring_dedup.without_repeats(odd).where("doc_id is null").collect()
    assert sorted((r.n_words, r.n_removed) for r in nameless) == [(0, 0), (200, 0)]
    assert substring_dedup.without_repeats(nothing).collect() == []


def test_factors_name_their_source(odd):
    factors = {r.doc_id: [(f.start, f.n, f.src, f.src_start) for f in r.factors] for r in substring_dedup.without_repeats(odd).collect()}
    assert factors[12] == [(30, 60, 11, 30)]
    assert factors[8] == [(0, 15_000, 7, 0), (15_001, 15_000, 7, 15_000)]
