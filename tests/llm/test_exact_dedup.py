import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shardflow.llm import exact_dedup, mixing


def brute(rows):
    groups = {}
    norm = [re.sub("[ \t-\r]+", " ", t or "") for _, t in rows]
    for (i, _), text in zip(rows, norm):
        groups.setdefault(text, []).append(i)
    out = []
    for (i, _), text in zip(rows, norm):
        known = [x for x in groups[text] if x is not None]
        out.append((i, min(known, default=None), len(groups[text]), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 3])  # three bits: most chunks share their number with others
def test_against_plain_grouping(spark, odd, odd_rows, bits):
    more = [(100 + k, " ".join(f"an edge {j % (k % 5 + 2)} in an apple" for j in range(40))) for k in range(30)]
    rows = [(r[0], r[1]) for r in odd_rows] + more
    df = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = exact_dedup.exact_groups(df, bits=bits).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_rows_that_stay(odd, nothing):
    stay = exact_dedup.without_copies(odd)
    assert stay.columns == odd.columns
    ids = sorted((r.doc_id for r in stay.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 2, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
    assert exact_dedup.without_copies(nothing).collect() == [] and exact_dedup.exact_groups(nothing).collect() == []


def test_chunks_are_the_text(odd):
    norm = odd.select(exact_dedup.normalised("text").alias("norm"))
    for r in norm.select("norm", exact_dedup.chunks(norm.norm).alias("c")).collect():
        assert "".join(r.c) == r.norm + " " and max(map(len, r.c)) <= exact_dedup.LONGEST


def test_columns_with_inner_names_are_kept(spark):
    names = ["row", "key", "id", "sha", "kept", "n", "copies", "k", "turn", "of", "_keep_id", "_mix_id", "lang_pred", "lang_score"]
    rows = [(k % 7 if k % 5 else None, "a" if k % 2 else "b", f"text of {k % 9}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    df = df.select("*", *[F.concat_ws(":", F.lit(n), "text").alias(n) for n in names])
    stay = exact_dedup.without_copies(df).collect()
    assert all(r[n] == f"{n}:{r.text}" for r in stay for n in names)
    assert sorted((r.text, r.doc_id) for r in stay) == [(f"text of {t}", min(i for i, _, x in rows if x == f"text of {t}" and i is not None)) for t in range(9)]
    twice = mixing.mixed(df)
    assert twice.columns == df.columns
    assert all(r[n] == f"{n}:{r.text}" for r in twice.collect() for n in names)
    copies = Counter()
    for r in mixing.mixture(df).collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in twice.collect()) == +copies
