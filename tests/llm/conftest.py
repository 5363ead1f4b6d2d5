import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, sig string, size string, row string, k1 string"


def base(n, seed=0):
    """``n`` different words."""
    return [f"w{seed}x{k}" for k in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows; extra columns with names the operators use."""
    long = base(30_000, 1)
    passage = base(60, 2)
    near = base(200, 3)
    texts = [
        (1, " ".join(near)),
        (2, " ".join(near[:120] + ["other"] + near[120:])),
        (3, " ".join(near)),
        (3, " ".join(near)),  # a repeated row
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, " ".join(long)),
        (8, " ".join(long[:15_000] + ["x"] + long[15_000:])),
        (9, "one two"),
        (10, "ONE  two"),
        (11, " ".join(base(30, 4) + passage + base(30, 5))),
        (12, " ".join(base(30, 6) + passage + base(30, 7))),
        (None, " ".join(near)),
        (None, None),
        (13, "0123 456 !!"),
        (14, "é" * 50 + " ß 日本語"),
        (15, "same same same same same same " * 20),
    ]
    out = []
    for k, (i, t) in enumerate(texts):
        lang = [None, "en", "fr"][k % 3]
        source = [None, "a", "b", "ü"][k % 4]
        out.append((i, t, lang, source, None if t is None else len(t), -k, "s", "z", "r", None))
    return out


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
