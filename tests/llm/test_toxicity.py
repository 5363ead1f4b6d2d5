"""Toxicity: the kernel against all subsequences, near words against all pairs, held-out accuracy, odd rows."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardflow.llm import toxicity as X
from shardflow.llm.language_id import held_out

LABELS = "doc_id long, quality int, toxic int"
ROWS = "doc_id long, text string, y int, score string, l_id long, at int, words string"


def brute(a, b):
    total = 0.0
    for p in combinations(range(len(a)), X.ORDER):
        for q in combinations(range(len(b)), X.ORDER):
            if [a[i] for i in p] == [b[i] for i in q]:
                total += X.DECAY ** (p[-1] - p[0] + 1 + q[-1] - q[0] + 1)
    return total


def cosine(a, b):
    value = X.kernel(X.codes(a)[None], X.codes(b)[None])[0]
    return value / np.sqrt(X.own(a) * X.own(b)) if value else 0.0


@pytest.mark.parametrize("a,b", [("idiot", "idixot"), ("banana", "bandana"), ("aaaa", "aaa"), ("ab", "abc"), ("ñandú", "nandu")])
def test_kernel_is_the_sum_over_subsequences(a, b):
    assert X.kernel(X.codes(a)[None], X.codes(b)[None])[0] == pytest.approx(brute(a, b))


def test_near_words_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    marks = X.Landmarks.of(["idiot", "stupid", "loser", "papagei", "ñoño"])
    words = sorted({"".join(rng.choice(list("idostuplerñ"), int(rng.integers(3, 9)))) for _ in range(400)} | {"idiot", "stupidly", "looser", "idiots", "idixot", "papagai", "ñoñoñ", "lozer", "stuppid"})
    got = X.Words.of([" ".join(words)])
    names = got.strings()
    found = {(names[w], marks.words[j]): round(v, 9) for w, j, v in zip(*marks.near(got))}
    want = {(w, m): round(c, 9) for w in words for m in marks.words if (c := cosine(w, m)) >= X.NEAR}
    assert found == want and len(want) > 5


def test_words_and_sentences():
    got = X.Words.of(["An idiot. Not you!", "", "i d i o t here", "st.up-id\nx", "y" * 100])
    names = got.strings()
    seen = [(int(r), int(s), names[w]) for r, s, w in sorted(zip(got.row, got.sentence, got.word))]
    of = lambda r: [(s, w) for row, s, w in seen if row == r]
    assert {w for _, w in of(0)} == {"idiot", "not", "you"} and len({s for s, _ in of(0)}) == 2
    assert {w for _, w in of(2)} == {"idiot", "here"}
    assert {w for _, w in of(3)} == {"stupid"}
    assert of(4) and all(len(w) <= X.WINDOW for _, w in of(4))
    assert got.count.tolist() == [4, 0, 6, 2, 1]


def test_spelled_words_are_read_to_their_end():
    """A run of single letters longer than a window is looked at as a whole, like a long word."""
    letters = "abcdefghijklmnopqrstuvwxyz" * 4
    got, whole = (X.Words.of([t]) for t in (" ".join(letters), letters))
    assert sorted(got.strings()) == sorted(whole.strings()) and {w[-4:] for w in got.strings()} >= {"wxyz"}
    assert got.span.tolist() == [[0, 104]] and X.Words.of(["A b. c d", "e"]).span.tolist() == [[0, 2], [2, 4], [0, 1]]


def test_worst_passage():
    text, total = np.array([0, 0, 0, 1, 1]), np.array([2.0, 1.0, -3.0, 4.0, 4.0])
    span = np.array([[5_000, 5_010], [5_020, 5_030], [0, 9], [0, 10], [900, 900 + 4 * X.PASSAGE]])
    got = X.worst_passage(text, total, span, np.array([6_000, 9_000, 7]))
    assert got == pytest.approx([3 / (X.PASSAGE + 10), 4 / (X.PASSAGE + 10), 0])


@pytest.fixture(scope="module")
def machine(spark):
    rng = np.random.default_rng(0)
    plain = [f"{a}{b}" for a in ("ka", "mo", "ti", "re", "su", "lo") for b in ("ran", "del", "vis", "pok", "gum")]
    rows, marks = [], []
    for i in range(400):
        words = [str(rng.choice(plain)) for _ in range(int(rng.integers(20, 60)))]
        if i % 4 == 0:
            for _ in range(3):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(["idiot", "scumbag", "worthless"])))
        for k in range(7, len(words), 8):
            words[k] += "."
        rows.append((i, " ".join(words), 1, "s", 2, 3, "w"))
        marks.append((i, 0, int(i % 4 == 0)))
    docs, labels = spark.createDataFrame(rows, ROWS), spark.createDataFrame(marks, LABELS)
    return docs, labels, X.fit(docs.where(~held_out()), labels), plain


def test_held_out(machine):
    docs, labels, fitted, _ = machine
    out = X.score(docs, fitted).withColumn("predicted", X.predicted()).join(labels, "doc_id").where(held_out()).collect()
    assert len(out) > 50 and all(r.predicted == r.toxic and 0 <= r.score <= 1 for r in out)


def test_gapped_and_inserted_letters(machine):
    _, _, fitted, plain = machine
    prose = " ".join(plain)
    for insult in ("idiot", "idi.ot", "idixot", "iddiot", "i d i o t", "IDIOT", "scum-bag", "scumxbag", "worthlesss", "w.o.r.t.h.l.e.s.s"):
        assert fitted.scores([f"You {insult} and {insult} and {insult}. {insult} and {insult} again."])[0] > 0.5, insult
        assert fitted.scores([f"You {insult}. {insult} again."])[0] > 3 * fitted.scores([prose])[0], insult
    assert fitted.scores([prose])[0] < 0.1


def test_a_passage_counts_wherever_it_stands(machine):
    _, _, fitted, plain = machine
    prose = [". ".join(" ".join(plain[k : k + 10]) for k in range(0, len(plain), 10)) + ". "] * 400
    insult = "You idiot and scumbag. Worthless idiot and scumbag again. "
    alone, clean, *found = fitted.scores([insult + prose[0] * 7, "".join(prose), *("".join([*prose[:k], insult, *prose[k:]]) for k in (0, 200, 400))])
    assert clean < 0.5 < alone and found == pytest.approx([alone] * 3, abs=0.05)


def test_odd_rows(spark, machine):
    _, _, fitted, plain = machine
    long = " ".join(plain * 5000)
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (4, long + " idiot scumbag. idiot." * 400), (None, "you idiot, worthless scumbag"), (None, None), (5, "x" * 300_000), (6, "123 !!")]
    df = spark.createDataFrame([(*r, None, "old", 1, 2, None) for r in rows], ROWS)
    out = X.score(df, fitted)
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert out.columns == ["doc_id", "text", "y", "l_id", "at", "words", "score"]
    by = {(r.doc_id, len(r.text or "")): r.score for r in got}
    assert by[(4, len(long))] < 0.5 < by[(None, 28)] and by[(4, len(long) + 400 * len(" idiot scumbag. idiot."))] > 0.5
    assert by[(1, 0)] == by[(2, 0)] == by[(6, 6)] < 0.5


def test_without_labels_or_rows(spark, machine):
    docs, labels, _, _ = machine
    nothing = spark.createDataFrame([], LABELS)
    assert X.fit(docs, nothing) is None and X.fit(docs, labels.where("toxic = 0")) is None
    assert X.fit(docs.limit(0), labels) is None
    assert {r.score for r in X.score(docs.limit(5), None).collect()} == {0.0}
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (1, 1, None), (0, 0, 0), (0, 0, 0)], LABELS))
    assert X.fit(docs, odd) is not None


def test_given_documents(spark):
    """Held-out accuracy on the given tables, whose labels hold some noise."""
    sf = "/root/testdata/sf0.1"
    from shardflow.llm.queries import QUERIES

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = QUERIES["op12_toxicity"](spark, sf)
    got = out.join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()
    n = {(r.toxic, r.predicted): r.n for r in got}
    assert n[(1, 1)] / (n[(1, 1)] + n.get((1, 0), 0)) > 0.8
    assert n.get((0, 1), 0) / (n[(0, 0)] + n.get((0, 1), 0)) < 0.02
