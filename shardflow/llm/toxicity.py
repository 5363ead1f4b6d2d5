"""Toxicity by a support vector machine on a subsequence string kernel.

The kernel of two words adds, over all strings of three letters that both hold as
subsequences, ``DECAY`` to the power of the lengths the strings take up in both, and is
divided by the roots of the words' own sums.  A word with letters put in, left out or
doubled, or with another ending, stays near the word it comes from.

Landmarks are words and beginnings of words (Nystroem): a sentence, as the set of its
words, is described by the sum of their kernels with each of them, turned by the inverse
root of the landmarks' own kernel.  A linear machine is trained on labelled sentences: only
documents have labels, so a toxic one is represented by the sentence that the
machine finds worst, in turns, while every sentence of a clean one is clean.  A document's
score is a logistic curve over its two worst sentences and its worst passage, wherever it
stands: the sum of the bad sentences in relation to the words.  A toxic passage is not
made up for by the rest of a long text, but one near word in a passage may be chance.

The words of a text are its runs without white space, lower-cased, letters
only; three or more single letters in a row are read as one word as well.  Words of
more than ``WINDOW`` letters, these too, are looked at in overlapping windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardflow.llm.words import pieces

ORDER, DECAY = 3, 0.6
#: A kernel value below it counts as none.
NEAR = 0.45
WINDOW = 32
#: Words of a passage.
PASSAGE = 200
#: Letters of a text that travel through the kernel at a time.
PIECE_BYTES = 4 << 20
#: Beginnings of words that may become landmarks.
STEMS = range(4, 10)
#: Of one document so many sentences, the nearest to landmarks, are used in fitting.
SENTENCES = 64
#: A landmark is so many times as frequent among toxic documents as among clean ones.
LEAST_RATIO = 3.0


def steps(n: int) -> np.ndarray:
    """``DECAY`` to the gap from each earlier place to each place."""
    gap = np.arange(n)[:, None] - np.arange(n)[None, :] - 1
    return np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0.0)


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The kernel of rows of ``a`` with rows of ``b``: letters by code, words of one length each."""
    match = (a[:, :, None] == b[:, None, :]) * DECAY**2
    left, right = steps(a.shape[1]), steps(b.shape[1]).T
    held = match
    for _ in range(ORDER - 1):
        held = match * (left @ held @ right)
    return held.sum(axis=(1, 2))


def codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)


def own(word: str) -> float:
    return float(kernel(codes(word)[None], codes(word)[None])[0])


@dataclass(frozen=True)
class Words:
    """The words of some texts: how many each has, distinct words by length, and text, sentence and word of every occurrence.

    ``span`` is the place of each sentence in its text, in words, end exclusive.
    """

    count: np.ndarray
    distinct: list[np.ndarray]
    row: np.ndarray
    sentence: np.ndarray
    word: np.ndarray
    span: np.ndarray

    @staticmethod
    def of(texts: list[str]) -> Words:
        lowered = [t.lower() for t in texts]
        letters = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        present = np.flatnonzero(np.bincount(letters)) if len(letters) else np.zeros(0, np.int64)
        table = np.zeros((int(present[-1]) + 1 if len(present) else 1, 3), bool)
        for c in present.tolist():
            table[c] = chr(c).isalpha(), chr(c).isspace(), chr(c) in ".!?"
        alpha, space, stop = (table[letters, k] if len(letters) else np.zeros(0, bool) for k in range(3))
        edge = np.zeros(len(letters) + 1, bool)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in lowered])]).astype(np.int64)
        edge[bounds] = True
        solid = np.zeros(len(letters) + 2, bool)
        solid[1:-1] = ~space
        start = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
        end = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
        text = np.searchsorted(bounds, start, side="right") - 1
        # A sentence goes to the next word that ends in a stop, or to the end of the text.
        closes = stop[end - 1] if len(end) else np.zeros(0, bool)
        begins = np.ones(len(start), bool)
        begins[1:] = closes[:-1] | (text[1:] != text[:-1])
        sentence = np.cumsum(begins) - 1
        count = np.bincount(text, minlength=len(texts))
        opens = np.flatnonzero(begins)
        span = np.stack([opens, np.append(opens, len(start))[1:]], axis=1) - (np.cumsum(count) - count)[text[opens]][:, None]
        kept = np.concatenate([[0], np.cumsum(alpha)])
        lo, hi = kept[start], kept[end]  # in the letters alone
        letters = letters[alpha]
        long = [(lo[k], hi[k], k) for k in np.flatnonzero(hi - lo > WINDOW).tolist()]
        whole = np.flatnonzero((hi - lo >= ORDER) & (hi - lo <= WINDOW))
        parts = [(lo[whole], hi[whole], whole)]
        if len(start):
            # Runs of single letters inside one sentence.
            single, none = hi - lo == 1, np.zeros(1, bool)
            first = np.flatnonzero(single & (begins | ~np.concatenate([none, single[:-1]])))
            last = np.flatnonzero(single & np.concatenate([begins[1:] | ~single[1:], ~none]))
            run, far = last - first >= 2, last - first >= WINDOW
            parts.append((lo[first[run & ~far]], hi[last[run & ~far]], first[run & ~far]))
            long += [(lo[a], hi[b], a) for a, b in zip(first[far].tolist(), last[far].tolist())]
        for a, b, k in long:
            at = np.arange(a, b - WINDOW // 2, WINDOW // 2)
            parts.append((at, np.minimum(at + WINDOW, b), np.full(len(at), k)))
        lo, hi, of = (np.concatenate(x) for x in zip(*parts))
        size, distinct, ids, places, base = hi - lo, [], [], [], 0
        for n in np.unique(size).tolist():
            here = np.flatnonzero(size == n)
            found = letters[lo[here][:, None] + np.arange(n)]
            coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * n), len(here), [None, pa.py_buffer(np.ascontiguousarray(found))]).dictionary_encode()
            seen = np.frombuffer(coded.dictionary.buffers()[1], np.uint32)[: len(coded.dictionary) * n].reshape(-1, n)
            distinct.append(seen)
            ids.append(coded.indices.to_numpy().astype(np.int64) + base)
            places.append(here)
            base += len(seen)
        where = np.concatenate(places) if places else np.zeros(0, np.int64)
        at = of[where] if len(where) else np.zeros(0, np.int64)
        return Words(count, distinct, text[at], sentence[at], np.concatenate(ids) if ids else np.zeros(0, np.int64), span)

    def strings(self) -> list[str]:
        return [row.tobytes().decode("utf-32-le", "surrogatepass") for part in self.distinct for row in part]


@dataclass(frozen=True)
class Landmarks:
    """Landmarks, and which sets of their letters leave a kernel of ``NEAR`` possible.

    A word without some letters of a landmark shares only the subsequences that do
    without them, so by Cauchy-Schwarz the kernel is at most the root of their share.
    """

    words: list[str]
    norm: np.ndarray
    alphabet: np.ndarray
    possible: list[tuple[list[int], np.ndarray]]

    @staticmethod
    def of(words: list[str]) -> Landmarks:
        alphabet = np.unique(np.concatenate([codes(w) for w in words])) if words else np.zeros(0, np.uint32)
        possible = []
        for word in words:
            own_letters = np.unique(codes(word))
            sets = (np.arange(1 << len(own_letters))[:, None] >> np.arange(len(own_letters))) & 1
            spot = np.searchsorted(own_letters, codes(word))
            # A letter that is not there becomes one that matches nothing.
            a = np.where(sets[:, spot] == 1, codes(word)[None].astype(np.int64), -1)
            b = np.where(a < 0, -2, a)
            share = kernel(a, b) / own(word)
            possible.append((np.searchsorted(alphabet, own_letters).tolist(), np.sqrt(np.maximum(share, 0)) >= NEAR - 1e-9))
        return Landmarks(words, np.sqrt([own(w) for w in words]) if words else np.zeros(0), alphabet, possible)

    def near(self, words: Words, block: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, landmark and kernel of all pairs that are near."""
        out, base = [], 0
        for part in words.distinct:
            n = part.shape[1]
            spot = np.minimum(np.searchsorted(self.alphabet, part), max(len(self.alphabet) - 1, 0))
            if not len(self.alphabet):
                break
            known = self.alphabet[spot] == part
            has = np.zeros((len(self.alphabet), len(part)), bool)
            for k in range(n):
                has[spot[:, k][known[:, k]], np.flatnonzero(known[:, k])] = True
            self_sum: np.ndarray | None = None
            for j, (letters, table) in enumerate(self.possible):
                key = np.zeros(len(part), np.int32)
                for bit, letter in enumerate(letters):
                    key |= has[letter].astype(np.int32) << bit
                maybe = np.flatnonzero(table[key])
                if not len(maybe):
                    continue
                if self_sum is None:
                    self_sum = np.zeros(len(part))
                target = codes(self.words[j])
                for at in range(0, len(maybe), block):
                    some = maybe[at : at + block]
                    todo = some[self_sum[some] == 0]
                    if len(todo):
                        self_sum[todo] = kernel(part[todo], part[todo])
                    value = kernel(part[some], np.broadcast_to(target, (len(some), len(target)))) / (self.norm[j] * np.sqrt(self_sum[some]))
                    good = value >= NEAR
                    out.append((some[good] + base, np.full(int(good.sum()), j), value[good]))
            base += len(part)
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*out))

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, sentence, landmark and the sum of near words' kernels, for every sentence with a near word; words of each text; span of each sentence."""
        words = Words.of(texts)
        word, landmark, value = self.near(words)
        order = np.argsort(word, kind="stable")
        word, landmark, value = word[order], landmark[order], value[order]
        total = sum(len(p) for p in words.distinct)
        first = np.searchsorted(word, np.arange(total + 1))
        many = (first[1:] - first[:-1])[words.word]
        of = np.repeat(np.arange(len(many)), many)
        at = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[words.word], many)
        key = words.sentence[of] * max(1, len(self.words)) + landmark[at]
        unique, back = np.unique(key, return_inverse=True)
        total = np.bincount(back, value[at], len(unique))
        text = np.zeros(len(unique), np.int64)
        text[back] = words.row[of]
        return text, unique // max(1, len(self.words)), unique % max(1, len(self.words)), total, words.count, words.span


def worst_passage(text: np.ndarray, total: np.ndarray, span: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The largest sum of bad sentences in ``PASSAGE`` words of each text, or in one longer sentence, by its words."""
    bad = np.flatnonzero(total > 0)
    bad = bad[np.lexsort((span[bad, 0], text[bad]))]
    text, total, span = text[bad], total[bad], span[bad].astype(np.int64)
    apart = int(words.max(initial=0)) + PASSAGE + 1  # between the places of two texts
    upto = np.searchsorted(text * apart + span[:, 1], text * apart + span[:, 0] + PASSAGE, side="right")
    sums = np.concatenate([[0.0], np.cumsum(total)])
    least = np.minimum(words[text], PASSAGE)
    alone = total / (np.maximum(least, span[:, 1] - span[:, 0]) + 10)
    share = np.maximum(alone, (sums[np.maximum(upto, np.arange(len(text)))] - sums[:-1]) / (least + 10))
    out = np.zeros(len(words))
    np.maximum.at(out, text, share)
    return out


def evidence(text: np.ndarray, total: np.ndarray, span: np.ndarray, words: np.ndarray, bias: float) -> np.ndarray:
    """What a document is judged by, from the values of its sentences with near words; the others have the bias."""
    out = np.full((len(words), 3), bias)
    out[:, 2] = np.log1p(100 * worst_passage(text, total, span, words))
    order = np.lexsort((-total, text))
    text, total = text[order], total[order]
    place = np.arange(len(text)) - np.searchsorted(text, text)
    for k in (0, 1):
        here = place == k
        out[text[here], k] = np.maximum(total[here], bias)
    return out


@dataclass(frozen=True)
class Machine:
    """Landmarks, their weights in a sentence, the bias, and the logistic curve of a document."""

    landmarks: Landmarks
    weight: np.ndarray
    bias: float
    curve: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        text, sentence, landmark, value, words, span = self.landmarks.sentences([t or "" for t in texts])
        first = np.flatnonzero(np.diff(sentence, prepend=-1))
        total = np.add.reduceat(self.weight[landmark] * value, first) + self.bias if len(first) else np.zeros(0)
        found = evidence(text[first], total, span[sentence[first]], words, self.bias)
        return 1 / (1 + np.exp(-np.clip(found @ self.curve[:-1] + self.curve[-1], -50, 50)))


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps; ``y`` is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        active = y * (x @ w) < 1
        a, c = x[active], cost[active]
        new = np.linalg.solve(ridge + (a * c[:, None]).T @ a, (a * c[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weights and shift of the curve through labels 0 and 1, which are pulled in as Platt does.

    More evidence never lowers a score: a column whose weight would be negative is left out.
    """
    good, bad = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.hstack([x, np.ones((len(x), 1))])
    used = np.ones(x.shape[1], bool)
    while True:
        part, ridge, w = x[:, used], 1e-2 * np.eye(int(used.sum())), np.zeros(int(used.sum()))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -50, 50)))
            step = np.linalg.solve((part * (p * (1 - p))[:, None]).T @ part + ridge, part.T @ (target - p) - ridge @ w)
            w = w + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-9:
                break
        out = np.zeros(x.shape[1])
        out[used] = w
        if (out[:-1] >= 0).all():
            return out
        used[:-1] &= out[:-1] >= 0


def labelled(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, per_label: int) -> DataFrame:
    """``text, y`` of about ``per_label`` documents of each label, chosen by a hash of their id."""
    marks = labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id).alias("l_id")).agg(F.max(label).cast("int").alias("y"))
    wanted = marks.join(docs.select(F.col(id).alias("l_id")).distinct(), "l_id", "left_semi")
    sizes = {r.y: r.n for r in wanted.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
    share = lambda y: F.lit(int(min(1.0, per_label / max(1, sizes.get(y, 0))) * (1 << 30)))
    chosen = marks.where(F.pmod(F.xxhash64("l_id", F.lit(12)), F.lit(1 << 30)) < F.when(F.col("y") == 1, share(1)).otherwise(share(0)))
    rows = docs.select(F.col(id).alias("l_id"), F.col(text).alias("text")).where("text is not null")
    # About 2 * per_label ids and labels, whatever the tables hold.
    return rows.join(F.broadcast(chosen), "l_id").select("text", "y")


def candidates(rows: DataFrame, most: int) -> list[tuple[str, int, int]]:
    """The ``most`` words and beginnings of words that tell toxic documents apart best, with their documents of each label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                y = np.array(piece.column("y").to_pylist())
                words = Words.of(piece.column("text").to_pylist())
                pairs = np.unique(words.row * max(1, sum(map(len, words.distinct))) + words.word)
                names = words.strings()
                n = max(1, len(names))
                held: dict[int, set[str]] = {}
                for at in pairs.tolist():
                    w = names[at % n]
                    held.setdefault(at // n, set()).update([w, *[w[:k] for k in STEMS if k < len(w)]])
                counts = (Counter(), Counter())
                for row, found in held.items():
                    counts[y[row]].update(found)
                every = list(counts[0] | counts[1])
                yield pa.RecordBatch.from_pydict({"word": every, "clean": [counts[0][w] for w in every], "toxic": [counts[1][w] for w in every]}, pa.schema([("word", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())]))

    sums = rows.mapInArrow(run, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    good, bad = F.lit(float(max(1, rows.where("y = 1").count()))), F.lit(float(max(1, rows.where("y = 0").count())))
    gain = F.col("toxic") / good * F.log((F.col("toxic") / good + 1e-4) / (F.col("clean") / bad + 1e-4))
    often = F.col("toxic") / good >= LEAST_RATIO * F.col("clean") / bad
    ranked = sums.where((F.col("toxic") >= 3) & often & (F.length("word") <= 12)).withColumn("gain", gain)
    # Of stems in the same documents the longest tells most.
    return [(r.word, r.toxic, r.clean) for r in ranked.orderBy(F.col("gain").desc(), F.length("word").desc(), "word").limit(most).collect()]


def spread_out(found: list[tuple[str, int, int]], most: int, apart: float = 0.7) -> list[str]:
    """Words in order, without those that come near one before."""
    out: list[str] = []
    for word, toxic, clean in found:
        if len(out) == most:
            break
        a = codes(word)[None]
        if all(kernel(a, codes(w)[None])[0] < apart * np.sqrt(own(w) * own(word)) for w in out):
            out.append(word)
    return out


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    *,
    per_label: int = 3000,
    landmarks: int = 96,
) -> Machine | None:
    """A machine from about ``per_label`` documents of each label; none without documents of both.

    What reaches the driver is bounded by the parameters: the candidates for
    landmarks, and ``SENTENCES`` sparse sentences of each chosen document.  A document
    with labels of both kinds is toxic; rows without id, text or label are not used.
    """
    rows = labelled(docs, labels, id, text, label, per_label)
    marks = Landmarks.of(spread_out(candidates(rows, 20 * landmarks), landmarks))
    if not marks.words:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                y, out = piece.column("y").to_pylist(), []
                text_at, sentence, landmark, value, count, span = marks.sentences(piece.column("text").to_pylist())
                first = np.append(np.flatnonzero(np.diff(sentence, prepend=-1)), len(sentence))
                by: dict[int, list] = {}
                for lo, hi in zip(first[:-1], first[1:]):
                    by.setdefault(int(text_at[lo]), []).append((float(value[lo:hi].sum()), landmark[lo:hi].tolist(), value[lo:hi].tolist(), span[sentence[lo]].tolist()))
                for k, label_here in enumerate(y):
                    best = sorted(by.get(k, []), reverse=True)[:SENTENCES]
                    out.append({"y": label_here, "words": int(count[k]), "at": [s[1] for s in best], "value": [s[2] for s in best], "span": [s[3] for s in best]})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("y", pa.int32()), ("words", pa.int64()), ("at", pa.list_(pa.list_(pa.int64()))), ("value", pa.list_(pa.list_(pa.float64()))), ("span", pa.list_(pa.list_(pa.int64())))]))

    sample = rows.mapInArrow(run, "y int, words long, at array<array<long>>, value array<array<double>>, span array<array<long>>").collect()
    sample.sort(key=lambda r: (r.y, r.words, r.at, r.value, r.span))
    y = np.array([r.y for r in sample])
    if not (y == 1).any() or not (y == 0).any():
        return None
    doc, span, x = [], [], np.zeros((sum(1 + len(r.at) for r in sample), len(marks.words)))
    for k, r in enumerate(sample):
        for at, value, place in [([], [], [0, 0]), *zip(r.at, r.value, r.span)]:  # the first stands for all sentences without a near word
            x[len(doc), at] = value
            doc.append(k)
            span.append(place)
    doc, span = np.array(doc), np.array(span)
    # The landmarks' own kernel: what a landmark says of a sentence follows from all of them.
    a = [codes(w)[None] for w in marks.words]
    gram = np.array([[kernel(p, q)[0] for q in a] for p in a]) / np.outer(marks.norm, marks.norm)
    values, vectors = np.linalg.eigh(gram)
    root = vectors @ np.diag(np.maximum(values, 1e-3) ** -0.5) @ vectors.T
    z, toxic = x @ root, y[doc] == 1
    worst = x.sum(axis=1)
    weight, bias = np.zeros(x.shape[1]), 0.0
    for _ in range(4):
        order = np.lexsort((-worst, doc))
        witness = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
        used = np.concatenate([witness[toxic[witness]], np.flatnonzero(~toxic)])
        side = np.where(toxic[used], 1.0, -1.0)
        cost = np.where(side > 0, 1.0, (side > 0).sum() / max(1, (side < 0).sum()))
        w, bias = svm(z[used], side, cost)
        weight = root @ w
        worst = x @ weight + bias
    near = x.any(axis=1)
    found = evidence(doc[near], worst[near], span[near], np.array([r.words for r in sample]), bias)
    return Machine(marks, weight, bias, logistic(found, y))


def score(docs: DataFrame, machine: Machine | None, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every whole text; a column of that name is replaced.

    A null or empty text has the score of a sentence without any near word; without
    a machine every score is 0.
    """
    kept = docs.drop(name)
    if machine is None:
        return kept.withColumn(name, F.lit(0.0))
    fields = [*kept.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text, PIECE_BYTES):
                found = machine.scores(piece.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(found, pa.float64())], fields)

    return kept.mapInArrow(run, kept.withColumn(name, F.lit(0.0)).schema)


def predicted(score: str = "score") -> Column:
    return (F.col(score) >= 0.5).cast("int")
