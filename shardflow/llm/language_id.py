"""Language ID with hyperdimensional profiles.

Every letter has a random vector of -1 and 1, made from its code point.  A
run of three letters is bound into one vector: the first letter's, rotated twice,
times the second's, rotated once, times the third's.  A text is the sum of the
vectors of its runs, a language the sum over its texts, and a text speaks
the language whose sum is nearest by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardflow.llm.words import U64, mix, pieces

UNKNOWN = "und"


def letter_vectors(codes: np.ndarray, size: int) -> np.ndarray:
    """A row of -1 and 1 for every code point; 0 stands for a word's edge."""
    words = np.arange(size // 64, dtype=U64)
    bits = mix(mix(codes.astype(U64), 41)[:, None] + words, 42)
    return (np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1).reshape(len(codes), size)


class Runs:
    """Runs of three letters of a list of texts, counted by text; a word's edges count as letters."""

    def __init__(self, texts: list[str]):
        padded = [f" {t.lower()} " for t in texts]
        codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in padded])
        present = np.flatnonzero(np.bincount(codes)) if len(codes) else np.zeros(0, np.int64)
        letters = np.array([c for c in present if chr(c).isalpha()], np.int64)
        self.alphabet = np.concatenate([[0], letters])
        place = np.zeros(int(present[-1]) + 1 if len(present) else 1, np.int64)
        place[letters] = np.arange(1, len(letters) + 1)
        code = place[codes] if len(codes) else np.zeros(0, np.int64)
        stay = code > 0
        stay[1:] |= code[:-1] > 0
        code, row = code[stay], row[stay]
        # Every word now has an edge after it, and before it but for the first one.
        code = np.concatenate([[0], code])
        row = np.concatenate([[0], row])
        k = len(self.alphabet)
        middle = 1 + np.flatnonzero(code[1:-1] > 0) if len(code) > 2 else np.zeros(0, np.int64)
        key = (code[middle - 1] * k + code[middle]) * k + code[middle + 1]
        self.key, self.row, self.k = key, row[middle], k

    def counted(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct runs of each group of texts: group, run, how often."""
        both, count = np.unique(group[self.row] * self.k**3 + self.key, return_counts=True)
        return both // self.k**3, both % self.k**3, count

    def bundles(self, groups: int, group: np.ndarray, size: int, block: int = 4096) -> np.ndarray:
        """The sum of run vectors of each group of texts."""
        out = np.zeros((groups, size))
        if not len(self.key):
            return out
        of, run, count = self.counted(group)
        base = letter_vectors(self.alphabet, size)
        first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
        a, b, c = run // self.k**2, run // self.k % self.k, run % self.k
        edges = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
        for lo, hi in zip(edges[:-1], edges[1:]):
            for at in range(lo, hi, block):
                s = slice(at, min(hi, at + block))
                bound = first[a[s]]
                bound *= second[b[s]]
                bound *= base[c[s]]
                out[of[lo]] += count[s].astype(np.float32) @ bound.astype(np.float32)
        return out


@dataclass(frozen=True)
class Profiles:
    """Languages in order and their sums of vectors."""

    languages: list[str]
    vectors: np.ndarray

    def answers(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and cosine (0 at least) of every text."""
        runs = Runs([t or "" for t in texts])
        size = self.vectors.shape[1]
        vectors = runs.bundles(len(texts), np.arange(len(texts)), size)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        norm = np.linalg.norm(vectors, axis=1)
        unit = self.vectors / np.maximum(np.linalg.norm(self.vectors, axis=1, keepdims=True), 1e-300)
        cosine = vectors @ unit.T / np.maximum(norm, 1e-300)[:, None]
        best = np.argmax(cosine, axis=1)
        has = np.zeros(len(texts), bool)
        has[runs.row] = True
        names = [self.languages[b] if h else UNKNOWN for b, h in zip(best, has)]
        return names, np.where(has, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0)


def held_out(id: str = "doc_id", folds: int = 5) -> Column:
    """Whether a document is kept from training: its crc32 falls in fold 0."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % folds == 0, F.lit(False))


def fit(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", *, size: int = 1024, per_language: int = 5000
) -> Profiles:
    """Profiles of the labelled texts.

    About ``per_language`` texts of a language are read, chosen by a hash of
    their id (all, if there are fewer); that bounds the work of fitting.
    Whole texts are summed.  Rows without text or label are not used.  What
    reaches the driver is one vector of ``size`` numbers for a language.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    # One number for a language, as the profiles are one vector for a language; texts are not shuffled.
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Profiles([], np.zeros((0, size)))
    limit = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(per_language / n * (1 << 30)))])
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) < F.element_at(limit, F.col("lang"))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 19):
                names = piece.column("lang").to_pylist()
                known = sorted(set(names))
                group = np.array([known.index(n) for n in names])
                for name, vector in zip(known, Runs(piece.column("text").to_pylist()).bundles(len(known), group, size)):
                    sums[name] = sums.get(name, 0) + np.rint(vector).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]}, pa.schema([("lang", pa.string()), ("vector", pa.list_(pa.int64()))]))

    parts = chosen.mapInArrow(run, "lang string, vector array<long>").select("lang", F.posexplode("vector").alias("at", "value"))
    found: dict[str, np.ndarray] = {}
    for row in parts.groupBy("lang", "at").agg(F.sum("value").alias("value")).collect():
        found.setdefault(row.lang, np.zeros(size))[row.at] = row.value
    languages = sorted(found)
    return Profiles(languages, np.array([found[n] for n in languages]).reshape(len(languages), size))


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language of every whole text and its cosine.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text if no language was learned.  Of equally near languages the first by name
    is taken.  A column of ``docs`` with a name used here is replaced.
    """
    kept = docs.drop(lang_pred, score)
    fields = [*kept.columns, lang_pred, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text, 1 << 19):
                names, scores = profiles.answers(piece.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], fields)

    schema = kept.withColumn(lang_pred, F.lit("")).withColumn(score, F.lit(0.0)).schema
    return kept.mapInArrow(run, schema)
