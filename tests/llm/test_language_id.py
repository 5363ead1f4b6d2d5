import zlib

import numpy as np
from pyspark.sql import functions as F

from shardflow.llm import language_id
from shardflow.llm.queries import QUERIES

LANGUAGES = {"en", "de", "fr", "es"}


def test_held_out_accuracy(spark, documents):
    got = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.lang_pred in LANGUAGES for r in rows)
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert np.mean(held) > 0.98


def test_prediction_takes_text_alone(spark, documents):
    profiles = language_id.fit(documents)
    one = language_id.identify(documents, profiles).select("doc_id", "lang_pred", "score")
    other = documents.select((F.col("doc_id") * 0).alias("doc_id"), "text", F.lit("xx").alias("lang"))
    two = language_id.identify(other, profiles).select("lang_pred", "score")
    assert sorted((r.lang_pred, r.score) for r in one.collect()) == sorted(map(tuple, two.collect()))


def test_bundles_follow_the_definition():
    text, size = "Ab, élan!", 256
    codes = {c: language_id.letter_vectors(np.array([0 if c == " " else ord(c)]), size)[0] for c in " abélan"}
    total = np.zeros(size)
    for word in (" ab ", " élan "):
        for k in range(len(word) - 2):
            total += np.roll(codes[word[k]], 2) * np.roll(codes[word[k + 1]], 1) * codes[word[k + 2]]
    got = language_id.Runs([text, "", "12 3"]).bundles(3, np.arange(3), size)
    assert (got[0] == total).all() and not got[1:].any()


def test_odd_rows_and_empty_table(odd, nothing):
    profiles = language_id.fit(odd)
    rows = language_id.identify(odd, profiles).collect()
    for r in rows:
        if any(c.isalpha() for c in r.text or ""):
            assert r.lang_pred in ("en", "fr") and 0 <= r.score <= 1
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)
    nobody = language_id.fit(nothing)
    assert nobody.languages == [] and language_id.identify(nothing, profiles).collect() == []
    assert {r.lang_pred for r in language_id.identify(odd, nobody).collect()} == {"und"}
