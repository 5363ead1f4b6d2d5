"""Long regular words that a polynomial modulo 2**64 cannot tell apart, whatever its base."""

import numpy as np
import pyarrow as pa
import pytest
from test_ngram_join import brute as linked
from test_substring_dedup import brute as repeated

from shardflow.llm import ngram_join, sentencepiece_codec, substring_dedup, token_codes
from shardflow.llm.queries import public_model, public_tokenizer
from shardflow.llm.words import Words
from shardflow.scratch import scratch_path


def thue_morse(n, a, b):
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


ONE, OTHER = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")


@pytest.mark.parametrize("n", [64, 128, 512, 1024, 4096])
def test_hashes_differ(n):
    words = Words(pa.array([" ".join([thue_morse(n, "a", "b"), thue_morse(n, "b", "a"), "a" * n, "a" * (n - 1) + "b"])]))
    assert len(set(words.hashes().tolist())) == 4
    assert words.hashes(lower=True).tolist() == Words(pa.array([words.bytes.tobytes().decode().upper()])).hashes(lower=True).tolist()


@pytest.fixture(scope="module")
def rows():
    same = [f"w{k}" for k in range(19)]
    return [(1, " ".join([ONE, *same])), (2, " ".join([OTHER, *same])), (3, " ".join([ONE, ONE, OTHER, "x y z"])), (4, " ".join([ONE, *same]))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_windows(docs, rows):
    from pyspark.sql import functions as F

    out = substring_dedup.without_repeats(docs, window=20).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    got = sorted(map(tuple, out.collect()))
    assert got == repeated(rows, 20) and [r[2] for r in got] == [0, 0, 0, 20]


def test_links(docs, rows):
    got = {tuple(r) for r in ngram_join.ngram_jaccard_groups(docs, n=1, num=99, den=100).collect()}
    assert got == linked(rows, 1, 99, 100)


def test_token_ids(spark, docs, rows):
    import zlib

    import tokenizers

    with open(public_tokenizer("word_bpe_49k.json"), encoding="utf-8") as f:
        library = tokenizers.Tokenizer.from_str(text := f.read())
    path = scratch_path(spark, "tokens")
    token_codes.write_tokens(docs, path, text, end=1, by_word=True)
    got = {r.doc_id: r.ids_crc32 for r in token_codes.read_documents(spark, path, digest=True).collect()}
    for i, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        assert got[i] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces(docs, rows):
    import sentencepiece

    model = public_model()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = {r.doc_id: list(r.ids) for r in sentencepiece_codec.encode_texts(docs, model, round_trip="round_trip").collect()}
    assert got == {i: library.encode(t) for i, t in rows}
