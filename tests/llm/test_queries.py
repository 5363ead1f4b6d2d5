"""The registered queries on whole tables: against SQL, or against a brute-force version."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from check import compare, connect
from test_ngram_join import brute as linked
from test_substring_dedup import brute as repeated
from test_token_codes import expected

from shardflow.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert compare(spark, connect(SF), SF, QUERIES[name], ORACLES[name]) is None


@pytest.fixture(scope="module")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.collect()]


def test_op1(spark, rows):
    assert {tuple(r) for r in QUERIES["op1_ngram_jaccard_join"](spark, SF).collect()} == linked(rows, 4, 85, 100)


def test_op2(spark, rows):
    got = sorted((tuple(r) for r in QUERIES["op2_token_codes"](spark, SF).collect()), key=lambda r: r[1])
    assert got == [(i, s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, s, ids in expected(rows)]


def test_op4(spark, rows):
    assert sorted(tuple(r) for r in QUERIES["op4_substring_dedup"](spark, SF).collect()) == repeated(rows, 20)


def test_op5(spark, rows):
    got = QUERIES["op5_sentencepiece"](spark, SF).collect()
    assert len(got) == len(rows) and all(r.same_as_sentencepiece and r.round_trip for r in got)


def test_op9_digest(spark, rows):
    got = {r.doc_id: r.text_sha256 for r in QUERIES["op9_exact_dedup"](spark, SF).collect()}
    want = {k: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest() for k, text in rows}
    assert got == want
