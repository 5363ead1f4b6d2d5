import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shardflow.llm import token_codes
from shardflow.scratch import scratch_path

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [8, 4, 3])
def test_codes_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 511, 512, 513, 5000):
        ids = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        codes = token_codes.Codes(token_codes.pack(ids, bits))
        order = rng.permutation(n)
        assert len(codes) == n and (codes.all() == ids).all() and (codes.at(order) == ids[order]).all()
    with pytest.raises(IndexError):
        codes.at([5000])


def expected(rows):
    library = Tokenizer.from_file(FILE)
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((i, start, ids))
        start += len(ids)
    return out


STRANGE = [
    (50, "Ünïcode I'm don't  ΑΣ ΣΑΣ. ﬁ１２"), (51, "<|endoftext|> x<|startoftext|>y a<|endoftext|>"), (52, "日本 語　x y z"), (53, "\x1c a\x1db \x85 é ́x"),
    (54, "🙂👩‍👩‍👧 \x00\x01"), (55, "İstanbul ǅ ß ẞ"), (-3, "before"),
]


@pytest.mark.parametrize("by_word,segment", [(True, 1 << 20), (True, 50), (False, 1000)])
def test_files_hold_what_the_library_says(spark, odd, odd_rows, by_word, segment):
    with open(FILE, encoding="utf-8") as f:
        model = f.read()
    rows = [(r[0], r[1]) for r in odd_rows] + STRANGE
    df = odd.select("doc_id", "text").union(spark.createDataFrame(STRANGE, "doc_id long, text string"))
    path = scratch_path(spark, "codes")
    token_codes.write_tokens(df, path, model, end=1, by_word=by_word, segment=segment)
    want = expected(rows)
    got = sorted((tuple(r) for r in token_codes.read_documents(spark, path).collect()), key=lambda r: r[1])
    assert [(i, s, ids) for i, s, _, ids in got] == want and all(n == len(ids) for _, _, n, ids in got)
    whole = np.array([x for _, _, ids in want for x in ids])
    if segment > 100:
        digests = {r.start: r.ids_crc32 for r in token_codes.read_documents(spark, path, digest=True).collect()}
        assert digests == {s: zlib.crc32(np.array(ids, "<u4").tobytes()) for _, s, ids in want}
    places = [0, 1, len(whole) - 1, len(whole), -1, 777, 777, 40_000]
    asked = token_codes.tokens_at(spark, path, spark.createDataFrame([(p,) for p in places], "position long"), span=5000)
    assert sorted(map(tuple, asked.collect())) == [(p, whole[p]) for p in sorted(set(places)) if 0 <= p < len(whole)]


def test_empty_table(spark, nothing):
    with open(FILE, encoding="utf-8") as f:
        model = f.read()
    path = scratch_path(spark, "codes")
    token_codes.write_tokens(nothing, path, model, end=1)
    assert token_codes.read_documents(spark, path).collect() == []
