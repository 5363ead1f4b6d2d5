import public_tokenizers
import pytest
import sentencepiece

from shardflow.llm import sentencepiece_codec, sentencepiece_model

with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
    MODEL = f.read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
STRANGE = ["", " ", "  a", "a  b ", "\ttab\nnew", "日本 語x", "<s> </s> <0x41> <unk>", "🙂é", "\x00x", " \n ", "a" * 5000]


def test_whole_texts_agree_with_the_library(documents):
    tokenizer = sentencepiece_model.tokenizer(sentencepiece_model.parse(MODEL))
    texts = [r.text for r in documents.select("text").collect()] + STRANGE
    assert [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)] == LIBRARY.encode(texts)


def test_units_agree_with_whole_texts():
    encoder = sentencepiece_codec.Encoder(MODEL, True)
    assert encoder.plain
    texts = [*STRANGE, "a▁b ▁ c"]
    ids, sizes, agree = encoder(texts)
    assert agree.all() and sizes.tolist() == [len(LIBRARY.encode(t)) for t in texts]
    assert ids.tolist() == [i for t in texts for i in LIBRARY.encode(t)]


def test_odd_rows_and_empty_table(odd, odd_rows, nothing):
    out = sentencepiece_codec.decode_ids(sentencepiece_codec.encode_texts(odd, MODEL), MODEL).collect()
    assert sorted((r.text or "", r.ids) for r in out) == sorted((r[1] or "", LIBRARY.encode(r[1] or "")) for r in odd_rows)
    assert all(r.verified and r.decoded == (r.text or "") for r in out)
    one_pass = sentencepiece_codec.encode_texts(odd, MODEL, round_trip="back").collect()
    assert sorted((r.text or "", r.ids) for r in one_pass) == sorted((r.text or "", r.ids) for r in out)
    assert all(r.verified and r.back for r in one_pass)
    empty = sentencepiece_codec.decode_ids(sentencepiece_codec.encode_texts(nothing, MODEL), MODEL)
    assert empty.collect() == [] and empty.columns == [*nothing.columns, "ids", "verified", "decoded"]


def test_nulls_in_ids(spark):
    rows = [(1, LIBRARY.encode("some text")), (2, None), (3, []), (4, [None, *LIBRARY.encode("other"), None])]
    out = sentencepiece_codec.decode_ids(spark.createDataFrame(rows, "doc_id long, ids array<int>"), MODEL)
    assert {r.doc_id: r.decoded for r in out.collect()} == {1: "some text", 2: "", 3: "", 4: "other"}


def _message(number, data):
    size, out = len(data), bytes([number << 3 | 2])
    while size > 127:
        out, size = out + bytes([size & 127 | 128]), size >> 7
    return out + bytes([size]) + data


def unigram(extra_spaces_go):
    """A small unigram model, written field by field."""
    import struct

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("▁", -2.0, 1), ("▁the", -1.5, 1), ("a", -3.0, 1), ("b", -3.1, 1), ("ab", -4.0, 1), ("▁ab", -5.5, 1), ("t", -4.0, 1), ("h", -4.1, 1), ("e", -4.2, 1)]
    pieces += [(f"<0x{k:02X}>", 0.0, 6) for k in range(256)]
    out = b""
    for text, score, kind in pieces:
        out += _message(1, _message(1, text.encode()) + b"\x15" + struct.pack("<f", score) + bytes([0x18, kind]))
    out += _message(2, bytes([0x18, 1]) + bytes([0x98, 0x02, 1]))
    return out + _message(3, _message(1, b"identity") + bytes([0x18, 1, 0x20, int(extra_spaces_go), 0x28, 1]))


@pytest.mark.parametrize("extra_spaces_go", [False, True])
def test_unigram_models(extra_spaces_go):
    data = unigram(extra_spaces_go)
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    tokenizer = sentencepiece_model.tokenizer(sentencepiece_model.parse(data))
    for text in ("the ab", "abab the the", "  the   ab ", "xé the", "", "ba ab"):
        assert tokenizer.encode(text, add_special_tokens=False).ids == library.encode(text), text


def test_other_bytes_are_refused():
    with pytest.raises(ValueError):
        sentencepiece_model.parse(b"\x0a\xff\xff\xff\x7f")
