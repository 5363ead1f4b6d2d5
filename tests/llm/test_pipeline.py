"""The pipeline's stages, each against a brute-force version on the rows its predecessor kept."""

import re
from collections import Counter

import public_tokenizers
import sentencepiece
from test_mixing import check
from test_ngram_join import brute

import corpus_pipeline
from shardflow.llm import language_id, mixing
from shardflow.scratch import materialise

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "source_mixing", "sentencepiece"]
    held = [documents]
    for name, stage in corpus_pipeline.STAGES:
        held.append(materialise(stage(spark, held[-1], SF), name))
    assert all(df.columns == documents.columns for df in held[:-1])
    texts = [[(r.doc_id, r.text, r.source) for r in df.collect()] for df in held[:-1]]
    profiles = language_id.fit(documents)
    names, scores = profiles.answers([t for _, t, _ in texts[0]])
    assert Counter(texts[1]) == Counter(r for r, n, s in zip(texts[0], names, scores) if n != "und" and s >= 1 / 32)
    assert len(texts[1]) >= 0.99 * len(texts[0])  # clean documents stay
    first = {}
    for i, t, s in sorted(texts[1]):
        first.setdefault(re.sub("[ \t-\r]+", " ", t), (i, t, s))
    assert Counter(texts[2]) == Counter(first.values())
    roots = {i: root for i, _, root in brute([r[:2] for r in texts[2]], 5, 4, 5)}
    assert Counter(texts[3]) == Counter(r for r in texts[2] if roots[r[0]] == r[0])
    plan = mixing.mixture(held[3]).collect()
    check(texts[3], plan)
    assert Counter(r[0] for r in texts[4]) == +Counter({r.doc_id: r.copies for r in plan})
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = held[5].collect()
    assert all(r.verified and r.n_tokens == len(r.ids) for r in last)
    assert Counter((r.doc_id, tuple(r.ids)) for r in last) == Counter((i, tuple(library.encode(t))) for i, t, _ in texts[4])


def test_odd_rows_and_empty_table(spark, odd, nothing):
    for rows in (odd, nothing):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, SF), name)
            if name != "sentencepiece":
                assert docs.columns == rows.columns
        ids = {r.doc_id for r in docs.collect()}
        assert ids <= {1, 2, 7, 8, 9, 10, 11, 12, 14, 15, None}
        if rows is nothing:
            assert not ids
