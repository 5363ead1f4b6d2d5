"""Registered queries of this folder: one per operator, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardflow.llm import (
    conversation_repair,
    exact_dedup,
    exact_topk,
    language_id,
    lexical_search,
    mixing,
    ngram_join,
    pii,
    preference,
    repair_sql,
    sentencepiece_codec,
    substring_dedup,
    token_codes,
    toxicity,
)
from shardflow.scratch import materialise, scratch_path

def public_tokenizer(name: str) -> str:
    """Where a file of the public tokenizers is."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_ngram_jaccard_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_groups(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


@query(
    "op9_exact_dedup",
    r"""
    with t as (
      select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
      from documents
    ),
    g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from t group by 1)
    select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, t.text_sha256 from t join g using (text_sha256)
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op3_source_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2)


@query(
    "op10_chat_formatting",
    r"""
    with t as (
      select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as k
      from conversations where conv_id is not null
    ),
    n as (
      select c, r, x, row_number() over (partition by r, x order by substr(md5('0|0|' || c), 1, 15), c) - 1 as i
      from t where k = 0
    ),
    p as (
      select max(case when i % 2 = 0 then c end) as chosen, max(case when i % 2 = 1 then c end) as rejected
      from n group by r, x, i // 2
    ),
    s as (
      select p.chosen as pair_id, 1 as side, t.k, t.r, t.x from p join t on t.c = p.chosen
      union all select p.chosen, 2, t.k, t.r, t.x from p join t on t.c = p.rejected
    ),
    both_sides as (
      select pair_id, k, count(*) as n, count(distinct (r, x)) as texts from s group by 1, 2
    ),
    cut as (
      select pair_id, coalesce(min(case when n < 2 or texts > 1 then k end), max(k) + 1) as prompt_turns
      from both_sides group by 1
    ),
    w as (
      select s.*, cut.prompt_turns, '<|im_start|>' || r || chr(10) as head,
        '<|im_start|>' || r || chr(10) || x || '<|im_end|>' || chr(10) as written
      from s join cut using (pair_id)
    ),
    m as (
      select *, sum(length(written)) over (partition by pair_id, side, k >= prompt_turns order by k) - length(written) as spot from w
    ),
    g as (
      select pair_id, any_value(prompt_turns) as prompt_turns,
        coalesce(string_agg(written, '' order by k) filter (side = 1 and k < prompt_turns), '') as prompt,
        coalesce(string_agg(written, '' order by k) filter (side = 1 and k >= prompt_turns), '') as chosen_completion,
        coalesce(string_agg(written, '' order by k) filter (side = 2 and k >= prompt_turns), '') as rejected_completion,
        coalesce(string_agg((spot + length(head)) || '-' || (spot + length(head) + length(x)), ',' order by k)
          filter (side = 1 and k >= prompt_turns and r = 'assistant'), '') as chosen_mask,
        coalesce(string_agg((spot + length(head)) || '-' || (spot + length(head) + length(x)), ',' order by k)
          filter (side = 2 and k >= prompt_turns and r = 'assistant'), '') as rejected_mask
      from m group by 1
    )
    select p.chosen as pair_id, p.chosen, p.rejected, cast(g.prompt_turns as integer) as prompt_turns, g.prompt,
      g.chosen_completion, g.rejected_completion, g.chosen_mask, g.rejected_mask
    from p join g on g.pair_id = p.chosen
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    out = preference.format_preferences(preference.opening_pairs(turns), turns)
    for side in ("chosen", "rejected"):
        ranges = F.transform(f"{side}_mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
        out = out.withColumn(f"{side}_mask", F.array_join(ranges, ","))
    return out


@query("op4_substring_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.without_repeats(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_token_codes")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizer("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    path = scratch_path(spark, "tokens")
    token_codes.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer, end=1, by_word=True)
    return token_codes.read_documents(spark, path, digest=True)


def public_model(name: str = "piece_bpe_32k.model") -> bytes:
    with open(public_tokenizer(name), "rb") as f:
        return f.read()


@query("op5_sentencepiece")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_model()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sentencepiece_codec.encode_texts(docs, model, round_trip="round_trip")
    return out.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.crc32(F.array_join("ids", " ").cast("binary")).alias("ids_crc32"),
        F.col("verified").alias("same_as_sentencepiece"),
        "round_trip",
    )


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.fit(docs.where(~language_id.held_out()))
    out = language_id.identify(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@query(
    "op7_exact_topk",
    """
    with v as (
      select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
      where embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
    ),
    s as (
      select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0
    ),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
    select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_products(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5, scale=256)


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["plain"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["plain"] & (s["kind"] == kind))).cast("bigint")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(F.array_join(F.transform(base, written), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", written), ",").alias("spans"),
    )


@query(
    "op13_lexical_search",
    r"""
    with d as (
      select row_number() over () as d, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t
      from documents
    ),
    i as (
      select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
      from (select distinct item_id, text from benchmark)
    ),
    g as (select cast(count(*) filter (len(t) > 0) as bigint) as n, cast(sum(len(t)) as bigint) as l from d),
    p as (
      select d, doc_id, n, term, count(*) as tf from (select d, doc_id, cast(len(t) as bigint) as n, unnest(t) as term from d) where term in (select term from i) group by all
    ),
    w as (select term, cast(floor(1000 * ln((2 * g.n + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from p, g group by term, g.n),
    q as (select item_id, term, count(*) as times from i group by all),
    s as (
      select q.item_id, p.d, p.doc_id, cast(sum(q.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * g.n) // g.l)))) as bigint) as score
      from q join w using (term) join p using (term), g group by all
    ),
    r as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls first) as rank from s where score > 0)
    select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= 20
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.write_index(table(spark, sf_dir, "documents"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"), k=20)


@query("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs.where(~language_id.held_out()), table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, machine)
    return out.select("doc_id", language_id.held_out().alias("held_out"), "score", toxicity.predicted().alias("predicted"))


@query("op11_conversation_repair", repair_sql.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(turns), turns)
