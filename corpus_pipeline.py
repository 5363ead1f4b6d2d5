"""A training corpus from ``documents``: stages of text operators, one after the other.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardflow.functions.columns import free_names
from shardflow.llm import exact_dedup, language_id, mixing, ngram_join, queries, sentencepiece_codec
from shardflow.llm.key_filter import lacking
from shardflow.scratch import materialise

#: Dimensions of the language profiles.
PROFILE_SIZE = 1024
#: Rows that travel to Python at a time: texts may be long.
BATCH_ROWS = 1000


def _session(spark: SparkSession) -> None:
    """Settings of this job's session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones among them teach.

    Rejected are texts that are null or without a letter, and those no nearer
    to any language than a random vector would be (a cosine of one over the root of
    the dimensions).  Without any label only the first kind is rejected.
    """
    _session(spark)
    profiles = language_id.fit(docs, size=PROFILE_SIZE)
    pred, score = free_names(docs, "lang_pred", "lang_score")
    out = language_id.identify(docs, profiles, lang_pred=pred, score=score)
    if profiles.languages:
        keep = (F.col(pred) != language_id.UNKNOWN) & (F.col(score) >= PROFILE_SIZE**-0.5)
    else:
        keep = F.col("text").rlike(r"\p{L}")
    return out.where(keep).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the row with the smallest id."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the one with the smallest id.

    Rows without id are compared with nothing and stay.
    """
    _session(spark)
    groups = ngram_join.ngram_jaccard_groups(docs, n=5, num=4, den=5)
    gone = materialise(groups.where("component_id < doc_id").select("doc_id").distinct(), "near-copies")
    return lacking(docs, gone, "doc_id")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: not at all, once or twice."""
    return mixing.mixed(docs, weights=(3, 1, 2), share=1.5, cap=2)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, compared with the other library and decoded again."""
    _session(spark)
    model = queries.public_model()
    rows = docs.select("doc_id", "lang", "source", "text")
    out = sentencepiece_codec.encode_texts(rows, model, round_trip="round_trip")
    return out.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        (F.col("verified") & F.col("round_trip")).alias("verified"),
    )


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Language profiles, multipliers and token ids cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
