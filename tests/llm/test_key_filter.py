"""Joins in which only rows that may have a key travel, against plain joins."""

import pytest

from shardflow.llm import exact_dedup, key_filter
from shardflow.scratch import materialise


@pytest.fixture()
def tables(spark):
    rows = [(k if k % 11 else None, f"text {k % 50}", "a", k) for k in range(2000)] * 2
    docs = spark.createDataFrame(rows, "doc_id int, key string, row string, word int")
    keys = materialise(spark.createDataFrame([(k * 40,) for k in range(60)] + [(None,)], "doc_id long"), "keys")
    return docs, keys


@pytest.mark.parametrize("most", [64, key_filter.MOST_BITS])
def test_rows_as_by_plain_joins(tables, monkeypatch, most):
    monkeypatch.setattr(key_filter, "MOST_BITS", most)
    docs, keys = tables
    same = lambda x, y: sorted(map(repr, x.collect())) == sorted(map(repr, y.collect()))
    assert same(key_filter.lacking(docs, keys, "doc_id"), docs.join(keys, "doc_id", "left_anti").select(*docs.columns))
    longs = docs.selectExpr("cast(doc_id as long) doc_id", "key", "row")
    assert same(key_filter.having(longs, keys, "doc_id"), longs.join(keys, "doc_id", "left_semi"))
    none = materialise(keys.where("doc_id < 0"), "keys")
    assert same(key_filter.lacking(docs, none, "doc_id"), docs)
    assert key_filter.having(longs, none, "doc_id").count() == 0


def test_most_rows_without_a_key_stay(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "k")
    keys = materialise(rows.where("k % 100 = 0"), "keys")
    told = {(r.has, r.perhaps): r["count"] for r in key_filter.marked(rows, keys, "k", "perhaps").selectExpr("k % 100 = 0 has", "perhaps").groupBy("has", "perhaps").count().collect()}
    assert told[True, True] == 200 and (True, False) not in told and told[False, False] > 17_000


def test_texts_that_stay_are_not_shuffled(spark):
    rows = [(k, f"text of {k % 290}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        stay = exact_dedup.without_copies(docs)
        plan = stay._jdf.queryExecution().executedPlan().toString()
        assert "Union" in plan and "BroadcastHashJoin" in plan
        assert sorted(r.doc_id for r in stay.collect()) == list(range(290))
    finally:
        spark.conf.set(key, before)
