"""Inputs that must neither end a job nor vanish."""

import json

import pytest
from pyspark.sql import functions as F

from clausegraph.functions import numerals
from clausegraph.operators import guards, verify
from clausegraph.sources import audit, corpus

LAW = {"law_abbr": "甲法", "chapters": [{"chapter_title": "一", "articles": [{"num": "第一条", "title": "t", "text": "x。"}]}]}


def test_law_paths_and_rejected_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(LAW), encoding="utf-8")
    (tmp_path / "broken.json").write_text('{"law_abbr": "乙法", "chapters": [', encoding="utf-8")
    for paths in ([f"{tmp_path}/*.json"], f"{tmp_path}/*.json", [f"{tmp_path}/a.json", f"{tmp_path}/none.json"], [f"file://{tmp_path}/a.json"]):
        assert [r["law_abbr"] for r in corpus.read_laws(spark, paths).collect()] == ["甲法"]
    assert corpus.split_paths(spark, [f"{tmp_path}/none.json", f"{tmp_path}/a.json"]) == ([f"{tmp_path}/a.json"], [f"{tmp_path}/none.json"])
    rejected = corpus.rejected_laws(spark, f"{tmp_path}/*.json").collect()
    assert len(rejected) == 1 and rejected[0]["path"].endswith("broken.json")
    assert corpus.read_laws(spark, [f"{tmp_path}/none.json"]).count() == 0


def test_only_a_missing_day_is_empty(spark, tmp_path):
    assert audit.read_day(spark, str(tmp_path), "20240101").count() == 0
    with pytest.raises(Exception, match="(?i)schema|parse|syntax"):
        audit.read_day(spark, str(tmp_path), "20240101", schema="no such, type").count()


def test_long_numbers_give_null(spark):
    row = spark.range(1).select(
        numerals.numeral_value(F.lit("9" * 20)).alias("a"), numerals.numeral_value(F.lit("九" * 25)).alias("b"),
        numerals.building_height(F.lit("9" * 11 + "米")).alias("c"), numerals.fine_ranges(F.lit("9" * 20 + "元")).alias("d"),
        verify.article_number(F.lit("》" + "9" * 30)).alias("e"), numerals.numeral_value(F.lit("三千二百")).alias("f")).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"], row["f"]) == (None, None, None, [], None, 3200)


def test_a_question_about_hazards_is_no_emergency(spark):
    q = spark.createDataFrame([("火灾隐患如何处理",), ("厨房着火怎么办",)], "q string")
    urgent = [r[0] for r in q.select(F.col("q").rlike(guards.FIRE_WORDS) & F.col("q").rlike(guards.ACTION_WORDS)).collect()]
    assert urgent == [False, True]


def test_heavy_tokens_beyond_the_bound_raise_the_limit(spark):
    from clausegraph.operators.lexical import attach_dictionary

    postings = spark.createDataFrame([(i % 3, f"t{i % 3}") for i in range(9)], "item_id long, token string")
    dictionary = spark.createDataFrame([("t0", 2), ("t1", 3), ("t2", 5)], "token string, df long")
    joined = attach_dictionary(postings, dictionary, hot_df=1, rows=1)
    assert sorted((r["token"], r["df"]) for r in joined.collect()) == [("t0", 2)] * 3 + [("t1", 3)] * 3 + [("t2", 5)] * 3


def test_decimal_article_numbers_are_cited(spark):
    from clausegraph.operators.verify import cited_articles

    answers = spark.createDataFrame([(1, "依据《充电规范》3.1 处理"), (2, "依据《充电规范》3.10处理"), (3, "依据《充电规范》3.1.2处理"),
                                     (4, "依据《别的规范》3.1处理")], "answer_id long, answer string")
    known = spark.createDataFrame([("a", "充电规范", "3.1"), ("b", "充电规范", "3.1.2")], "item_id string, law string, num string")
    aliases = spark.createDataFrame([("充电规范", "充电规范")], "law string, alias string")
    assert {tuple(r) for r in cited_articles(answers, known, aliases).collect()} == {(1, "a"), (3, "b")}


def test_a_mode_builds_its_own_channels_only(spark):
    from clausegraph.packs import demo
    from clausegraph.plans import retrieve as plan

    items = spark.createDataFrame([(1, "l", "t", "red fox. blue sea", False), (2, "l", "t", "green hill", False)],
                                  "item_id long, law string, title string, text string, is_draft boolean")
    units = spark.createDataFrame([(1, "l", 0, "red fox"), (1, "l", 1, "blue sea"), (2, "l", 0, "green hill")],
                                  "item_id long, law string, unit_no int, unit string")
    questions = spark.createDataFrame([(7, "red fox")], "query_id long, text string")
    found = plan.retrieve(plan.KnowledgeBase(items, units, None, None, demo.GRAPH), questions, mode="bm25")  # no graph at all
    assert [(r["query_id"], r["item_id"]) for r in found.collect()] == [(7, 1)]
