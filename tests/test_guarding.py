"""Guard pipeline, prompt bridge and support checks."""

import json

from pyspark.sql import functions as F

from clausegraph.operators import answer as an, guards as gd, verify as vf
from clausegraph.plans import guarded
from clausegraph.registry.guarding import CALL, REFUSED


def run(spark, rows, given, replies):
    """``replies`` maps (answer_id, attempt) to a reply; returns the answers and the calls that were made."""
    calls = spark.sparkContext.accumulator(0)
    table = {k: v for k, v in replies.items()}

    @F.udf("string")
    def speak(answer, attempt):
        calls.add(1)
        return table[answer, attempt]

    asked = spark.createDataFrame(rows, "answer_id long, question string, prompt string, n_provided int")
    articles = spark.createDataFrame(given, "answer_id long, law_name string, law string, num string, text string")
    out = guarded.guarded_answers(asked, articles, lambda df: df.withColumn("reply", speak("answer_id", "attempt")),
                                  gd.answer_record(REFUSED, "o", "n"), gd.answer_record(CALL, "n", "l"), REFUSED)
    got = {r["answer_id"]: r for r in out.collect()}
    assert out.count() == len(rows)  # read again: no further call
    return got, calls.value


def reply(conclusion, *basis):
    return json.dumps({"conclusion": conclusion, "basis": list(basis), "supplement": "s"}, ensure_ascii=False)


def test_retry_once_and_call_the_model_once_an_attempt(spark):
    given = [(i, "消防法", "法", "第十条", "原文。") for i in (1, 2, 3)]
    got, calls = run(spark, [(1, "q", "p", 1), (2, "q", "p", 1), (3, None, "p", 1), (4, "q", "p", None)], given, {
        (1, 1): reply("a", "《消防法》第10条：x"), (2, 1): reply("a", "《刑法》第五条"), (2, 2): reply("b", "《消防法》第十条"),
        (3, 1): reply("a"), (3, 2): "broken", (4, 1): reply("a", "《刑法》第五条")})
    assert calls == 6  # four first and two second attempts
    assert [list(got[i]["guards"]) for i in (1, 2, 3, 4)] == [[], ["citation_retry"], ["citation_retry", "json_fallback", "citation_rejected"], []]
    assert got[2]["final"]["basis"] == ["《消防法》第十条：原文。"] and got[2]["final"]["conclusion"] == "b"
    assert got[3]["final"]["conclusion"] == REFUSED and got[4]["final"]["basis"] == ["《刑法》第五条"]
    assert [got[i]["attempts"] for i in (1, 2, 3, 4)] == [1, 2, 2, 1]


def test_prompt_bridge(spark):
    rows = [("用户问题:怎么办?\n\n以下为检索到的法规条款:\n【法·1 标题】 正文。\n\n【法·2】\n第二", ),
            ("以下为检索到的法规条款", ), ("用户问题:无", ), (None, ), ("用户问题：问 \n\n以下为检索到的法规条款:\n【  】x【a b】", )]
    out = [r["p"] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(an.read_prompt(F.col("t")).alias("p")).collect()]
    assert out[0]["question"] == "怎么办?" and [tuple(a) for a in out[0]["articles"]] == [("法·1", "法·1 标题", "正文。"), ("法·2", "法·2", "第二")]
    assert out[1]["question"] == "以下为检索到的法规条款" and out[1]["articles"] == []
    assert out[2] is None and out[3] is None
    assert out[4]["question"] == "问" and [tuple(a) for a in out[4]["articles"]] == [("a", "a b", "")]
    ranked = spark.createDataFrame([(1, 1, "法·1", "标题", "文"), (1, 2, "法·2", "题", "字")], "query_id long, rank int, num string, title string, text string")
    back = an.context_block(ranked).select(an.read_prompt(an.build_prompt(F.lit("问"), F.col("context"))).alias("p")).first()["p"]
    assert back["question"] == "问" and [a["text"] for a in back["articles"]] == ["文", "字"]


def test_unsupported(spark):
    rows = [("罚5元", "消防 罚款", "消防 5元", []), ("罚7元", "安全出口", "消防 5元", ["citation_guard", "json_fallback"]), ("罚7元", "q", "", []), ("a", "", "消防", [])]
    frame = spark.createDataFrame(rows, "c string, q string, t string, g array<string>").coalesce(1)
    marks = [r[0] for r in frame.select(vf.unsupported_marks(F.col("c"), F.col("q"), F.col("t"), F.col("g"))).collect()]
    assert marks == [[], ["guard:citation_guard", "numbers:7", "no common term"], [], []]
    answers = spark.createDataFrame([(1, "fire doors open. pigs fly high"), (2, "alone here"), (3, None), (4, "a b")], "answer_id long, text string")
    evidence = spark.createDataFrame([(1, 7, "The fire doors must open"), (1, 8, "high")], "answer_id long, item_id long, text string")
    open_ = vf.unsupported_sentences(answers, evidence, lambda t: F.split(t, "\\. "))
    assert sorted((r["answer_id"], r["pos"]) for r in open_.collect()) == [(2, 0)]
