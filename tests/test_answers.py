"""Extractive answers: the three branches with their basis and supplement."""

from clausegraph.operators import answer
from clausegraph.operators.evaluate import gold_drift


def test_extractive_branches(spark):
    force = "前文。经责令改正拒不改正的，强制执行。后文。"
    own = "单位应当检查。个人有前款行为的，处罚款。"
    rows = [("f", "能强制执行吗", "a·1", 1, False, "a", force), ("f", "能强制执行吗", "b·1", 2, True, "b", "不得占用。"),
            ("p", "个人怎么处理", "a·2", 1, True, "a", own), ("p", "个人怎么处理", "a·3", 2, False, "a", "另文。"),
            ("d", "说明", "a·4", 1, False, "a", "不得占用通道。"), ("d", "说明", "a·5", 2, True, "a", "另文。")]
    ranked = spark.createDataFrame([(*r[:6], "法" + r[5], "第一条", "题", r[6]) for r in rows],
                                   "query_id string, question string, item_id string, rank int, graph_hit boolean, law string, law_name string,"
                                   " num string, title string, text string")
    scenes = spark.createDataFrame([("f", [], []), ("p", ["个人"], ["商场"]), ("d", [], [])],
                                   "query_id string, subjects array<string>, venues array<string>")
    got = {r["query_id"]: r for r in answer.extractive(ranked, scenes).collect()}
    assert got["f"]["basis"] == ["《法a》第一条：经责令改正拒不改正的，强制执行。"]
    assert got["f"]["supplement"] == answer.FORCE_SUPPLEMENT and got["f"]["confidence"] == "high"
    assert got["p"]["basis"] == ["《法a》第一条：个人有前款行为的，处罚款。"]
    assert got["p"]["supplement"] == answer.QUOTED and got["p"]["conditions"] == "主体：个人；场所：商场"
    assert got["d"]["basis"] == ["《法a》第一条：不得占用通道。", "《法a》第一条：另文。"]
    assert got["d"]["supplement"] == answer.QUOTED_IN_PART and got["d"]["confidence"] == "medium"


def test_drift_skips_phrases_that_are_no_quotations(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "z")], "case_id int, item_id string")
    items = spark.createDataFrame([("a", "some text")], "item_id string, text string")
    phrases = spark.createDataFrame([(1, "119"), (1, "some"), (1, "gone")], "case_id int, phrase string")
    assert sorted(map(tuple, gold_drift(gold, items, phrases).collect())) == [(1, "missing_item", "z"), (1, "missing_phrase", "gone")]
