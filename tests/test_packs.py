import json

from pyspark.sql import functions as F

from clausegraph.config import Settings
from clausegraph.operators import answer as an, gate, understand as un
from clausegraph.packs import demo, loader, regulation_zh as zh
from clausegraph.plans import ask as ask_plan, retrieve as plan
from clausegraph.operators import lexical as lx
from clausegraph.functions import text as tx


def test_routes(spark):
    want = {
        "厨房着火了怎么办": "emergency", "楼道里冒烟，我被困": "emergency", "宿舍发生火灾，现场有人": "emergency",
        "存在火灾隐患应当怎么整改": "law", "着火点怎么确定": "law", "火灾时广告牌挡住窗户": "law", "灭火器放哪里": "law",
        "推荐一部电影": "refuse", "教我作弊": "refuse", "你好": "chitchat", "嗯": "chitchat", "今天吃什么好呢": "refuse",
    }
    df = spark.createDataFrame(list(want), "string").withColumnRenamed("value", "text")
    got = {r["text"]: r["intent"] for r in un.route(df, zh.ROUTE).collect()}
    assert got == want


def test_hybrid_route_order(spark):
    df = spark.createDataFrame([("灭火器放哪里", "chitchat", 0.9), ("灭火器放哪里?", "chitchat", 0.1), ("着火点怎么确定", "refuse", 0.99)],
                               "text string, ml_intent string, ml_confidence double")
    got = [r["intent"] for r in un.route(df, zh.ROUTE, backend="hybrid").collect()]
    assert got == ["chitchat", "law", "law"]


def test_gate_precedence(spark):
    cols = "id int, score double, cite_inject boolean, cross_encoder double, graph_hit boolean, direct_match boolean, vector double, coverage double"
    rows = [(1, None, None, None, None, None, None, None), (2, 0.12, True, None, None, None, None, None), (3, 0.13, True, 0.1, None, None, None, None),
            (4, 0.62, False, 0.59, True, None, 0.9, 0.9), (5, 0.63, False, 0.1, True, None, 0.9, 0.9), (6, 0.45, False, None, False, False, 0.01, 0.1),
            (7, 0.22, False, None, True, None, 0.9, 0.9), (8, 0.5, False, None, False, False, 0.0, 0.0)]
    got = {r["id"]: r["c"] for r in spark.createDataFrame(rows, cols).select("id", gate.confidence().alias("c")).collect()}
    assert got == {1: "Incorrect", 2: "Incorrect", 3: "Correct", 4: "BelowThreshold", 5: "Correct", 6: "Ambiguous", 7: "Ambiguous", 8: "Correct"}


def test_cited_forced_and_outside(spark):
    q = spark.createDataFrame([(1, "消防法第六条怎么说"), (2, "第七条呢"), (3, "根据《网络法律大全》第一条"), (4, "按GB 50016 执行")], "query_id bigint, text string")
    known = spark.createDataFrame([("消防法·第六条",), ("61号令·第七条",), ("高层规定·第七条",)], "item_id string")
    got = {(r[0], r[1]) for r in un.cited_items(q, [("消防法", "消防法")], ["消防法", "61号令", "高层规定"], known).collect()}
    assert got == {(1, "消防法·第六条"), (2, "61号令·第七条")}
    forced = un.forced_items(q, [(["怎么说"], [], ["消防法·第六条", "none"]), (["呢"], ["zz"], ["61号令·第七条"])], known)
    assert [(r[0], r[1]) for r in forced.collect()] == [(1, "消防法·第六条")]
    names = spark.createDataFrame([("消防法",), ("中华人民共和国消防法",)], "name string")
    got = {r["query_id"]: r["named"] for r in un.outside_titles(q, names, zh.FOREIGN_NAMES).collect()}
    assert got == {3: "网络法律大全", 4: "GB50016"}


def test_loader(spark, tmp_path):
    rows = [dict(dimension="behavior", prio=1, name="block", kind="violation", role="alias", phrase="blocked"),
            dict(dimension="behavior", prio=1, name="block", kind="violation", role="verb", phrase="block"),
            dict(dimension="subject", prio=1, name="owner", role="alias", phrase="landlord"),
            dict(dimension="theme", prio=1, name="t", role="member", phrase="block")]
    path = tmp_path / "lexicon.json"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    lists = dict.fromkeys(["prohibit_words", "breach_words", "duty_words", "unit_phrases", "person_phrases", "modal_words", "punish_words"], [])
    pack = loader.graph_pack(loader.read_lexicon(spark, str(path)), unit_subject="u", person_subject="p", **lists)
    assert pack.subjects == [("owner", ["landlord"])] and pack.behaviors[0].verbs == ["block"] and pack.themes == [("t", [], ["block"])]


def test_ask_end_to_end(spark):
    items = spark.createDataFrame([(1, "L", "anea route", "The anea is erat here. Fine of thst.", False), (2, "M", "staff", "ertion ing the heed", True)],
                                  "item_id bigint, law string, title string, text string, is_draft boolean")
    kb = plan.build(items, demo.GRAPH, tx.LATIN_DELIMITERS)
    packs = ask_plan.AskPacks(demo.ROUTE, demo.SCENE, demo.RISK, ["more"])
    q = spark.createDataFrame([(1, "the anea route erat", None), (2, "???", None), (3, "more", "the anea route erat")],
                              "query_id bigint, text string, prev_text string")
    out = {r["query_id"]: r for r in ask_plan.ask(kb, q, packs).collect()}
    assert out[2]["outcome"] == "refuse_input" and out[1]["top_item"] == 1 and out[3]["top_item"] == 1
    assert len(out) == 3
    for mode in ("bm25", "bm25_vector", "hybrid", "full"):
        got = plan.retrieve(kb, q.select("query_id", "text"), Settings(), mode=mode).collect()
        assert {r["rank"] for r in got if r["query_id"] == 1} >= {1} and all(0 <= r["score"] for r in got)


def test_respond_end_to_end(spark):
    """Every way out of a response: outside name and topic, bad input, too broad, cited and forced items, drafts, follow-ups."""
    rows = [("法·第一条", "en", "anea route", "The anea is erat here. Fine of thst and of the staff.", False), ("法·第二条", "en", "staff", "ertion ing the heed with staff", True),
            ("令·第三条", "fr", "salle", "des eaux aux salle", False)]
    items = spark.createDataFrame(rows, "item_id string, law string, title string, text string, is_draft boolean").withColumn("law_name", F.upper("law")).withColumn(
        "num", F.substring_index("item_id", "·", -1))
    kb = plan.build(items, demo.GRAPH, tx.LATIN_DELIMITERS)
    packs, zh_extras = ask_plan.regulation(demo.SCENE)
    assert packs.followup_markers and zh_extras.topics and zh_extras.foreign
    packs = ask_plan.AskPacks(demo.ROUTE, demo.SCENE, demo.RISK, ["more"])
    extras = ask_plan.Extras(
        foreign=zh.FOREIGN_NAMES, topics=zh.OUTSIDE_TOPICS, aliases=[("the code", "法")], core=["法"], forced=[(["salle"], [], ["令·第三条"])],
        guide=dict(idle=["whatever"], exact=[], exploring=[], concrete=[], generic_subjects=[]), profile=plan.Profile(["en"], [("fr", "salle")]),
        replies={"refuse_input": "bad input", "refuse_outside": "not held", "guide_broad": "say more"}, followups=[("law", None, "and then?")],
        fallback_followups=["who?", "and then?"])
    asked = [(1, "the anea route erat", None), (2, "???", None), (3, "the 民法典 anea", None), (4, "the anea 森林火灾 erat", None), (5, "the whatever anea erat", None),
             (6, "the code 第二条 anea erat the", None), (7, "the salle anea erat", None), (8, "the 《某某管理办法》 anea", None)]
    q = spark.createDataFrame(asked, "query_id bigint, text string, prev_text string")
    out = {r["query_id"]: r for r in ask_plan.respond(kb, q, packs, extras).collect()}
    assert len(out) == len(asked)
    assert (out[2]["outcome"], out[2]["reply"]) == ("refuse_input", "bad input")
    assert [(out[i]["outcome"], out[i]["outside"], out[i]["reply"]) for i in (3, 4, 8)] == [
        ("refuse_outside", n, "not held") for n in ("民法典", "森林火灾", "某某管理办法")]
    assert out[5]["outcome"] == "guide_broad" and out[5]["reply"] == "say more"
    assert {r["item_id"] for r in out[1]["references"]} >= {"法·第一条"} and [r["rank"] for r in out[1]["references"]] == sorted(r["rank"] for r in out[1]["references"])
    assert out[1]["outcome"] == "answer" and out[1]["reply"].startswith("【结论】") and out[1]["basis"]
    assert "法·第二条" in {r["item_id"] for r in out[6]["references"]} and an.DRAFT_NOTICE in (out[6]["supplement"] or an.DRAFT_NOTICE)
    assert "令·第三条" in {r["item_id"] for r in out[7]["references"]}
    assert out[1]["follow_ups"][0] in ("and then?", "who?") and len(set(out[1]["follow_ups"])) == len(out[1]["follow_ups"])


def test_empty_inputs(spark):
    units = lx.tokenized(spark.createDataFrame([], "part string, item_id bigint, unit_no int, unit string"))
    q = spark.createDataFrame([], "query_id bigint, text string")
    assert lx.bm25_search(units, q, 5).count() == 0
    full = lx.tokenized(spark.createDataFrame([("all", 1, 0, "a b")], "part string, item_id bigint, unit_no int, unit string"))
    assert lx.bm25_search(full, q, 5).count() == 0 and lx.tfidf_search(full, q, 5).count() == 0
