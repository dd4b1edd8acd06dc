from pyspark.sql import functions as F

from clausegraph.functions import jsonguard, numerals, text as tx
from clausegraph.operators import answer, guards, understand as un, verify as vf


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_sentences(spark):
    assert one(spark, tx.sentences("t"), t="（一）甲。乙；丙\n丁") == ["甲", "乙", "丙", "丁"]
    assert one(spark, tx.sentences("t"), t="") == []
    assert one(spark, tx.sentences(F.lit(None).cast("string")), t="x") == []


def test_grams(spark):
    assert one(spark, tx.char_bigrams("t"), t="abc") == ["ab", "bc"]
    assert one(spark, tx.char_bigrams("t"), t="a") == []
    assert one(spark, tx.char_ngrams("t", 3), t="𠮷野家x") == ["𠮷野家", "野家x"]
    assert one(spark, tx.key_terms("t"), t="A b") == ["ab"]
    assert one(spark, tx.mixed_features("t"), t="消防法 Fire 119") == ["消防", "防法", "消防法", "fire", "119"]


def test_title_and_space(spark):
    assert one(spark, tx.derive_title("t"), t="第一条：内容") == "第一条"
    assert one(spark, tx.derive_title("t"), t="长" * 30) == "长" * 22 + "…"
    assert one(spark, tx.normalize_space("t"), t=" a　 b ") == "a b"


def test_numerals(spark):
    cases = {"五千": 5000, "五万": 50000, "二十万": 200000, "一百二十三": 123, "2000": 2000, "十": 10, "二十八": 28, "5万": None, "": 0}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", numerals.numeral_value(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in rows} == cases


def test_ranges(spark):
    r = one(spark, numerals.fine_ranges(F.col("t")), t="处五千元以上五万元以下罚款")
    assert [(x.low, x.high) for x in r] == [(5000, 50000)]
    r = one(spark, numerals.durations(F.col("t")), t="处十五日以上三十日以下拘留，2021年，三天")
    assert [(x.low, x.high, x.unit) for x in r] == [(15, 30, "日"), (2021, 2021, "年"), (3, 3, "日")]
    r = one(spark, numerals.durations(F.col("t"), strict=True), t="2021年，三天")
    assert [(x.low, x.high, x.unit) for x in r] == [(3, 3, "日")]
    assert one(spark, numerals.building_height(F.col("t")), t="30层住宅").height_m_est == 90
    assert one(spark, numerals.building_height(F.col("t")), t="高50米").height_m == 50


def test_gibberish(spark):
    values = {"": True, "？？！！": True, "abc": False, "火灾": False, "a？？？？？": True}
    rows = spark.createDataFrame([(k,) for k in values], "t string").select("t", un.is_gibberish(F.col("t")).alias("g")).collect()
    assert {r["t"]: r["g"] for r in rows} == values


def test_json_repair():
    assert jsonguard.repair('```json\n{"a": 1}\n```')[1] == "direct"
    assert jsonguard.repair('x {"a":1} y') == ('{"a": 1}', "brace_extract")
    assert jsonguard.repair('{"a":["b') == ('{"a": ["b"]}', "truncation_repair")
    assert jsonguard.repair('{"a":"say "hi" now"}') == ('{"a": "say \\"hi\\" now"}', "quote_escape_repair")
    assert jsonguard.repair("no json") == (None, "fallback")
    assert jsonguard.repair(None) == (None, "fallback")


def test_normalize_and_guards(spark):
    rows = spark.createDataFrame([
        (1, '{"conclusion":"可以","basis":["《法》第十条：内容"],"confidence":"HIGH"}', "规定是什么", 1),
        (2, '{"conclusion":"可以","basis":"x"}', "规定", 0),
        (3, "乱码", "着火了怎么办", None),
        (4, '{"conclusion":"超出知识库，暂不回答","basis":[]}', "规定", 2),
        (5, '{"conclusion":"可以","basis":["无"]}', "规定", 2),
    ], "id int, reply string, question string, n_provided int")
    out = guards.protect(jsonguard.with_repaired(rows, "reply", "拒答"), guards.answer_record("拒答", "外", "无"),
                         guards.answer_record("拨打119并疏散", "急", "撤离"))
    got = {r["id"]: (r["guards"], r["final"]["conclusion"], r["final"]["confidence"]) for r in out.collect()}
    assert got[1] == ([], "可以", "high")
    assert got[2] == (["no_articles_guard"], "拒答", "high")
    assert got[3] == (["json_fallback", "emergency_guard"], "拨打119并疏散", "high")
    assert got[4][0] == ["refuse_guard"] and got[5][0] == ["refuse_guard"]


def test_condense_and_citation(spark):
    long = "《法》第十条：" + "文" * 150
    out = one(spark, answer.condense_basis(F.array("t", "u")), t=long, u=" 短 ")
    assert out == ["《法》第十条：" + "文" * 100 + "…", "短"]
    assert one(spark, vf.article_number(F.col("t")), t="《法》第二十八条：") == 28
    assert one(spark, vf.article_number(F.col("t")), t="《法》28") == 28


def test_verify(spark):
    known = spark.createDataFrame([("法·第六条", "法", "第六条"), ("法·第六十条", "法", "第六十条"), ("法·第七十二条", "法", "第七十二条")],
                                  "item_id string, law string, num string")
    aliases = spark.createDataFrame([("法", "消防法")], "law string, alias string")
    answers = spark.createDataFrame([(1, "依据《消防法》第六十条处罚"), (2, "依据《消防法》\n第六十条")], "answer_id int, answer string")
    got = {(r[0], r[1]) for r in vf.cited_articles(answers, known, aliases).collect()}
    assert got == {(1, "法·第六十条")}
    rows = spark.createDataFrame([
        (1, "处五千元以上五万元以下罚款", ["法·第六十条"], ["法·第六十条"]),
        (2, "处一万元以上十万元以下罚款", ["法·第六十条"], ["法·第六十条"]),
        (3, "处五千元以上五万元以下罚款", ["法·第六十条"], ["法·第六十条", "法·第七十二条"]),
        (4, "对个人处罚款", [], []),
    ], "id int, answer string, cited array<string>, mentioned array<string>").withColumns({
        "question": F.lit("消防怎么处罚"), "ref_items": F.array(F.lit("法·第六十条")),
        "ref_texts": F.array(F.lit("对单位处五千元以上五万元以下罚款"))})
    issues = {r["id"]: r["issues"] for r in vf.verify(rows).collect()}
    assert issues == {1: [], 2: ["fine_ok"], 3: ["citation_real"], 4: ["citation_present", "subject_ok"]}
