"""Citation, verification, metric and merging operators on rows derived from whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegraph.operators import answer, evaluate as ev, fusion, gate, understand as un, verify as vf
from clausegraph.packs.demo import SCENE
from clausegraph.registry.base import register, spread_table, table
from clausegraph.registry.graphs import has
from clausegraph.registry.understanding import _SCENE_COLS, turns


@register("case_metrics", """WITH r AS (SELECT l_returnflag = l_linestatus AS route, CASE WHEN l_linenumber <= 3 THEN (l_quantity > 25) = (l_discount > 0.05) END AS refusal,
  contains(l_returnflag || l_linestatus, 'AF')::INT + contains(l_returnflag || l_linestatus, 'RF')::INT AS severe,
  CASE WHEN l_linenumber > 1 THEN contains('item ' || l_returnflag || l_linestatus || ' rule ' || l_linenumber, 'R') END AS must,
  CASE WHEN l_linenumber > 1 THEN l_partkey % 3 IN (l_suppkey % 3, 0) END AS cite FROM lineitem)
SELECT count(*) AS cases, round(avg(route::INT), 6) AS route_accuracy, round(coalesce(avg(refusal::INT), 0), 6) AS refusal_accuracy,
  round(sum(severe) / count(*), 6) AS severe_error_rate, round(coalesce(avg(must::INT), 0), 6) AS must_conclusion_accuracy,
  round(coalesce(avg(cite::INT), 0), 6) AS citation_accuracy FROM r""")
def case_metrics(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("intent"), F.col("l_linestatus").alias("want_intent"), (F.col("l_quantity") > 25).alias("refused"),
        F.when(F.col("l_linenumber") <= 3, F.col("l_discount") > 0.05).alias("should_refuse"),
        F.concat(F.lit("item "), "l_returnflag", "l_linestatus").alias("answer"),
        F.concat(F.lit("rule "), F.col("l_linenumber").cast("string")).alias("ref_text"),
        F.array(F.lit("AF"), F.lit("RF")).alias("forbidden"), F.array(F.lit("R"), F.lit("rule")).alias("musts"),
        (F.col("l_linenumber") > 1).alias("has_gold"), F.array(F.col("l_partkey") % 3).alias("cited"),
        F.array(F.col("l_suppkey") % 3, F.lit(0)).alias("ref_items"))
    out = ev.case_metrics(rows)
    return out.select("cases", *[F.round(c, 6).alias(c) for c in out.columns if c != "cases"])


@register("citation_validation", """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, '第' || (l_partkey + 1) || '条' AS num,
  'law ' || l_suppkey % 2 AS said, 'law ' || l_linenumber % 2 AS law FROM lineitem)
SELECT b.l_orderkey AS answer_id, b.l_linenumber::BIGINT AS pos, '《' || b.said || '》' || b.num AS entry,
  max('《' || p.law || '》' || p.num || '：' || p.l_returnflag || ' applies。') AS citation, count(p.law) > 0 AS valid
FROM l b LEFT JOIN l p ON p.l_orderkey = b.l_orderkey AND p.l_partkey = b.l_partkey AND p.law = b.said GROUP BY 1, 2, 3""")
def citation_validation(spark, d):
    num = F.concat(F.lit("第"), (F.col("l_partkey") + 1).cast("string"), F.lit("条"))
    lines = table(spark, d, "lineitem").withColumn("num", num)
    said = F.concat(F.lit("《law "), (F.col("l_suppkey") % 2).cast("string"), F.lit("》"))
    side = (F.col("l_linenumber") % 2).cast("string")
    basis = lines.select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").cast("bigint").alias("pos"), F.concat(said, "num").alias("entry"))
    provided = lines.select(F.col("l_orderkey").alias("answer_id"), F.concat(F.lit("law "), side).alias("law_name"),
                            F.concat(F.lit("L"), side).alias("law"), "num", F.concat("l_returnflag", F.lit(" applies。")).alias("text"))
    return vf.validate_citations(basis, provided).select("answer_id", "pos", "entry", "citation", "valid")


@register("canonical_citation", """SELECT doc_id, '《' || source || '》第' || doc_id || '条：' || rtrim(left(text, 120), '。') || '。' AS citation FROM documents""")
def canonical_citation(spark, d):
    num = F.concat(F.lit("第"), F.col("doc_id").cast("string"), F.lit("条"))
    return table(spark, d, "documents").select("doc_id", vf.canonical_citation(F.col("source"), num, F.col("text")).alias("citation"))


@register("cited_items", """WITH k AS (SELECT DISTINCT unnest([CASE p_size % 3 WHEN 0 THEN 'b1' WHEN 1 THEN 'core' ELSE 'b2' END, 'extra']) || '·第' || p_size || '条' AS item_id FROM part),
q AS (SELECT p_partkey AS query_id, p_size, CASE WHEN contains(p_brand, 'Brand#1') THEN ['b1'] WHEN contains(p_brand, 'Brand#2') THEN ['b2'] ELSE ['core', 'extra'] END AS laws FROM part),
a AS (SELECT query_id, unnest(list_distinct(['第' || p_size || '条', '第' || (p_size + 1) || '条'])) AS num, laws FROM q),
t AS (SELECT query_id, num, unnest(laws) AS law, generate_subscripts(laws, 1) AS prio FROM a)
SELECT query_id, arg_min(item_id, prio) AS item_id FROM t JOIN k ON item_id = law || '·' || num GROUP BY query_id, num""")
def cited_items(spark, d):
    part = table(spark, d, "part")
    size = F.col("p_size").cast("string")
    law = F.when(F.col("p_size") % 3 == 0, "b1").when(F.col("p_size") % 3 == 1, "core").otherwise("b2")
    known = part.select(F.explode(F.array(law, F.lit("extra"))).alias("law"), size.alias("n")).select(
        F.concat("law", F.lit("·第"), "n", F.lit("条")).alias("item_id"))
    asked = part.select(F.col("p_partkey").alias("query_id"), F.concat(
        "p_brand", F.lit(" 第"), size, F.lit("条，第"), (F.col("p_size") + 1).cast("string"), F.lit("条")).alias("text"))
    return un.cited_items(asked, [("Brand#1", "b1"), ("Brand#2", "b2")], ["core", "extra"], known)


FORCED = [(["anea"], ["que ", "heit"], ["1", "2"]), (["heed", "ung"], [], ["2", "absent"])]


@register("forced_items", f"""SELECT DISTINCT doc_id AS query_id, item_id FROM (
  SELECT doc_id, unnest(['1', '2']) AS item_id FROM documents WHERE {has('text', FORCED[0][0])} AND {has('text', FORCED[0][1])}
  UNION ALL SELECT doc_id, unnest(['2', 'absent']) FROM documents WHERE {has('text', FORCED[1][0])}) x
WHERE item_id IN (SELECT doc_id::VARCHAR FROM documents)""")
def forced_items(spark, d):
    docs = spread_table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "text")
    return un.forced_items(docs, FORCED, table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("item_id")))


IDLE, EXPLORING, CONCRETE = ["zuver"], ["que", "der "], ["thst"]


@register("needs_guide", f"""WITH s AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS q, {_SCENE_COLS} FROM conversations),
h AS (SELECT *, len(behaviors) > 0 OR len(objects) > 0 OR len(venues) > 0 OR len(list_filter(subjects, lambda x: x <> 'reader')) > 0 AS scene FROM s)
SELECT conv_id, turn, q = '' OR {has('q', IDLE)} OR q = 'hi' OR (length(q) <= 60 AND NOT scene)
  OR ({has('q', EXPLORING)} AND NOT scene AND NOT {has('q', CONCRETE)}) AS needs_guide FROM h""")
def needs_guide(spark, d):
    rows = un.scene(turns(spark, d), SCENE)
    broad = gate.needs_guide(F.col("text"), IDLE, ["hi"], EXPLORING, CONCRETE, ["reader"], short=60)
    return rows.select("conv_id", "turn", broad.alias("needs_guide"))


@register("late_outcome", """WITH o AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS broad, o_custkey % 2 = 0 AS named,
  CASE o_orderkey % 4 WHEN 0 THEN 'Correct' WHEN 1 THEN 'BelowThreshold' WHEN 2 THEN 'Ambiguous' ELSE 'Incorrect' END AS crag FROM orders)
SELECT o_orderkey, CASE WHEN broad AND NOT named THEN 'guide_broad' WHEN crag = 'BelowThreshold' THEN 'refuse_confidence'
  WHEN crag = 'Ambiguous' THEN 'guide_evidence' WHEN crag = 'Incorrect' THEN 'refuse_unrelated' ELSE 'answer' END AS outcome FROM o""")
def late_outcome(spark, d):
    k = F.col("o_orderkey") % 4
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 2 == 0).alias("cite_inject"), F.when(k == 0, "Correct")
                                            .when(k == 1, "BelowThreshold").when(k == 2, "Ambiguous").otherwise("Incorrect").alias("crag"))
    return rows.select("o_orderkey", gate.late_outcome(F.col("o_orderkey") % 3 == 0).alias("outcome"))


@register("verification_checks", """WITH p AS (SELECT p_partkey, p_size % 4 AS a, p_partkey % 3 AS q, p_partkey % 5 AS r, p_partkey % 7 < 3 AS tall FROM part),
c AS (SELECT p_partkey, NOT ((a = 0 AND r = 1) OR (a = 1 AND r = 0)) AS subject_ok, NOT (q <> 0 AND a < 3 AND tall) AS building_ok,
  NOT (q < 2 AND a < 3 AND r > 1) AS penalty_ok FROM p)
SELECT *, subject_ok AND building_ok AND penalty_ok AS passed FROM c""")
def verification_checks(spark, d):
    def pick(value, *texts):
        return F.element_at(F.array(*map(F.lit, texts)), value.cast("int") + 1)

    key = F.col("p_partkey")
    items = F.array(F.when(key % 7 < 3, "高层规定·1").otherwise("规定·1"))
    rows = table(spark, d, "part").select(
        key, pick(F.col("p_size") % 4, "对单位处罚款", "对个人处罚款", "责令改正", "无").alias("answer"),
        pick(key % 3, "高层如何处罚", "如何处罚", "说明").alias("question"),
        F.array(pick(key % 5, "单位罚款", "个人罚款", "说明", "说明", "说明")).alias("ref_texts"),
        *[items.alias(c) for c in ("ref_items", "cited", "mentioned")])
    return vf.verify(rows).select("p_partkey", "subject_ok", "building_ok", "penalty_ok", "passed")


@register("merge_variants", """SELECT l_orderkey AS query_id, l_returnflag AS channel, l_partkey % 5 AS item_id, max(l_quantity) AS score, max('order ' || l_orderkey) AS path
FROM lineitem GROUP BY 1, 2, 3""")
def merge_variants(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("channel"), (F.col("l_partkey") % 5).alias("item_id"),
        F.col("l_quantity").alias("score"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("path"))
    return fusion.merge_variants(rows)


@register("damp_non_core", """SELECT l_orderkey AS query_id, l_partkey AS item_id, CASE WHEN l_returnflag = 'A' THEN 'graph' ELSE 'bm25' END AS channel,
  CASE WHEN l_linestatus = 'F' OR l_returnflag = 'A' THEN l_quantity ELSE l_quantity * 0.55::DOUBLE END AS score FROM lineitem""")
def damp_non_core(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item_id"), "l_linestatus",
        F.when(F.col("l_returnflag") == "A", "graph").otherwise("bm25").alias("channel"), F.col("l_quantity").alias("score"))
    return fusion.damp_non_core(rows, F.col("l_linestatus") == "F").select("query_id", "item_id", "channel", "score")


_LABEL = "CASE event_id % 3 " + " ".join(f"WHEN {i} THEN '{answer.LABELS.get(k, k)}'" for i, k in enumerate(("high", "medium", "low"))) + " END"


@register("render_answer", f"""SELECT event_id, '【结论】' || event_type || chr(10) || '【适用条件】user ' || user_id || chr(10) || '【依据】' || event_type || chr(10) || user_id
  || chr(10) || '【补充】' || coalesce(props, '') || chr(10) || '【可信度】' || {_LABEL} AS body FROM events""")
def render_answer(spark, d):
    user = F.col("user_id").cast("string")
    level = F.element_at(F.array(*map(F.lit, ("high", "medium", "low"))), (F.col("event_id") % 3).cast("int") + 1)
    body = answer.render(F.col("event_type"), F.concat(F.lit("user "), user), F.array("event_type", user), F.coalesce("props", F.lit("")), level)
    return table(spark, d, "events").select("event_id", body.alias("body"))


@register("outside_titles", """WITH t AS (SELECT p_partkey AS query_id, p_name || ' rules' AS title, CASE WHEN p_size % 10 = 0 THEN 'GB' || (1000 + p_size) END AS standard FROM part),
k AS (SELECT DISTINCT p_name || ' rules' AS name FROM part WHERE p_size = 7 AND p_brand = 'Brand#2'),
n AS (SELECT query_id, coalesce(CASE WHEN length(title) BETWEEN 4 AND 30 AND NOT EXISTS (SELECT 1 FROM k WHERE contains(name, title) OR contains(title, name))
  THEN title END, standard) AS named FROM t)
SELECT * FROM n WHERE named IS NOT NULL""")
def outside_titles(spark, d):
    part = table(spark, d, "part").withColumn("title", F.concat("p_name", F.lit(" rules")))
    size = (F.col("p_size") + 1000).cast("string")
    text = F.concat(F.lit("参照《"), "title", F.lit("》"), F.when(F.col("p_size") % 10 == 0, F.concat(F.lit(" GB "), size)).otherwise(""))
    known = part.where("p_size = 7 AND p_brand = 'Brand#2'").select(F.col("title").alias("name"))
    return un.outside_titles(part.select(F.col("p_partkey").alias("query_id"), text.alias("text")), known, [])


_MERGED = ", ".join(f"array_to_string(list_concat(c.{a}, list_filter(p.{a}, lambda x: NOT list_contains(c.{a}, x))), ',') AS {a}" for a in un.SCENE_ARRAYS)


@register("scene_merge", f"""WITH s AS (SELECT conv_id, turn, {_SCENE_COLS} FROM conversations)
SELECT c.conv_id, c.turn, {_MERGED} FROM s c JOIN s p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1""")
def scene_merge(spark, d):
    found = un.scene(turns(spark, d), SCENE).select("conv_id", "turn", *un.SCENE_ARRAYS)
    before = found.select("conv_id", (F.col("turn") + 1).alias("turn"), *[F.col(a).alias(f"prev_{a}") for a in un.SCENE_ARRAYS])
    merged = un.merge_scenes(found.join(before, ["conv_id", "turn"]))
    return merged.select("conv_id", "turn", *[F.array_join(a, ",").alias(a) for a in un.SCENE_ARRAYS])


_ONE, _TWO = SCENE.clarify["channel_type"], SCENE.clarify["subject"]


@register("clarify_text", f"""SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN '{SCENE.clarify_many}{_ONE} {_TWO}'
  WHEN p_size % 2 = 0 THEN '{SCENE.clarify_one}{_ONE}' WHEN p_size % 3 = 0 THEN '{SCENE.clarify_one}{_TWO}' END AS question FROM part""")
def clarify_text(spark, d):
    missing = F.array(F.when(F.col("p_size") % 2 == 0, "channel_type"), F.when(F.col("p_size") % 3 == 0, "subject"))
    rows = table(spark, d, "part").select("p_partkey", F.filter(missing, lambda m: m.isNotNull()).alias("ambiguity"))
    return rows.select("p_partkey", un.clarify(SCENE).alias("question"))
