"""Scene, routing, risk, gate and verification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegraph.functions import numerals
from clausegraph.operators import gate, understand as un, verify as vf
from clausegraph.packs.demo import RISK, ROUTE, SCENE
from clausegraph.registry.base import register, spread_table, table
from clausegraph.registry.graphs import has, names


def turns(spark, d):
    return spread_table(spark, d, "conversations").select("conv_id", "turn", "role", "text")


def _join(arr: str) -> str:
    return f"array_to_string({arr}, ',')"


@register("keyword_any", f"""SELECT doc_id, {has('lower(text)', ROUTE.domain)} AS domain, {has('text', ROUTE.law_priority)} AS law,
  {has('text', ROUTE.strong_emergency)} AS strong FROM documents""")
def keyword_any(spark, d):
    from clausegraph.functions.text import contains_any

    docs = spread_table(spark, d, "documents")
    return docs.select("doc_id", contains_any(F.lower("text"), ROUTE.domain).alias("domain"),
                       contains_any("text", ROUTE.law_priority).alias("law"),
                       contains_any("text", ROUTE.strong_emergency).alias("strong"))


_SCENE_COLS = f"""{names('text', SCENE.subjects)} AS subjects, {names('text', SCENE.behaviors)} AS behaviors, {names('text', SCENE.venues)} AS venues,
  {names('text', SCENE.objects)} AS objects, {names('text', SCENE.intents)} AS intents"""


@register("multi_map_match", f"""SELECT conv_id, turn, {_join('subjects')} AS subjects, {_join('behaviors')} AS behaviors, {_join('venues')} AS venues,
  {_join('objects')} AS objects, {_join('intents')} AS intents FROM (SELECT conv_id, turn, {_SCENE_COLS} FROM conversations) s""")
def multi_map_match(spark, d):
    s = un.scene(turns(spark, d), SCENE)
    return s.select("conv_id", "turn", *[F.array_join(c, ",").alias(c) for c in un.SCENE_ARRAYS])


@register("ordered_first_match", f"""SELECT doc_id, coalesce(CASE {' '.join(f"WHEN {has('text', [p])} THEN '{n}'" for n, ps in SCENE.behaviors for p in ps)} END, '') AS first_name
FROM documents""")
def ordered_first_match(spark, d):
    from clausegraph.operators.lexicon import PhraseMatcher

    pairs = [(n, [p]) for n, ps in SCENE.behaviors for p in ps]
    m = PhraseMatcher([p for _, ps in pairs for p in ps])
    rows = m.annotate(spread_table(spark, d, "documents"), "text")
    return rows.select("doc_id", F.coalesce(m.first(pairs), F.lit("")).alias("first_name"))


_SCENE_SQL = f"""s0 AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, {_SCENE_COLS} FROM conversations),
s1 AS (SELECT *, list_contains(objects, 'route') OR {has('text', SCENE.specific_channel_words)} AS specific,
   list_contains(intents, 'penalty') AS pen, {has('text', SCENE.penalty_markers)} AS marker FROM s0),
s2 AS (SELECT *, pen AND (specific OR contains(text, '{SCENE.channel_word}') OR list_contains(behaviors, 'block')) AND NOT specific AS vague,
   len(subjects) = 0 AND NOT regexp_matches(text, '{SCENE.actor_pattern}') AS no_actor,
   (pen OR marker) AND (list_contains(intents, 'responsible') OR list_contains(intents, 'obligation') OR {has('text', SCENE.duty_markers)})
     OR (contains(text, '{SCENE.duty_word}') AND marker) AS compound FROM s1),
s3 AS (SELECT *, CASE WHEN vague AND no_actor THEN 'channel_type,subject' WHEN vague THEN 'channel_type' ELSE '' END AS ambiguity,
   CASE WHEN len(behaviors) = 0 AND len(objects) = 0 THEN text ELSE array_to_string(subjects[1:1] || behaviors ||
     list_filter(objects[1:1], lambda o: NOT list_contains(subjects[1:1] || behaviors, o)) || venues[1:1] || intents[1:1], ' ') END AS rewrite,
   CASE WHEN {has('text', SCENE.global_markers)} OR (list_contains(intents, 'obligation') AND NOT marker AND {has('text', SCENE.list_words)})
     THEN 'global' ELSE 'local' END AS query_mode,
   array_to_string(subjects[1:1] || behaviors[1:2] || objects[1:2] || venues[1:2], ' ') AS bones FROM s2)"""


@register("scene_structure", f"""WITH {_SCENE_SQL}
SELECT conv_id, turn, ambiguity, rewrite, query_mode, CAST(CASE WHEN trim(text) = '' THEN 0 WHEN compound THEN 3
   WHEN rewrite = trim(text) OR rewrite = '' THEN 1 ELSE 2 END AS BIGINT) AS n_sub FROM s3""")
def scene_structure(spark, d):
    s = un.scene(turns(spark, d), SCENE)
    return s.select("conv_id", "turn", F.array_join("ambiguity", ",").alias("ambiguity"), "rewrite", "query_mode",
                    F.size("sub_queries").cast("bigint").alias("n_sub"))


@register("query_decompose", f"""WITH {_SCENE_SQL}
SELECT conv_id, turn, (CASE WHEN bones = '' THEN trim(text) ELSE bones END) || ' {SCENE.duty_suffix}' AS first_sub FROM s3 WHERE compound""")
def query_decompose(spark, d):
    s = un.scene(turns(spark, d), SCENE)
    return s.where(F.endswith(F.col("sub_queries")[0], F.lit(" " + SCENE.duty_suffix))).select(
        "conv_id", "turn", F.col("sub_queries")[0].alias("first_sub"))


_Q = "lower(coalesce(text, ''))"
_ROUTE_SQL = f"""r0 AS (SELECT conv_id, turn, text, {_Q} AS q, replace({_Q}, '{ROUTE.neutral_replace[0]}', '{ROUTE.neutral_replace[1]}') AS qf FROM conversations),
r1 AS (SELECT *, {has('qf', [*ROUTE.strong_emergency, *ROUTE.weak_emergency])} AS strong,
   {has('q', ROUTE.duty_topics)} AND {has('q', ROUTE.duty_lacks)} AND NOT {has('q', ROUTE.immediate)} AS complaint,
   {has('q', ROUTE.law_priority)} OR (contains(q, '{ROUTE.law_scene_anchor}') AND {has('q', ROUTE.law_scene)}) AS consult,
   {has('q', ROUTE.alarm_words)} AND {has('q', ROUTE.alarm_context)} AS alarm FROM r0),
r2 AS (SELECT *, NOT complaint AND (strong OR (NOT consult AND alarm)) AS emergency FROM r1),
routed AS (SELECT conv_id, turn, text, strong, consult, emergency, CASE WHEN {has('q', ROUTE.refuse_words)} AND NOT contains(q, '{ROUTE.refuse_unless}') THEN 'refuse'
   WHEN NOT {has('q', ROUTE.domain)} AND {has('q', ROUTE.off_topic)} THEN 'refuse' WHEN consult THEN 'law' WHEN emergency THEN 'emergency'
   WHEN {has('q', ROUTE.punish_words)} OR ({has('q', ROUTE.domain)} AND NOT contains(q, '{ROUTE.domain_unless}')) THEN 'law'
   WHEN {has('q', ROUTE.chat)} OR length(q) <= {ROUTE.short} THEN 'chitchat' ELSE 'refuse' END AS intent FROM r2)"""


@register("intent_route", f"WITH {_ROUTE_SQL} SELECT conv_id, turn, intent, emergency FROM routed")
def intent_route(spark, d):
    return un.route(turns(spark, d), ROUTE).select("conv_id", "turn", "intent", F.col("active_emergency").alias("emergency"))


def _reason(b: str) -> str:
    return "CASE " + " ".join(f"WHEN {b} = '{k}' THEN '{v}'" for k, v in RISK.reasons.items()) + f" ELSE {b} END"


_RISK_SQL = f"""{_ROUTE_SQL}, {_SCENE_SQL},
k0 AS (SELECT s.*, r.intent, r.emergency, r.strong, r.consult, list_filter(behaviors, lambda b: b = 'block') AS high,
   CASE WHEN list_contains(venues, 'tower') THEN ['{RISK.venue_reason}'] ELSE []::VARCHAR[] END AS vr
   FROM s3 s JOIN routed r USING (conv_id, turn)),
risk AS (SELECT *, CASE WHEN intent = 'emergency' OR emergency THEN 'emergency' WHEN len(high) > 0 THEN 'high'
     WHEN len(behaviors) > 0 OR pen THEN 'medium' ELSE 'low' END AS risk_level,
   CASE WHEN intent = 'emergency' OR emergency THEN ['{RISK.emergency_reason}']
     WHEN len(high) > 0 THEN (list_transform(high[1:2], lambda b: {_reason('b')}) || vr)[1:3]
     WHEN len(behaviors) > 0 THEN (list_transform(behaviors[1:2], lambda b: {_reason('b')}) || vr)[1:3]
     WHEN pen THEN ['{RISK.penalty_reason}'] ELSE []::VARCHAR[] END AS reasons FROM k0)"""


def understood(spark, d):
    return un.risk(un.scene(un.route(turns(spark, d), ROUTE), SCENE), RISK, SCENE.penalty_intent)


@register("risk_level", f"WITH {_RISK_SQL} SELECT conv_id, turn, risk_level, array_to_string(reasons, '|') AS reasons FROM risk")
def risk_level(spark, d):
    return understood(spark, d).select("conv_id", "turn", "risk_level", F.array_join("risk_reasons", "|").alias("reasons"))


MARKERS = ["heed", "ment ", "ung "]
_FOLLOW = f"""users AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS now,
   trim(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')) AS before FROM conversations WHERE role = 'user'),
fu AS (SELECT *, before <> '' AND (length(now) <= 24 OR {has('now', MARKERS)}) AS used FROM users)"""


@register("followup_merge", f"""WITH {_FOLLOW}
SELECT conv_id, turn, used AS context_used, CASE WHEN used THEN before || ' ; ' || now ELSE now END AS full_question FROM fu""")
def followup_merge(spark, d):
    users = turns(spark, d).where("role = 'user'")
    merged = un.merge_followup(un.with_previous(users, "conv_id", "turn"), MARKERS, " ; ")
    return merged.select("conv_id", "turn", "context_used", "full_question")


@register("outcome_route", f"""WITH {_RISK_SQL},
esc AS (SELECT *, CASE WHEN intent = 'refuse' AND (len(behaviors) > 0 OR len(objects) > 0) THEN 'law' ELSE intent END AS i1 FROM risk),
esc2 AS (SELECT *, CASE WHEN risk_level = 'emergency' AND (strong OR NOT consult) AND i1 IN ('law', 'chitchat') THEN 'emergency' ELSE i1 END AS i2,
   length(regexp_replace(trim(text), '[^一-鿿A-Za-z0-9]', '', 'g')) AS useful, length(trim(text)) AS n FROM esc)
SELECT conv_id, turn, i2 AS intent, CASE WHEN useful = 0 OR (n >= 4 AND useful::DOUBLE / n < 0.35) THEN 'refuse_input'
  WHEN contains(text, 'Licen') THEN 'refuse_outside' WHEN i2 = 'emergency' THEN 'emergency' WHEN i2 = 'refuse' THEN 'refuse_domain'
  WHEN i2 = 'chitchat' THEN 'guide_chat' WHEN ambiguity <> '' THEN 'clarify' ELSE 'retrieve' END AS outcome FROM esc2""")
def outcome_route(spark, d):
    rows = un.escalate(understood(spark, d)).withColumn("context_used", F.lit(False))
    early = gate.early_outcome(F.contains("text", F.lit("Licen")), un.is_gibberish(F.col("text")))
    return rows.select("conv_id", "turn", "intent", F.coalesce(early, F.lit("retrieve")).alias("outcome"))


# Confidence gate: documents play the top candidate of a question, columns are derived from their facts.
_GATE = """g AS (SELECT doc_id, round((n_chars % 97) / 97.0::DOUBLE, 6) AS score, CASE WHEN n_chars % 3 = 0 THEN NULL ELSE round((n_chars % 89) / 89.0::DOUBLE, 6) END AS ce,
   n_chars % 11 = 0 AS inj, n_chars % 5 = 0 AS gh, round((n_chars % 13) / 50.0::DOUBLE, 6) AS vec, round((n_chars % 7) / 7.0::DOUBLE, 6) AS cov FROM documents)"""


@register("confidence_gate", f"""WITH {_GATE}
SELECT doc_id, CASE WHEN score <= 0.12 THEN 'Incorrect' WHEN inj THEN 'Correct' WHEN ce IS NOT NULL AND ce < 0.60 AND score < 0.63 THEN 'BelowThreshold'
  WHEN (NOT gh AND vec < 0.08 AND cov < 0.5 AND score <= 0.45) OR score <= 0.22 THEN 'Ambiguous' ELSE 'Correct' END AS crag FROM g""")
def confidence_gate(spark, d):
    n = F.col("n_chars")
    rows = table(spark, d, "documents").select(
        "doc_id", F.round((n % 97) / 97.0, 6).alias("score"),
        F.when(n % 3 != 0, F.round((n % 89) / 89.0, 6)).alias("cross_encoder"), (n % 11 == 0).alias("cite_inject"),
        (n % 5 == 0).alias("graph_hit"), F.lit(False).alias("direct_match"), F.round((n % 13) / 50.0, 6).alias("vector"),
        F.round((n % 7) / 7.0, 6).alias("coverage"))
    return rows.select("doc_id", gate.confidence().alias("crag"))


# Numerals: numbers of the tables written in Chinese characters and read back.
_DIGITS = "零一二三四五六七八九"


def _spell(c):
    """Spelling of 0..9999 with every unit written, zeros skipped."""
    out = []
    for power, unit in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
        digit = (F.floor(c / power) % 10).cast("int")
        out.append(F.when(digit > 0, F.concat(F.substring(F.lit(_DIGITS), digit + 1, F.lit(1)), F.lit(unit))).otherwise(""))
    return F.concat(*out)


def _spell_whole(c):
    """Spelling of any number; digits from 100,000,000 on, for which there is no character."""
    myriads = F.floor(c / 10000)
    spelled = F.concat(F.when(myriads > 0, F.concat(_spell(myriads), F.lit("万"))).otherwise(""), _spell(c % 10000))
    return F.when(c == 0, "零").when(c >= 100_000_000, c.cast("string")).otherwise(spelled)


@register("cn_numerals", """SELECT p_partkey, CAST(p_partkey AS BIGINT) AS plain, CAST(p_size * 10000 + p_partkey % 10000 AS BIGINT) AS big FROM part""")
def cn_numerals(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select("p_partkey", numerals.numeral_value(_spell_whole(key)).alias("plain"),
                                          numerals.numeral_value(_spell_whole(size * 10000 + key % 10000)).alias("big"))


@register("fine_ranges", """SELECT o_orderkey, CAST(least(a, b) AS BIGINT) AS low, CAST(CASE WHEN b < a THEN a ELSE b END AS BIGINT) AS high
FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS a, (o_custkey * 100)::BIGINT AS b FROM orders) x WHERE a <= b
UNION ALL SELECT o_orderkey, a, a FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS a, (o_custkey * 100)::BIGINT AS b FROM orders) y WHERE a > b""")
def fine_ranges(spark, d):
    text = F.concat(F.lit("处"), F.floor("o_totalprice"), F.lit("元以上"), F.col("o_custkey") * 100, F.lit("元以下罚款"))
    rows = table(spark, d, "orders").select("o_orderkey", F.explode(numerals.fine_ranges(text)).alias("r"))
    return rows.select("o_orderkey", "r.low", "r.high")


@register("duration_ranges", """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, least(a, b) AS low, greatest(a, b) AS high, CASE WHEN l_linestatus = 'O' THEN '月' ELSE '日' END AS unit
FROM (SELECT *, l_quantity::BIGINT AS a, (l_linenumber * 9)::BIGINT AS b FROM lineitem) x""")
def duration_ranges(spark, d):
    unit2 = F.when(F.col("l_linestatus") == "O", "月").otherwise("天")
    text = F.concat(F.lit("拘留"), F.col("l_quantity").cast("bigint"), F.lit("日以上"), F.col("l_linenumber") * 9, unit2, F.lit("以下"))
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
                                              F.explode(numerals.durations(text)).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", "r.low", "r.high", "r.unit")


@register("citation_check", """WITH ans AS (SELECT c_custkey AS answer_id, c_nationkey % 7 + 1 AS a, c_nationkey % 5 + 1 AS b FROM customer),
m AS (SELECT answer_id, 'N' || n.n_nationkey AS item_id, n.n_nationkey % 7 + 1 = a AND n.n_nationkey % 5 + 1 = b AS ok FROM ans JOIN nation n ON n.n_nationkey % 7 + 1 = a)
SELECT answer_id, CAST(count(*) AS BIGINT) AS n_mentioned, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS n_fabricated FROM m GROUP BY answer_id""")
def citation_check(spark, d):
    nations = table(spark, d, "nation")
    known = nations.select(F.concat(F.lit("N"), "n_nationkey").alias("item_id"), F.lit("法典").alias("law"),
                           F.concat(F.lit("第"), F.col("n_nationkey") % 7 + 1, F.lit("条")).alias("num"),
                           (F.col("n_nationkey") % 5 + 1).alias("b"))
    answers = table(spark, d, "customer").select(
        F.col("c_custkey").alias("answer_id"), (F.col("c_nationkey") % 5 + 1).alias("b"),
        F.concat(F.lit("结论：\n依据《法典》第 "), F.col("c_nationkey") % 7 + 1, F.lit("条处理\n另见第九十九条")).alias("answer"))
    aliases = spark.createDataFrame([("法典", "法典")], "law string, alias string")
    mentioned = vf.cited_articles(answers, known, aliases)
    refs = known.select("item_id", F.col("b").alias("item_b"))
    marked = mentioned.join(answers.select("answer_id", "b"), "answer_id").join(refs, "item_id")
    return marked.groupBy("answer_id").agg(
        F.count(F.lit(1)).alias("n_mentioned"), F.count_if(F.col("b") != F.col("item_b")).alias("n_fabricated"))


@register("number_support", """WITH n AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[0-9]+(?:[.][0-9]+)?')) AS said, source, n_chars FROM documents)
SELECT doc_id, CAST(len(list_filter(said, lambda x: NOT list_contains(regexp_extract_all(source, '[0-9]+(?:[.][0-9]+)?'), x)
  AND NOT contains(n_chars::VARCHAR, x))) AS BIGINT) AS n_stray FROM n""")
def number_support(spark, d):
    docs = spread_table(spark, d, "documents")
    stray = vf.unsupported_numbers(F.col("text"), F.col("source"), F.col("n_chars").cast("string"))
    return docs.select("doc_id", F.size(stray).cast("bigint").alias("n_stray"))


@register("verification_report", """WITH a AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS p, o_custkey % 4 AS k FROM orders)
SELECT o_orderkey, NOT (k = 1 AND p >= 10000) AS fine_ok, k <> 2 AS duration_ok, NOT (k = 1 AND p >= 10000) AND k <> 2 AND k <> 3 AS passed FROM a""")
def verification_report(spark, d):
    k, p = F.col("o_custkey") % 4, F.floor("o_totalprice")
    fine = F.concat(F.when(k == 1, p + 5).otherwise(p), F.lit("元罚款"))
    days = F.when(k == 2, "三十日").otherwise("十五日")
    body = F.when(k == 3, F.concat(F.lit("对单位处"), fine)).otherwise(F.concat(F.lit("处"), fine))
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.concat(body, F.lit("，拘留"), days).alias("answer"), F.lit("怎么处罚").alias("question"),
        F.array(F.concat(F.when(k == 3, "个人处").otherwise("处"), p, F.lit("元罚款，拘留十五日"))).alias("ref_texts"),
        F.array(F.lit("法·1")).alias("ref_items"), F.array(F.lit("法·1")).alias("cited"), F.array(F.lit("法·1")).alias("mentioned"))
    return vf.verify(rows).select("o_orderkey", "fine_ok", "duration_ok", "passed")


