"""Queries of the guard pipeline, the prompt bridge and the support checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegraph.functions import text as tx
from clausegraph.operators import answer as an, guards as gd, verify as vf
from clausegraph.plans import guarded
from clausegraph.registry.base import register, spread_table, sql_units, table
from clausegraph.registry.lexical import questions

REFUSED, CALL = "refused by rule", "call for help"


def guard_requests(spark, d):
    """One request an event; ``k`` picks what the model answers at each attempt."""
    e = table(spark, d, "events").select("event_id", "event_type", (F.col("event_id") % 12).alias("k"), (F.col("user_id") % 9 + 1).alias("n"))
    number = F.concat(F.lit("第"), F.col("n"), F.lit("条"))
    asked = e.select(
        F.col("event_id").alias("answer_id"), F.when(F.col("k") == 7, "家里着火怎么办").otherwise(F.concat(F.lit("what about "), "event_type")).alias("question"),
        F.concat(F.lit("k="), "k", F.lit(" n="), "n", F.lit(" "), "event_type").alias("prompt"),
        F.when(F.col("k") < 10, 1).when(F.col("k") == 10, 0).cast("int").alias("n_provided"))
    given = e.where("k < 10").select(F.col("event_id").alias("answer_id"), F.lit("Act").alias("law_name"), F.lit("act").alias("law"), number.alias("num"),
                                     F.concat(F.lit("rule "), "event_type").alias("text"))
    return asked, given


def guard_model(rows):
    """A deterministic model: its reply follows from the prompt and the attempt alone."""
    k, n, kind = (F.regexp_extract("prompt", "^k=(\\d+) n=(\\d+) (\\w+)", i) for i in (1, 2, 3))
    good, bad = F.concat(F.lit("《Act》第"), n, F.lit("条：x")), F.lit("《Act》第99条：y")

    def reply(conclusion, *basis):
        return F.to_json(F.struct(conclusion.alias("conclusion"), F.array(*basis).alias("basis"), F.lit("s").alias("supplement"), F.lit("high").alias("confidence")))

    said, plain = F.concat(F.lit("c "), kind), F.lit("no json here")
    one = (F.when(k.isin("0", "7", "10", "11"), reply(said, good)).when(k == "1", reply(said, good, bad)).when(k == "6", plain)
           .when(k == "8", reply(F.lit("暂不回答"))).when(k == "9", reply(said, F.lit("无"))).otherwise(reply(said, bad)))
    two = F.when(k == "2", reply(said, good)).when(k == "4", reply(F.lit("无法回答"))).when(k == "5", plain).when(k == "9", reply(said, F.lit("无"))).otherwise(reply(said, bad))
    return rows.withColumn("reply", F.when(F.col("attempt") == 1, one).otherwise(two))


@register("guard_pipeline", f"""WITH e AS (SELECT event_id, event_type, event_id % 12 AS k, user_id % 9 + 1 AS n FROM events)
SELECT event_id AS answer_id,
  CASE k WHEN 1 THEN 'citation_guard' WHEN 2 THEN 'citation_retry' WHEN 3 THEN 'citation_retry,citation_rejected' WHEN 4 THEN 'citation_retry,refuse_guard'
    WHEN 5 THEN 'citation_retry,json_fallback,citation_rejected' WHEN 6 THEN 'json_fallback' WHEN 7 THEN 'emergency_guard' WHEN 8 THEN 'refuse_guard'
    WHEN 9 THEN 'citation_retry,citation_rejected' WHEN 10 THEN 'no_articles_guard' ELSE '' END AS guards,
  CASE WHEN k IN (3, 4, 5, 8, 9, 10) THEN '{REFUSED}' WHEN k = 6 THEN 'no json here' WHEN k = 7 THEN '{CALL}' ELSE 'c ' || event_type END AS conclusion,
  CASE WHEN k IN (0, 1, 2) THEN '《Act》第' || n || '条：rule ' || event_type || '。' WHEN k = 11 THEN '《Act》第' || n || '条：x' ELSE '' END AS basis,
  CAST(CASE WHEN k IN (2, 3, 4, 5, 9) THEN 2 ELSE 1 END AS BIGINT) AS attempts FROM e""")
def guard_pipeline(spark, d):
    asked, given = guard_requests(spark, d)
    out = guarded.guarded_answers(asked, given, guard_model, gd.answer_record(REFUSED, "outside", "none"), gd.answer_record(CALL, "now", "leave"), REFUSED)
    return out.select("answer_id", F.array_join("guards", ",").alias("guards"), "final.conclusion", F.array_join("final.basis", "|").alias("basis"),
                      F.col("attempts").cast("bigint").alias("attempts"))


@register("prompt_bridge", """WITH d AS (SELECT doc_id, doc_id // 4 AS query_id, doc_id % 4 AS rank,
    regexp_replace(regexp_replace(replace(replace(text, '【', '('), '】', ')'), '^[ \\t\\n\\r\\f\\x0B]+', ''), '[ \\t\\n\\r\\f\\x0B]+$', '') AS t FROM documents)
SELECT query_id, 'question ' || query_id AS question, string_agg('a' || doc_id, ' ' ORDER BY rank) AS keys,
  string_agg('a' || doc_id || ' title of ' || doc_id, '|' ORDER BY rank) AS heads, CAST(sum(length(t)) AS BIGINT) AS n_chars,
  string_agg(md5(t), ' ' ORDER BY rank) AS digests FROM d GROUP BY query_id""")
def prompt_bridge(spark, d):
    """All documents built into prompts and read back."""
    docs = spread_table(spark, d, "documents")
    text = F.replace(F.replace("text", F.lit("【"), F.lit("(")), F.lit("】"), F.lit(")"))  # the frame's own marks
    ranked = docs.select(F.expr("doc_id div 4").alias("query_id"), (F.col("doc_id") % 4).alias("rank"), F.concat(F.lit("a"), "doc_id").alias("num"),
                         F.concat(F.lit("title of "), "doc_id").alias("title"), text.alias("text"))
    prompts = an.context_block(ranked, 3).select("query_id", an.build_prompt(F.concat(F.lit("question "), "query_id"), F.col("context")).alias("prompt"))
    back = prompts.select("query_id", an.read_prompt(F.col("prompt")).alias("p"))
    arts = F.col("p.articles")
    return back.select(
        "query_id", F.col("p.question").alias("question"), F.array_join(arts.key, " ").alias("keys"), F.array_join(arts.head, "|").alias("heads"),
        F.aggregate(arts, F.lit(0).cast("bigint"), lambda acc, a: acc + F.char_length(a.text)).alias("n_chars"),
        F.array_join(F.transform(arts, lambda a: F.md5(a.text)), " ").alias("digests"))


_TERM = "[一-龥]{2,}|[A-Za-zÀ-ÿ]{4,}"
_EVIDENCE = """ev AS (SELECT d.doc_id AS answer_id, b.item_id, b.text FROM documents d, (SELECT count(*) AS n FROM benchmark) c
   JOIN benchmark b ON b.item_id = d.doc_id % c.n OR b.item_id = (d.doc_id + 1) % c.n)"""


def evidence_items(spark, d):
    """Two benchmark items as the evidence of each document."""
    items = table(spark, d, "benchmark")
    n = items.count()
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("answer_id"), F.explode(F.array((F.col("doc_id") % n), (F.col("doc_id") + 1) % n)).alias("item_id"))
    return docs.distinct().join(F.broadcast(items) if n <= 100_000 else items, "item_id").select("answer_id", "item_id", "text")


@register("unsupported_sentences", f"""WITH {sql_units()}, {_EVIDENCE},
s AS (SELECT item_id AS answer_id, unit_no AS pos, list_distinct(regexp_extract_all(lower(unit), '{_TERM}')) AS terms FROM units),
e AS (SELECT answer_id, item_id, list_distinct(regexp_extract_all(lower(text), '{_TERM}')) AS held FROM ev),
m AS (SELECT s.answer_id, pos, max(len(list_filter(terms, lambda t: list_contains(held, t)))) AS m, max(len(terms)) AS n
  FROM s JOIN e USING (answer_id) WHERE len(terms) > 0 GROUP BY ALL)
SELECT answer_id, CAST(count(*) AS BIGINT) AS n_unsupported, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(pos) AS BIGINT) AS last_pos
FROM m WHERE m < 0.25 * n GROUP BY answer_id""")
def unsupported_sentences(spark, d):
    docs = spread_table(spark, d, "documents").select(F.col("doc_id").alias("answer_id"), "text")
    open_ = vf.unsupported_sentences(docs, evidence_items(spark, d), lambda t: tx.sentences(t, tx.LATIN_DELIMITERS), 0.25)
    return open_.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_unsupported"), F.min("pos").cast("bigint").alias("first_pos"),
                                          F.max("pos").cast("bigint").alias("last_pos"))


@register("unsupported_marks", f"""WITH p AS (SELECT b.item_id AS query_id, d.doc_id, b.text AS question, d.text AS cited, 'about ' || d.n_chars || ' and ' || b.item_id AS said,
    d.doc_id % 3 = 0 AS retried FROM documents d, (SELECT count(*) AS n FROM benchmark) c JOIN benchmark b ON b.item_id = d.doc_id % c.n),
q AS (SELECT *, regexp_extract_all(question, '{_TERM}') AS terms,
  list_filter(list_distinct(regexp_extract_all(said, '[0-9]+(?:[.][0-9]+)?')), lambda x: NOT list_contains(regexp_extract_all(question, '[0-9]+(?:[.][0-9]+)?'), x)
    AND NOT contains(cited, x) AND cited <> '') AS stray FROM p)
SELECT doc_id, concat_ws(';', CASE WHEN retried THEN 'guard:citation_retry' END,
  CASE WHEN len(stray) > 0 THEN 'numbers:' || array_to_string(list_sort(stray), '/') END,
  CASE WHEN cited <> '' AND len(terms) > 0 AND len(list_filter(terms, lambda t: contains(cited, t))) = 0 THEN 'no common term' END) AS marks FROM q""")
def unsupported_marks(spark, d):
    items = questions(spark, d)
    n = items.count()
    docs = spread_table(spark, d, "documents").withColumn("query_id", F.col("doc_id") % n)
    pairs = docs.join(items.withColumnRenamed("text", "question"), "query_id")
    said = F.concat(F.lit("about "), "n_chars", F.lit(" and "), "query_id")
    guards = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("citation_retry"))).otherwise(F.array(F.lit("json_fallback")))
    return pairs.select("doc_id", F.array_join(vf.unsupported_marks(said, F.col("question"), F.col("text"), guards), ";").alias("marks"))


__all__ = ["guard_model", "guard_requests"]
