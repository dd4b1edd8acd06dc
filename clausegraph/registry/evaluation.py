"""Evaluation, dedupe, ingest, log and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegraph.operators import dedupe, evaluate as ev, lexical as lx, limits
from clausegraph.functions import text as tx
from clausegraph.registry.base import register, spread_table, table
from clausegraph.registry.channels import SQL_QUOTED, quoted_items
from clausegraph.registry.lexical import _PLAIN, _bm25_sql, document_tokens, questions, stored_index
from clausegraph.sources import corpus, looking_ahead

# ------------------------------------------------------------------ metrics

_RANKED = f"""{_bm25_sql(_PLAIN)},
rk AS (SELECT * FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, item_id) AS rank FROM best) r WHERE rank <= 8),
{SQL_QUOTED},
gold AS (SELECT DISTINCT query_id, item_id FROM quoted)"""


@register("hit_mrr", f"""WITH {_RANKED},
f AS (SELECT g.query_id, min(rank) AS first FROM (SELECT DISTINCT query_id FROM gold) g
  LEFT JOIN (SELECT rk.* FROM rk JOIN gold USING (query_id, item_id) WHERE rank <= 5) h USING (query_id) GROUP BY g.query_id)
SELECT count(*) AS cases, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit1, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit3,
  round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr FROM f""")
def hit_mrr(spark, d):
    ranked = lx.bm25_search(stored_index(spark, d), questions(spark, d), 8)
    return ev.hit_mrr(ranked, quoted_items(spark, d)).select("cases", *[F.round(c, 6).alias(c) for c in ("hit1", "hit3", "mrr")])


@register("training_pairs", f"""WITH {_RANKED},
wr AS (SELECT rk.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM rk
  WHERE query_id IN (SELECT query_id FROM gold) AND NOT EXISTS (SELECT 1 FROM gold g WHERE g.query_id = rk.query_id AND g.item_id = rk.item_id))
SELECT query_id, item_id, 1::BIGINT AS label FROM gold UNION ALL SELECT query_id, item_id, 0 FROM wr WHERE r <= 4""")
def training_pairs(spark, d):
    ranked = lx.bm25_search(stored_index(spark, d), questions(spark, d), 8)
    return ev.training_pairs(ranked, quoted_items(spark, d)).select("query_id", "item_id", F.col("label").cast("bigint").alias("label"))


@register("masked_rates", """SELECT source, round(avg(CASE WHEN quality IS NOT NULL THEN (quality = 1)::INT END), 6) AS good_rate, count(quality) AS good_n,
  round(avg(CASE WHEN quality = 1 THEN (toxic = 0)::INT END), 6) AS clean_rate, count(CASE WHEN quality = 1 THEN toxic END) AS clean_n
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def masked_rates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    rates = ev.masked_rates(docs, ["source"], {"good": F.col("quality") == 1, "clean": F.when(F.col("quality") == 1, F.col("toxic") == 0)})
    return rates.select("source", F.round("good_rate", 6).alias("good_rate"), "good_n", F.round("clean_rate", 6).alias("clean_rate"), "clean_n")


@register("upper_median", """SELECT event_type, count(*) AS n, list_sort(list(value))[count(*) // 2 + 1] AS value FROM events GROUP BY event_type""")
def upper_median(spark, d):
    return ev.upper_median(table(spark, d, "events").select("event_type", "value"), ["event_type"], "value")


PAIRS = [(0.63, 0.60), (0.65, 0.60), (0.60, 0.60), (0.63, 0.55), (0.55, 0.50), (0.70, 0.65), (0.50, 0.50)]
_TH = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in PAIRS)


@register("threshold_sweep", f"""WITH t AS (SELECT * FROM (VALUES {_TH}) v(score_th, cross_th)),
r AS (SELECT l_returnflag, l_discount * 10 AS s, CASE WHEN l_linenumber > 5 THEN NULL ELSE l_tax * 12 END AS c FROM lineitem)
SELECT l_returnflag, score_th, cross_th, count(*) AS n, count(*) FILTER (WHERE s < score_th AND c < cross_th) AS below FROM r, t GROUP BY ALL""")
def threshold_sweep(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_discount") * 10).alias("s"),
                                              F.when(F.col("l_linenumber") <= 5, F.col("l_tax") * 12).alias("c"))
    return ev.threshold_sweep(rows, ["l_returnflag"], "s", "c", PAIRS).select("l_returnflag", "score_th", "cross_th", "n", "below")


@register("stratified_split", """WITH h AS (SELECT doc_id, source, ('0x' || left(md5(doc_id::VARCHAR || '#42'), 15))::BIGINT AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) AS rk, count(*) OVER (PARTITION BY source) AS n FROM h),
z AS (SELECT *, round_even(n * 0.7::DOUBLE, 0)::BIGINT AS t0, round_even(n * 0.15::DOUBLE, 0)::BIGINT AS d0 FROM r),
y AS (SELECT *, CASE WHEN n - t0 - d0 < 1 AND d0 > 0 THEN d0 - 1 ELSE d0 END AS d1 FROM z),
x AS (SELECT *, CASE WHEN n - t0 - d1 < 1 THEN greatest(t0 - 1, 0) ELSE t0 END AS t1 FROM y)
SELECT doc_id, source, CASE WHEN rk <= t1 THEN 'train' WHEN rk <= t1 + d1 THEN 'dev' ELSE 'test' END AS split FROM x""")
def stratified_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return ev.stratified_split(docs, "source", "doc_id").select("doc_id", "source", "split")


@register("set_compare", """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O')
SELECT o_custkey, 'common' AS status FROM (SELECT * FROM a INTERSECT SELECT * FROM b) i
UNION ALL SELECT o_custkey, 'fixed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) e UNION ALL SELECT o_custkey, 'new' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) f""")
def set_compare(spark, d):
    orders = table(spark, d, "orders")
    return ev.compare_sets(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), "o_custkey")


@register("gold_drift", f"""WITH {SQL_QUOTED},
g AS (SELECT query_id, item_id FROM quoted UNION SELECT item_id, -1 - item_id FROM benchmark WHERE item_id IN (SELECT query_id FROM quoted)),
p AS (SELECT item_id AS case_id, text AS phrase FROM benchmark UNION ALL SELECT item_id, text || '!' FROM benchmark)
SELECT query_id AS case_id, 'missing_item' AS kind, item_id::VARCHAR AS detail FROM g WHERE item_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT case_id, 'missing_phrase', phrase FROM p JOIN g ON g.query_id = case_id LEFT JOIN documents d ON d.doc_id = g.item_id
GROUP BY case_id, phrase HAVING NOT max(coalesce(contains(d.text, phrase), false))""")
def gold_drift(spark, d):
    quoted = quoted_items(spark, d).select(F.col("query_id").alias("case_id"), "item_id").distinct()
    gone = quoted.select("case_id").distinct().withColumn("item_id", -1 - F.col("case_id"))
    bench = questions(spark, d).select(F.col("query_id").alias("case_id"), F.explode(F.array("text", F.concat("text", F.lit("!")))).alias("phrase"))
    items = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return ev.gold_drift(quoted.unionByName(gone), items, bench)


@register("weighted_score", """WITH s AS (SELECT source, quality * 70.0::DOUBLE + (1 - toxic) * 25.0::DOUBLE AS score, n_chars::DOUBLE AS weight FROM documents JOIN labels USING (doc_id)),
t AS (SELECT source, round(sum(score * weight) / sum(weight), 6) AS total FROM s GROUP BY source)
SELECT *, CASE WHEN total >= 80 THEN 'A' WHEN total >= 60 THEN 'B' WHEN total >= 40 THEN 'C' ELSE 'D' END AS band FROM t""")
def weighted_score(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("weight")).join(
        table(spark, d, "labels"), "doc_id").withColumn("score", F.col("quality") * 70.0 + (1 - F.col("toxic")) * 25.0)
    return ev.weighted_score(rows, ["source"]).select("source", F.round("total", 6).alias("total"), "band")


@register("label_accuracy", """SELECT lang, round(avg((quality = 1 - toxic)::INT), 6) AS accuracy, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def label_accuracy(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").withColumn("guess", 1 - F.col("toxic"))
    return ev.label_accuracy(rows, ["lang"], "guess", "quality").select("lang", F.round("accuracy", 6).alias("accuracy"), "n")


# ------------------------------------------------------------------ ingest and dedupe

_FP = "sha1(regexp_replace(text, '[^一-鿿A-Za-z0-9]', '', 'g'))"


@register("fingerprint", f"SELECT doc_id, {_FP} AS fingerprint FROM documents")
def fingerprint(spark, d):
    return spread_table(spark, d, "documents").select("doc_id", tx.fingerprint("text").alias("fingerprint"))


@register("exact_dedupe", f"SELECT {_FP} AS fingerprint, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedupe(spark, d):
    return dedupe.exact_dedupe(spread_table(spark, d, "documents"), "doc_id", "doc_id")


@register("corpus_fingerprint", """WITH h AS (SELECT md5(doc_id::VARCHAR || ':' || text) AS m FROM documents)
SELECT count(*) AS n, CAST(sum(('0x' || substr(m, 1, 8))::BIGINT) AS VARCHAR) AS a, CAST(sum(('0x' || substr(m, 9, 8))::BIGINT) AS VARCHAR) AS b FROM h""")
def corpus_fingerprint(spark, d):
    return dedupe.corpus_fingerprint(spread_table(spark, d, "documents"), "doc_id")


@register("near_dedupe")
def near_dedupe(spark, d):
    return dedupe.near_dedupe(spread_table(spark, d, "documents"), "doc_id")


_HTML = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>', chr(1), 'g'),
  '(?s)<!--.*?-->', chr(1), 'g'), '(?s)<[^>]*>', chr(1), 'g')"""
for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'' || chr(39) || ''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_e}', '{_c}')"
_HTML_LINES = f"list_filter(list_transform(string_split({_HTML}, chr(1)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> '')"


@register("html_lines", f"SELECT page_id, CAST(len(ls) AS BIGINT) AS n_lines, array_to_string(ls, '|') AS body FROM (SELECT page_id, {_HTML_LINES} AS ls FROM pages) p")
def html_lines(spark, d):
    pages = spread_table(spark, d, "pages").withColumn("ls", corpus.html_lines_sql("html"))
    return pages.select("page_id", F.size("ls").cast("bigint").alias("n_lines"), F.array_join("ls", "|").alias("body"))


@register("html_lines_parser")
def html_lines_parser(spark, d):
    pages = spread_table(spark, d, "pages").withColumn("ls", corpus.html_lines("html"))
    return pages.select("page_id", F.size("ls").cast("bigint").alias("n_lines"), F.array_join("ls", "|").alias("body"))


_LAW_LINE = """CASE WHEN i % 7 = 0 AND NOT (i = 0 AND page_id % 3 = 0) THEN CASE WHEN page_id % 5 = 2 THEN '第一章 ' || s ELSE '第一章' END
  WHEN i % 7 = 1 AND page_id % 4 = 1 THEN '第二章' WHEN i % 7 = 2 THEN '第三条 ' || s WHEN i % 7 = 5 THEN '第四条 ' || s ELSE s END"""


@register("web_law_articles", f"""WITH p AS (SELECT page_id, {_HTML_LINES} AS ls FROM pages),
r AS (SELECT page_id, unnest(ls) AS s, generate_subscripts(ls, 1) - 1 AS i FROM p),
l AS (SELECT page_id, i, {_LAW_LINE} AS s FROM r),
f AS (SELECT *, regexp_matches(s, '^第[一二三]章') AS head, regexp_matches(s, '^第[一二三]章$') AS bare, regexp_matches(s, '^第[三四]条') AS art FROM l),
n AS (SELECT *, i - coalesce(max(CASE WHEN NOT bare THEN i END) OVER (PARTITION BY page_id ORDER BY i), -1) AS pos FROM f),
e AS (SELECT *, coalesce(lag(CASE WHEN bare AND pos % 2 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i), 0) = 1 AS taken FROM n),
m AS (SELECT *, CASE WHEN taken THEN 't' WHEN head THEN 'h' WHEN art THEN 'a' ELSE '.' END AS mark FROM e),
g AS (SELECT *, sum(CASE WHEN mark IN ('h', 'a') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS grp,
  max(CASE WHEN mark = 'h' THEN i END) OVER (PARTITION BY page_id ORDER BY i) AS hi FROM m),
a AS (SELECT page_id, grp, max(hi) AS hi, min(i) AS at, max(CASE WHEN mark = 'a' THEN left(s, 3) END) AS num,
  trim(string_agg(CASE WHEN mark = 'a' THEN substring(s, 5) ELSE s END, '' ORDER BY i)) AS body FROM g GROUP BY page_id, grp HAVING max(CASE WHEN mark = 'a' THEN 1 ELSE 0 END) = 1)
SELECT a.page_id, CAST(row_number() OVER (PARTITION BY a.page_id ORDER BY a.at) - 1 AS BIGINT) AS article_no,
  CASE WHEN a.hi IS NULL THEN '正文' WHEN h.bare THEN h.s || ' ' || coalesce(t.s, '') ELSE h.s END AS chapter, a.num, a.body
FROM a LEFT JOIN m h ON h.page_id = a.page_id AND h.i = a.hi LEFT JOIN m t ON t.page_id = a.page_id AND t.i = a.hi + 1""")
def web_law_articles(spark, d):
    """The lines of pages under law heads: chapters with and without titles, two bare heads in a row, articles before any chapter."""
    pages = spread_table(spark, d, "pages").withColumn("ls", corpus.html_lines_sql("html"))
    page = F.col("page_id")

    def line(s, i):
        chapter = F.when(page % 5 == 2, F.concat(F.lit("第一章 "), s)).otherwise("第一章")
        return (F.when((i % 7 == 0) & ~((i == 0) & (page % 3 == 0)), chapter).when((i % 7 == 1) & (page % 4 == 1), "第二章")
                .when(i % 7 == 2, F.concat(F.lit("第三条 "), s)).when(i % 7 == 5, F.concat(F.lit("第四条 "), s)).otherwise(s))

    laws = looking_ahead.parse_web_law(pages.select("page_id", F.transform("ls", line).alias("lines")), "page_id")
    return laws.select("page_id", F.col("article_no").cast("bigint").alias("article_no"), "chapter", "num", "body")


@register("body_slice", f"""WITH p AS (SELECT page_id, {_HTML_LINES} AS ls FROM pages), q AS (SELECT *, ls[len(ls)] AS last_line, ls[2] AS first_line FROM p),
a AS (SELECT *, list_position(ls, first_line) AS i FROM q), r AS (SELECT page_id, last_line, list_slice(ls, i, len(ls)) AS tail FROM a WHERE i > 0),
e AS (SELECT page_id, tail, list_position(tail, last_line) AS j FROM r)
SELECT page_id, CAST(j - 1 AS BIGINT) AS n_lines, array_to_string(list_slice(tail, 1, j - 1), '|') AS body FROM e WHERE j > 0""")
def body_slice(spark, d):
    pages = spread_table(spark, d, "pages").withColumn("ls", corpus.html_lines_sql("html"))
    out = pages.withColumn("b", corpus.slice_body(F.col("ls"), F.get("ls", F.lit(1)), F.element_at("ls", -1))).where(F.col("b").isNotNull())
    return out.select("page_id", F.size("b").cast("bigint").alias("n_lines"), F.array_join("b", "|").alias("body"))


# Headers of the stand-in dialect: an upper-case start opens a chapter after a line ending in a full stop.
CHAPTER, ARTICLE = "^([A-ZÀ-Þ][a-zà-ÿ]+ the .*)$", "^([A-ZÀ-Þ][a-zà-ÿ]+)\\s+(.*)$"


@register("md_islands", r"""WITH l AS (SELECT doc_id, trim(regexp_replace(u, '\s+', ' ', 'g')) AS line, pos FROM
   (SELECT doc_id, unnest(string_split(text, chr(10))) AS u, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) x),
f AS (SELECT *, regexp_matches(line, '^[A-ZÀ-Þ][a-zà-ÿ]+ the .*$') AS ch, regexp_matches(line, '^[A-ZÀ-Þ][a-zà-ÿ]+\s+.*$') AS ar FROM l
  WHERE line <> '' AND NOT regexp_matches(line, '^(>|---|# |<!--|（[0-9]{4}年|\([0-9]{4}年)')),
g AS (SELECT *, sum(ch::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS cno FROM f),
h AS (SELECT *, sum((ar AND NOT ch)::INT) OVER (PARTITION BY doc_id, cno ORDER BY pos) AS ano FROM g WHERE cno > 0)
SELECT doc_id, CAST(cno - 1 AS BIGINT) AS chapter_no, CAST(ano - 1 AS BIGINT) AS article_no, min(CASE WHEN ar THEN regexp_extract(line, '^([A-ZÀ-Þ][a-zà-ÿ]+)\s+', 1) END) AS num,
  CAST(sum(CASE WHEN ar THEN length(regexp_extract(line, '^[A-ZÀ-Þ][a-zà-ÿ]+\s+(.*)$', 1)) ELSE length(line) END) + count(*) - 1 AS BIGINT) AS n_chars
FROM h WHERE NOT ch AND ano > 0 GROUP BY ALL""")
def md_islands(spark, d):
    parsed = corpus.parse_markdown(spread_table(spark, d, "documents"), "doc_id", chapter=CHAPTER, article=ARTICLE)
    return parsed.select("doc_id", F.col("chapter_no").cast("bigint").alias("chapter_no"), F.col("article_no").cast("bigint").alias("article_no"),
                         "num", F.char_length("body").cast("bigint").alias("n_chars"))


# ------------------------------------------------------------------ logs


@register("audit_daily", """SELECT strftime(ts, '%Y%m%d') AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS clients, round(sum(value), 4) AS total
FROM events GROUP BY ALL""")
def audit_daily(spark, d):
    from clausegraph.sources.audit import day_of

    return table(spark, d, "events").groupBy(day_of("ts").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("clients"), F.round(F.sum("value"), 4).alias("total"))


@register("audit_days", "SELECT DISTINCT strftime(ts, '%Y%m%d') AS day FROM events ORDER BY day DESC LIMIT 31")
def audit_days(spark, d):
    from clausegraph.sources.audit import day_of, list_days

    return list_days(table(spark, d, "events").select(day_of("ts").alias("day")))


@register("audit_export", """SELECT event_id, '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS line
FROM events WHERE strftime(ts, '%Y%m%d') = '20240105'""")
def audit_export(spark, d):
    from clausegraph.sources.audit import day_of, export_lines

    day = table(spark, d, "events").where(day_of("ts") == "20240105").select("event_id", "user_id", "event_type")
    return export_lines(day).select(F.get_json_object("line", "$.event_id").cast("bigint").alias("event_id"), "line")


@register("rate_limit_range", """SELECT event_id, n_trailing, n_trailing <= 2 AS accepted FROM
  (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW) AS n_trailing FROM events) x""")
def rate_limit_range(spark, d):
    counted = limits.trailing_count(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 86400)
    return counted.select("event_id", "n_trailing", (F.col("n_trailing") <= 2).alias("accepted"))


@register("rate_limit_exact", """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, true AS accepted, [ts] AS taken FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_id, n, len(open) < 2, CASE WHEN len(open) < 2 THEN list_append(open, ts) ELSE open END
  FROM (SELECT e.*, list_filter(r.taken, lambda t: e.ts - t < INTERVAL 86400 SECONDS) AS open FROM e JOIN r ON r.user_id = e.user_id AND e.n = r.n + 1) s)
SELECT user_id, event_id, accepted FROM r""")
def rate_limit_exact(spark, d):
    return limits.rate_limit(table(spark, d, "events"), "user_id", "ts", "event_id", limit=2, seconds=86400).select(
        "user_id", "event_id", "accepted")
