"""Dense, fusion and re-ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegraph.functions import text as tx
from clausegraph.operators import dense, fusion, lexical as lx, rerank
from clausegraph.operators.lexicon import contains_join
from clausegraph.registry.base import SQL_SENTENCES, SQL_WORDS, register, table
from clausegraph.registry.lexical import SYNONYMS, _PLAIN, _bm25_sql, document_units, questions, stored_index

SQL_CENTROIDS = """cen AS (SELECT query_id, list(m ORDER BY pos) AS v FROM
   (SELECT label::BIGINT AS query_id, pos, avg(x::DOUBLE) AS m FROM
     (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) e GROUP BY ALL) g GROUP BY query_id)"""
SQL_DOTS = """dots AS (SELECT query_id, vec_id, label,
     CAST(round(list_dot_product(v, list_transform(embedding, lambda x: x::DOUBLE)) * 1e9) AS BIGINT) AS raw FROM cen, embeddings)"""


@register("dense_topk", f"""WITH {SQL_CENTROIDS}, {SQL_DOTS}
SELECT query_id, vec_id, round(raw::DOUBLE / 1e9, 6) AS score, rank FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, vec_id) AS rank FROM dots) r WHERE rank <= 10""")
def dense_topk(spark, d):
    vectors = table(spark, d, "embeddings")
    hits = dense.dense_search(vectors, dense.centroids(vectors), 10)
    return hits.select("query_id", "vec_id", F.round(F.col("raw") / 1e9, 6).alias("score"), F.col("rank").cast("bigint"))


@register("dense_rollup_max", f"""WITH {SQL_CENTROIDS}, {SQL_DOTS},
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, vec_id) AS rk FROM dots) r
  WHERE rk <= 120 AND raw > 0),
best AS (SELECT query_id, label::BIGINT AS item_id, max(raw) AS raw FROM pool GROUP BY ALL)
SELECT query_id, item_id, round(raw / (max(raw) OVER (PARTITION BY query_id))::DOUBLE, 6) AS score, rank FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, item_id) AS rank FROM best) r WHERE rank <= 5""")
def dense_rollup_max(spark, d):
    vectors = table(spark, d, "embeddings")
    hits = dense.dense_search(vectors, dense.centroids(vectors), 120)
    units = vectors.select("vec_id", F.col("label").cast("bigint").alias("item_id"))
    return dense.roll_up(hits, units, 5).select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


def quoted_items(spark, d):
    """Documents that contain a question verbatim: ``(query_id, item_id)``."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    terms = questions(spark, d).select(F.col("query_id").alias("term_id"), F.col("text").alias("term"))
    return contains_join(docs, terms).select(F.col("term_id").alias("query_id"), "item_id")


SQL_QUOTED = ("quoted AS (SELECT b.item_id AS query_id, d.doc_id AS item_id, d.text AS dtext, d.lang "
              "FROM documents d JOIN benchmark b ON contains(d.text, b.text))")


@register("contains_join", f"WITH {SQL_QUOTED} SELECT query_id, item_id FROM quoted")
def contains_join_query(spark, d):
    return quoted_items(spark, d)


def channel_rows(spark, d, pool=20):
    """BM25, first-sentence-length prior as the second text channel, quotations as the sparse one."""
    q = questions(spark, d)
    bm25 = lx.bm25_search(stored_index(spark, d), q, pool).select(
        "query_id", F.lit("bm25").alias("channel"), "item_id", "score", F.lit(None).cast("string").alias("path"))
    # second channel: BM25 over the question's own sentences as sub-queries, best per item
    sub = q.select("query_id", F.posexplode(tx.sentences("text", tx.LATIN_DELIMITERS)).alias("variant", "text"))
    vector = lx.bm25_search(stored_index(spark, d), sub, pool).select(
        "query_id", F.lit("vector").alias("channel"), "item_id", "score", F.lit(None).cast("string").alias("path"))
    graph = quoted_items(spark, d).select(
        "query_id", F.lit("graph").alias("channel"), "item_id", F.lit(1.0).alias("score"), F.lit("quoted").alias("path"))
    return bm25.unionByName(vector).unionByName(graph)


def _channel_sql(pool: int = 20) -> str:
    sub = f"""SELECT item_id AS query_id, generate_subscripts(ss, 1) AS variant, unnest(ss) AS text FROM
     (SELECT item_id, {SQL_SENTENCES.format(text='text')} AS ss FROM benchmark) z"""
    words = SQL_WORDS.format(text="text")
    second = f"""variants2 AS ({sub}),
qt2 AS (SELECT query_id, variant, token, count(*) AS qtf FROM
   (SELECT query_id, variant, unnest({words}) AS token FROM variants2) x GROUP BY ALL),
w2 AS (SELECT query_id, variant, token, qtf, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, avgdl
   FROM qt2 JOIN dfs d USING (token) JOIN sz ON sz.part = d.part),
unit2 AS (SELECT query_id, variant, item_id, unit_no,
     CAST(sum(CAST(round((qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) * 1e9) AS BIGINT)) AS BIGINT) AS raw
   FROM post JOIN w2 ON w2.token = post.token GROUP BY ALL),
best2 AS (SELECT query_id, item_id, max(raw) AS raw FROM unit2 WHERE raw > 0 GROUP BY ALL)"""

    def top(source, name):
        return f"""SELECT query_id, '{name}' AS channel, item_id, raw / (max(raw) OVER (PARTITION BY query_id))::DOUBLE AS score
   FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, item_id) AS rk FROM {source}) r WHERE rk <= {pool}"""

    return f"""{_bm25_sql(_PLAIN)},
{second},
{SQL_QUOTED},
ch AS ({top('best', 'bm25')} UNION ALL {top('best2', 'vector')}
   UNION ALL SELECT query_id, 'graph', item_id, 1.0::DOUBLE FROM quoted)"""


def _rrf_sql(keys: str, source: str, text_weight: str, name: str = "fused") -> str:
    return f"""rk AS (SELECT *, CASE channel WHEN 'bm25' THEN 0.42::DOUBLE WHEN 'vector' THEN 0.33::DOUBLE ELSE 0.25::DOUBLE END AS w FROM
   (SELECT *, row_number() OVER (PARTITION BY {keys}, channel ORDER BY score DESC, item_id) AS rank FROM {source}) r WHERE rank <= 20),
act AS (SELECT {keys}, {text_weight} + CASE WHEN max(channel = 'graph') THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS ws FROM rk GROUP BY ALL),
pp AS (SELECT rk.*, w / ws / (60 + rank) AS part FROM rk JOIN act USING ({keys})),
{name} AS (SELECT {keys}, item_id,
   coalesce(max(CASE WHEN channel = 'bm25' THEN score END), 0.0) AS bm25, coalesce(max(CASE WHEN channel = 'vector' THEN score END), 0.0) AS vector,
   coalesce(max(CASE WHEN channel = 'bm25' THEN part END), 0.0::DOUBLE) AS pb, coalesce(max(CASE WHEN channel = 'vector' THEN part END), 0.0::DOUBLE) AS pv,
   coalesce(max(CASE WHEN channel = 'graph' THEN part END), 0.0::DOUBLE) AS pg, max(channel = 'graph') AS graph_hit FROM pp GROUP BY ALL)"""


_FUSED = _rrf_sql("query_id", "ch", "(0.42::DOUBLE + 0.33::DOUBLE)")


@register("rrf_fusion", f"""WITH {_channel_sql()},
{_FUSED}
SELECT query_id, item_id, graph_hit, round((pb + pv + pg) * 61, 6) AS retrieval_score FROM fused""")
def rrf_fusion(spark, d):
    return fusion.rrf(channel_rows(spark, d)).select(
        "query_id", "item_id", "graph_hit", F.round("retrieval_score", 6).alias("retrieval_score"))


@register("channel_shares", f"""WITH {_channel_sql()},
{_FUSED}
SELECT query_id, round(avg(pb / (pb + pv + pg)), 6) AS bm25_share, round(avg(pv / (pb + pv + pg)), 6) AS vector_share,
  round(avg(pg / (pb + pv + pg)), 6) AS graph_share, CAST(count(*) AS BIGINT) AS n FROM fused GROUP BY query_id""")
def channel_shares(spark, d):
    fused = fusion.rrf(channel_rows(spark, d))
    return fused.groupBy("query_id").agg(
        *[F.round(F.avg(f"{c}_share"), 6).alias(f"{c}_share") for c in fusion.CHANNELS], F.count(F.lit(1)).alias("n"))


_SUBS = f"""SELECT item_id * 1000 + generate_subscripts(ss, 1) - 1 AS query_id, unnest(ss) AS text FROM
  (SELECT item_id, {SQL_SENTENCES.format(text='text')} AS ss FROM benchmark) z"""
_SUB_VARIANTS = f"SELECT query_id, 0 AS variant, text FROM ({_SUBS}) s0" + "".join(
    f" UNION ALL SELECT query_id, {i + 1}, '{syn}' FROM ({_SUBS}) s{i + 1} WHERE contains(text, '{key}')" for i, (key, syn) in enumerate(SYNONYMS))
_SUB_TFIDF = f"""nu AS (SELECT count(*) AS n FROM units),
tdict AS (SELECT token, ln((n + 1)::DOUBLE / (df + 1)) + 1 AS idf FROM (SELECT token, count(*) AS df FROM post GROUP BY token) t, nu),
tq0 AS (SELECT query_id, token, (1 + ln(qtf)) * idf AS qw FROM
   (SELECT query_id, token, count(*) AS qtf FROM
     (SELECT query_id, unnest({SQL_WORDS.format(text='text')}) AS token FROM ({_SUBS}) tb) b GROUP BY ALL) q JOIN tdict USING (token)),
tqn AS (SELECT query_id, sqrt(sum(CAST(round(qw * qw * 1e9) AS BIGINT))::DOUBLE / 1e9) AS qn FROM tq0 GROUP BY query_id),
tqw AS (SELECT query_id, token, qw / qn AS qw FROM tq0 JOIN tqn USING (query_id)),
tw AS (SELECT item_id, unit_no, token, (1 + ln(tf)) * idf AS w FROM post JOIN tdict USING (token)),
tn AS (SELECT item_id, unit_no, sqrt(sum(CAST(round(w * w * 1e9) AS BIGINT))::DOUBLE / 1e9) AS dn FROM tw GROUP BY ALL),
tdots AS (SELECT query_id, item_id, unit_no, sum(CAST(round(qw * (w / dn) * 1e9) AS BIGINT)) AS raw
   FROM tw JOIN tqw USING (token) JOIN tn USING (item_id, unit_no) GROUP BY ALL),
tbest AS (SELECT query_id, item_id, max(raw) AS raw FROM tdots WHERE raw > 0 GROUP BY ALL)"""


def _sub_top(source: str, name: str, score: str) -> str:
    return f"""SELECT query_id // 1000 AS query_id, '{name}' AS channel, item_id, max({score}) AS score FROM
   (SELECT *, max(raw) OVER (PARTITION BY query_id) AS top FROM
     (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, item_id) AS rk FROM {source}) r WHERE rk <= 20) t GROUP BY ALL"""


@register("multi_query_recall", f"""WITH {_bm25_sql(_SUB_VARIANTS)},
{_SUB_TFIDF},
{SQL_QUOTED},
ch AS ({_sub_top('best', 'bm25', 'raw / top::DOUBLE')} UNION ALL {_sub_top('tbest', 'vector', 'raw / 1e9')}
   UNION ALL SELECT query_id, 'graph', item_id, 1.0::DOUBLE FROM quoted),
{_FUSED}
SELECT query_id, item_id, graph_hit, round(bm25, 6) AS bm25, round(vector, 6) AS vector, round((pb + pv + pg) * 61, 6) AS retrieval_score FROM fused""")
def multi_query_recall(spark, d):
    """The sentences of a question as sub-queries: each ranks on its own, an item keeps its best score of each channel."""
    subs = questions(spark, d).select("query_id", F.posexplode(tx.sentences("text", tx.LATIN_DELIMITERS)).alias("sub", "text"))
    none = F.lit(None).cast("string").alias("path")
    bm25 = lx.bm25_sub_search(stored_index(spark, d), subs, 20, SYNONYMS).select("query_id", F.lit("bm25").alias("channel"), "item_id", "score", none)
    alone = subs.select((F.col("query_id") * 1000 + F.col("sub")).alias("query_id"), "text")
    vector = lx.tfidf_search(stored_index(spark, d, "features"), alone, 20).select(
        F.expr("query_id div 1000").alias("query_id"), F.lit("vector").alias("channel"), "item_id", "score", none)
    graph = quoted_items(spark, d).select(
        "query_id", F.lit("graph").alias("channel"), "item_id", F.lit(1.0).alias("score"), F.lit("quoted").alias("path"))
    merged = fusion.merge_variants(bm25.unionByName(vector).unionByName(graph))
    return fusion.rrf(merged).select("query_id", "item_id", "graph_hit", F.round("bm25", 6).alias("bm25"), F.round("vector", 6).alias("vector"),
                                     F.round("retrieval_score", 6).alias("retrieval_score"))


_MODES = ("tagged AS (SELECT 'hybrid' AS mode, * FROM ch UNION ALL SELECT 'bm25_vector', * FROM ch WHERE channel <> 'graph' "
          "UNION ALL SELECT 'bm25', * FROM ch WHERE channel = 'bm25')")
_MODE_FUSED = _rrf_sql("mode, query_id", "tagged", "max(CASE mode WHEN 'bm25' THEN 0.42::DOUBLE ELSE (0.42::DOUBLE + 0.33::DOUBLE) END)")


@register("rrf_ablation_modes", f"""WITH {_channel_sql()},
{_MODES},
{_MODE_FUSED}
SELECT mode, query_id, CAST(count(*) AS BIGINT) AS n, round(max((pb + pv + pg) * 61), 6) AS best, round(avg((pb + pv + pg) * 61), 6) AS mean
FROM fused GROUP BY ALL""")
def rrf_ablation_modes(spark, d):
    fused = fusion.ablation(channel_rows(spark, d))
    return fused.groupBy("mode", "query_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("retrieval_score"), 6).alias("best"),
        F.round(F.avg("retrieval_score"), 6).alias("mean"))


def draft_items(spark, d):
    """Items with a draft status: the stand-in is a low quality label."""
    return table(spark, d, "labels").groupBy(F.col("doc_id").alias("item_id")).agg((F.min("quality") == 0).alias("is_draft"))


_DRAFT = "dr AS (SELECT doc_id AS item_id, min(quality) = 0 AS is_draft FROM labels GROUP BY doc_id)"
_DEMOTED = """dem AS (SELECT f.query_id, f.item_id, coalesce(is_draft, false) AS status_demoted,
   CASE WHEN coalesce(is_draft, false) THEN round((pb + pv + pg) * 61 * 0.62, 4) ELSE (pb + pv + pg) * 61 END AS s
   FROM fused f LEFT JOIN dr USING (item_id))"""


@register("status_demotion", f"""WITH {_channel_sql()},
{_FUSED}, {_DRAFT}, {_DEMOTED}
SELECT query_id, item_id, status_demoted, round(s, 6) AS retrieval_score FROM dem""")
def status_demotion(spark, d):
    fused = fusion.rrf(channel_rows(spark, d)).join(draft_items(spark, d), "item_id", "left")
    return fusion.demote(fused, F.col("is_draft")).select(
        "query_id", "item_id", "status_demoted", F.round("retrieval_score", 6).alias("retrieval_score"))


@register("forced_injection", f"""WITH {_channel_sql()},
noq AS (SELECT * FROM ch WHERE channel <> 'graph'),
{_rrf_sql("query_id", "noq", "(0.42::DOUBLE + 0.33::DOUBLE)")}, {_DRAFT}, {_DEMOTED},
inj AS (SELECT coalesce(d.query_id, q.query_id) AS query_id, coalesce(d.item_id, q.item_id) AS item_id, q.item_id IS NOT NULL AS cite_inject,
   CASE WHEN d.item_id IS NULL THEN 0.98::DOUBLE WHEN q.item_id IS NOT NULL THEN greatest(s, 0.98::DOUBLE) ELSE s END AS s
   FROM dem d FULL JOIN (SELECT DISTINCT query_id, item_id FROM quoted) q ON q.query_id = d.query_id AND q.item_id = d.item_id)
SELECT query_id, item_id, cite_inject, round(s, 6) AS retrieval_score, rank FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM inj) r WHERE rank <= 20""")
def forced_injection(spark, d):
    text = channel_rows(spark, d).where(F.col("channel") != "graph")
    fused = fusion.rrf(text).join(draft_items(spark, d), "item_id", "left")
    forced = fusion.inject(fusion.demote(fused, F.col("is_draft")), quoted_items(spark, d))
    return fusion.final_rank(forced, 20).select(
        "query_id", "item_id", "cite_inject", F.round("retrieval_score", 6).alias("retrieval_score"), "rank")


RULES = rerank.intent_rules(["thst", "ment"], ["inth", "pour"], ["thou", "que"],
                            [("anea", "anea"), ("erin", "erin the"), ("des ", "aux "), ("und", "ung ")])


def candidate_pool(spark, d, pool=20):
    q = questions(spark, d)
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("source").alias("law"), F.col("text").alias("body"),
        tx.derive_title("text").alias("title"))
    top = lx.bm25_search(stored_index(spark, d), q, pool).withColumnRenamed("score", "retrieval_score").drop("rank")
    return top.join(q.withColumnRenamed("text", "query_text"), "query_id").join(docs, "item_id")


def _grams(text: str) -> str:
    return " || ".join(
        f"list_transform(range(1, length({text}) - {n - 2}), lambda i: substring({text}, i, {n}))" for n in (2, 3, 4))


_COMPACT = "regexp_replace(lower({0}), '[^一-鿿a-z0-9]', '', 'g')"
_HEAD = "split_part(regexp_replace(text, '[：；。（]', chr(1)), chr(1), 1)"
_RERANK = f"""{_bm25_sql(_PLAIN)},
cand AS (SELECT query_id, item_id, raw / (max(raw) OVER (PARTITION BY query_id))::DOUBLE AS rs FROM
   (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, item_id) AS rk FROM best) r WHERE rk <= 20),
docs AS (SELECT doc_id AS item_id, source AS law, text AS body,
   CASE WHEN length(h) > 22 THEN left(h, 22) || '…' ELSE h END AS title FROM (SELECT *, {_HEAD} AS h FROM documents) x),
base AS (SELECT c.*, b.text AS q, d.law, d.title, d.title || d.body AS full_text, {_COMPACT.format('b.text')} AS qc,
   {_COMPACT.format('d.title || d.body')} AS fc, {_COMPACT.format('d.title')} AS tc
   FROM cand c JOIN benchmark b ON b.item_id = c.query_id JOIN docs d ON d.item_id = c.item_id),
sets AS (SELECT *, list_distinct({_grams('qc')}) AS qs FROM base),
cov AS (SELECT *, len(list_filter(qs, lambda g: contains(fc, g)))::DOUBLE / greatest(len(qs), 1) AS coverage,
   len(list_filter(qs, lambda g: contains(tc, g)))::DOUBLE / greatest(len(qs), 1) AS title_coverage FROM sets)"""


def _rules_sql() -> str:
    def any_of(col, words):
        return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"

    terms = []
    for r in RULES:
        tests = [f"contains(q, '{w}')" for w in r.get("q_all", ())]
        if r.get("q_any"):
            tests.append(any_of("q", r["q_any"]))
        if r.get("q_none"):
            tests.append("NOT " + any_of("q", r["q_none"]))
        if r.get("text_any"):
            tests.append(any_of("full_text", r["text_any"]))
        terms.append(f"CASE WHEN {' AND '.join(tests)} THEN {r['delta']}::DOUBLE ELSE 0.0::DOUBLE END")
    return " + ".join(terms)


@register("coverage_rerank", f"""WITH {_RERANK}
SELECT query_id, item_id, round(coverage, 6) AS coverage, round(title_coverage, 6) AS title_coverage FROM cov""")
def coverage_rerank(spark, d):
    return rerank.with_coverage(candidate_pool(spark, d)).select(
        "query_id", "item_id", F.round("coverage", 6).alias("coverage"), F.round("title_coverage", 6).alias("title_coverage"))


_SCORE = f"""(0.62 * rs + 0.18 * coverage + 0.20 * title_coverage + ({_rules_sql()})
   + CASE WHEN length(full_text) > 250 THEN -0.05::DOUBLE ELSE 0.0::DOUBLE END)"""


@register("rule_delta_rerank", f"""WITH {_RERANK}
SELECT query_id, item_id, round({_SCORE}, 6) AS rerank_score FROM cov""")
def rule_delta_rerank(spark, d):
    return rerank.rerank(candidate_pool(spark, d), RULES).select(
        "query_id", "item_id", F.round("rerank_score", 6).alias("rerank_score"))


@register("blend_topn", f"""WITH {_RERANK},
rr AS (SELECT query_id, item_id, coverage, round({_SCORE}, 6) AS s FROM cov),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rk FROM rr),
b AS (SELECT query_id, item_id, CASE WHEN rk <= 6 THEN 0.5 * (1 / (1 + exp(-(4 * coverage - 2)))) + 0.5 * s ELSE s END AS s FROM h)
SELECT query_id, item_id, round(s, 6) AS rerank_score FROM b""")
def blend_topn(spark, d):
    ruled = rerank.rerank(candidate_pool(spark, d), RULES).withColumn("rerank_score", F.round("rerank_score", 6))

    def scorer(rows):  # stand-in model: logistic of the coverage
        return rows.withColumn("cross_encoder", rerank.sigmoid(4 * F.col("coverage") - 2))

    return rerank.blend_top(ruled, scorer).select("query_id", "item_id", F.round("rerank_score", 6).alias("rerank_score"))


__all__ = ["candidate_pool", "channel_rows", "document_units"]
