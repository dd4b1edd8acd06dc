"""Sentence, token and lexical retrieval queries."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from clausegraph.functions import text as tx
from clausegraph.operators import lexical as lx
from clausegraph.operators.scale import fan_out_partitions
from clausegraph.registry.base import SQL_WORDS, register, spread_table, sql_units, table
from clausegraph.session import ensure_checkpoint_dir
from clausegraph.sources.index import StoredIndex
from clausegraph.sources.vectors import VectorStore

LATIN = tx.LATIN_DELIMITERS
UNITS = sql_units()
WORDS = SQL_WORDS.format(text="unit")
SYNONYMS = [("the ", "thereof tion"), ("with", "avec mit con"), ("heat", "theat eat"), ("une", "des les")]
GATES = [("fr", "les "), ("fr", " une "), ("de", " der "), ("de", " und "), ("es", " los "), ("es", " que ")]


def document_units(spark, d, part=None):
    docs = spread_table(spark, d, "documents")
    return lx.explode_units(docs, "doc_id", "text", part, LATIN)


def document_tokens(spark, d, part=None):
    return lx.tokenized(document_units(spark, d, part))


def core_part():
    return F.when(F.col("lang") == "en", "core").otherwise("special")


def _state_of(spark, path: str) -> str:
    """Names, sizes and times of the files of a table: an index is of one state."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files = system.listStatus(place)
    marks = sorted(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in files)
    return hashlib.sha256("|".join([path, *marks]).encode()).hexdigest()[:24]


def stored_index(spark, d, kind: str = "words") -> StoredIndex:
    """The index of ``documents``, in the shared checkpoint folder; built by the first query of a session that asks it."""
    ensure_checkpoint_dir(spark)
    home = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    index = StoredIndex(spark, f"{home}/index-{kind}-{_state_of(spark, f'{d}/documents.parquet')}")
    if index.version:
        return index
    tokenizer = tx.words if kind == "words" else tx.mixed_features
    docs = table(spark, d, "documents")
    docs = docs.select("doc_id", "text", "lang").repartition(fan_out_partitions(docs), "doc_id")  # texts are slimmer than their tokens
    return index.append(lx.tokenized(lx.explode_units(docs, "doc_id", "text", core_part(), LATIN), tokenizer))


def questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@register("sentence_split", f"""WITH {UNITS}
SELECT item_id, CAST(count(*) AS BIGINT) AS n_units, CAST(sum(length(unit)) AS BIGINT) AS n_chars,
       CAST(max(unit_no) AS BIGINT) AS last_no
FROM units GROUP BY item_id""")
def sentence_split(spark, d):
    return document_units(spark, d).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_units"), F.sum(F.char_length("unit")).alias("n_chars"),
        F.max("unit_no").cast("bigint").alias("last_no"))


@register("token_df", f"""WITH {UNITS},
tok AS (SELECT DISTINCT item_id, unit_no, unnest({WORDS}) AS token FROM units)
SELECT token, CAST(count(*) AS BIGINT) AS df FROM tok GROUP BY token""")
def token_df(spark, d):
    exploded = document_tokens(spark, d).select("item_id", "unit_no", F.explode(F.array_distinct("tokens")).alias("token"))
    return exploded.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@register("doc_lengths", f"""WITH {UNITS},
t AS (SELECT item_id, len({WORDS}) AS dl FROM units)
SELECT item_id, CAST(sum(dl) AS BIGINT) AS n_tokens, CAST(max(dl) AS BIGINT) AS longest, round(avg(dl), 6) AS avg_dl
FROM t GROUP BY item_id""")
def doc_lengths(spark, d):
    return document_tokens(spark, d).groupBy("item_id").agg(
        F.sum("dl").alias("n_tokens"), F.max("dl").cast("bigint").alias("longest"),
        F.round(F.avg("dl"), 6).alias("avg_dl"))


@register("char_bigrams", f"""WITH {UNITS},
g AS (SELECT unnest(list_transform(range(1, length(unit)), lambda i: substring(unit, i, 2))) AS gram FROM units)
SELECT gram, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY gram""")
def char_bigrams(spark, d):
    grams = document_units(spark, d).select(F.explode(tx.char_bigrams("unit")).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def _bm25_sql(variants: str, part: str = "'all'", units_extra: str = "") -> str:
    """Common table expressions up to ``best(query_id, part, item_id, raw)``."""
    return f"""{sql_units(extra=units_extra)},
tok AS (SELECT {part} AS part, item_id, unit_no, {WORDS} AS tokens FROM units),
post AS (SELECT part, item_id, unit_no, dl, token, count(*) AS tf FROM
   (SELECT part, item_id, unit_no, len(tokens) AS dl, unnest(tokens) AS token FROM tok) x GROUP BY ALL),
sz AS (SELECT part, count(*) AS n, greatest(1.0, sum(len(tokens))::DOUBLE / count(*)) AS avgdl FROM tok GROUP BY part),
dfs AS (SELECT part, token, count(*) AS df FROM post GROUP BY part, token),
variants AS ({variants}),
qt AS (SELECT query_id, variant, token, count(*) AS qtf FROM
   (SELECT query_id, variant, unnest({SQL_WORDS.format(text='text')}) AS token FROM variants) x GROUP BY ALL),
w AS (SELECT query_id, variant, d.part, token, qtf, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, avgdl
   FROM qt JOIN dfs d USING (token) JOIN sz ON sz.part = d.part),
per_unit AS (SELECT query_id, variant, post.part, item_id, unit_no,
     CAST(sum(CAST(round((qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) * 1e9) AS BIGINT)) AS BIGINT) AS raw
   FROM post JOIN w ON w.token = post.token AND w.part = post.part GROUP BY ALL),
best AS (SELECT query_id, part, item_id, max(raw) AS raw FROM per_unit WHERE raw > 0 GROUP BY ALL)"""


def _top_sql(source: str, k: int, out: str = "SELECT query_id, item_id, round(score, 6) AS score, rank FROM ranked") -> str:
    return f"""ranked AS (SELECT query_id, item_id, rank, raw / (max(raw) OVER (PARTITION BY query_id))::DOUBLE AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, item_id) AS rank FROM {source}) r
  WHERE rank <= {k})
{out}"""


_PLAIN = "SELECT item_id AS query_id, 0 AS variant, text FROM benchmark"
_EXPANDED = _PLAIN + "".join(
    f" UNION ALL SELECT item_id, {i + 1}, '{syn}' FROM benchmark WHERE contains(text, '{key}')"
    for i, (key, syn) in enumerate(SYNONYMS))


@register("bm25_topk", f"WITH {_bm25_sql(_PLAIN)},\n{_top_sql('best', 5)}")
def bm25_topk(spark, d):
    return lx.bm25_search(stored_index(spark, d), questions(spark, d), 5).select(
        "query_id", "item_id", F.round("score", 6).alias("score"), "rank")


@register("bm25_max_expansion", f"""WITH {_bm25_sql(_EXPANDED)},
{_top_sql('best', 5)}""")
def bm25_max_expansion(spark, d):
    variants = lx.expand_queries(questions(spark, d), SYNONYMS)
    return lx.bm25_search(stored_index(spark, d), variants, 5).select(
        "query_id", "item_id", F.round("score", 6).alias("score"), "rank")


@register("synonym_expand", f"""SELECT query_id, CAST(count(*) AS BIGINT) AS n_variants,
  string_agg(text, '|' ORDER BY variant) AS variants FROM ({_EXPANDED}) v GROUP BY query_id""")
def synonym_expand(spark, d):
    q = questions(spark, d)
    text = F.col("text")
    extra = F.filter(F.array(text, *[F.when(F.contains(text, F.lit(k)), F.lit(s)) for k, s in SYNONYMS]),
                     lambda v: v.isNotNull())
    return q.select("query_id", F.size(extra).cast("bigint").alias("n_variants"),
                    F.array_join(extra, "|").alias("variants"))


def _gate_sql() -> str:
    return " UNION ".join(
        f"SELECT item_id AS query_id, '{law}' AS law FROM benchmark WHERE contains(text, '{word}')" for law, word in GATES)


_PART = "CASE WHEN lang = 'en' THEN 'core' ELSE 'special' END"


@register("bm25_partitioned", f"""WITH {_bm25_sql(_PLAIN, _PART, ', lang')},
r1 AS (SELECT *, raw / (max(raw) OVER (PARTITION BY query_id, part))::DOUBLE AS s FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id, part ORDER BY raw DESC, item_id) AS rk FROM best) x WHERE rk <= 20),
opened AS ({_gate_sql()}),
special AS (SELECT r1.query_id, item_id, s * 0.72 AS s FROM r1 JOIN documents d ON d.doc_id = r1.item_id
  JOIN opened o ON o.query_id = r1.query_id AND o.law = d.lang WHERE part <> 'core'),
merged AS (SELECT query_id, item_id, max(s) AS raw FROM
  (SELECT query_id, item_id, s FROM r1 WHERE part = 'core' UNION ALL SELECT * FROM special) m GROUP BY ALL),
{_top_sql('merged', 20)}""")
def bm25_partitioned(spark, d):
    laws = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("law"))
    out = lx.bm25_two_index_search(stored_index(spark, d), questions(spark, d), GATES, 20, laws=laws)
    return out.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


@register("tfidf_topk", f"""WITH {UNITS},
post AS (SELECT item_id, unit_no, token, count(*) AS tf FROM
   (SELECT item_id, unit_no, unnest({WORDS}) AS token FROM units) x GROUP BY ALL),
n AS (SELECT count(*) AS n FROM units),
dict AS (SELECT token, ln((n + 1)::DOUBLE / (df + 1)) + 1 AS idf FROM (SELECT token, count(*) AS df FROM post GROUP BY token) t, n),
qw0 AS (SELECT query_id, token, (1 + ln(qtf)) * idf AS qw FROM
   (SELECT query_id, token, count(*) AS qtf FROM
     (SELECT item_id AS query_id, unnest({SQL_WORDS.format(text='text')}) AS token FROM benchmark) b GROUP BY ALL) q JOIN dict USING (token)),
qn AS (SELECT query_id, sqrt(sum(CAST(round(qw * qw * 1e9) AS BIGINT))::DOUBLE / 1e9) AS qn FROM qw0 GROUP BY query_id),
qw AS (SELECT query_id, token, qw / qn AS qw FROM qw0 JOIN qn USING (query_id)),
dw AS (SELECT item_id, unit_no, token, (1 + ln(tf)) * idf AS w FROM post JOIN dict USING (token)),
dn AS (SELECT item_id, unit_no, sqrt(sum(CAST(round(w * w * 1e9) AS BIGINT))::DOUBLE / 1e9) AS dn FROM dw GROUP BY ALL),
dots AS (SELECT query_id, item_id, unit_no, sum(CAST(round(qw * (w / dn) * 1e9) AS BIGINT)) AS raw
   FROM dw JOIN qw USING (token) JOIN dn USING (item_id, unit_no) GROUP BY ALL),
best AS (SELECT query_id, item_id, max(raw) AS raw FROM dots WHERE raw > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, item_id) AS rank FROM best)
SELECT query_id, item_id, round(raw::DOUBLE / 1e9, 6) AS score, rank FROM r WHERE rank <= 5""")
def tfidf_topk(spark, d):
    return lx.tfidf_search(stored_index(spark, d, "features"), questions(spark, d), 5).select(
        "query_id", "item_id", F.round("score", 6).alias("score"), "rank")


@register("index_segments", f"WITH {_bm25_sql(_PLAIN)},\n{_top_sql('best', 5)}")
def index_segments(spark, d):
    """``bm25_topk`` from an index that was appended to, had items replaced and removed, and was compacted in part."""
    ensure_checkpoint_dir(spark)
    docs = spread_table(spark, d, "documents").select("doc_id", "text", "lang")

    def units(rows):
        return lx.tokenized(lx.explode_units(rows, "doc_id", "text", core_part(), LATIN))

    index = StoredIndex(spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/segments-{uuid.uuid4().hex}")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    old = docs.where(half == 0).withColumn("text", F.concat(F.lit("earlier wording. "), "text"))
    index = index.append(units(old)).append(units(docs.where(half == 1)))
    index = index.remove(docs.where(half == 1).select(F.col("doc_id").alias("item_id"))).compact()
    index = index.append(units(docs.where(half == 0))).append(units(docs.where(half == 1)))
    return lx.bm25_search(index, questions(spark, d), 5).select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


_LETTERS = ("a", "e", "n", "s")


@register("vector_store", f"""WITH t AS (SELECT text, min(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END) AS generation FROM documents GROUP BY text),
  calls AS (SELECT generation, count(*) AS n_calls FROM t GROUP BY generation)
SELECT doc_id, CAST(t.generation AS BIGINT) AS generation, CAST(n_calls AS BIGINT) AS n_calls,
  {', '.join(f"CAST(length(documents.text) - length(replace(documents.text, '{c}', '')) AS BIGINT) AS n_{c}" for c in _LETTERS)}
FROM documents JOIN t USING (text) JOIN calls USING (generation)""")
def vector_store(spark, d):
    """Vectors of all documents from a store that was filled with a third of them first; ``n_calls`` texts met the model in that generation."""
    ensure_checkpoint_dir(spark)
    docs = spread_table(spark, d, "documents").select("doc_id", "text")
    counts = [(F.char_length("text") - F.char_length(F.replace("text", F.lit(c)))).cast("bigint") for c in _LETTERS]
    store = VectorStore(spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/vectors-{uuid.uuid4().hex}")
    for rows in (docs.where("doc_id % 3 = 0"), docs, docs):
        store = store.upsert(rows, lambda texts: texts.withColumn("vector", F.array(*counts)))
    calls = store.rows().groupBy("generation").agg(F.count(F.lit(1)).alias("n_calls"))
    return store.lookup(docs).join(F.broadcast(calls), "generation").select(
        "doc_id", F.col("generation").cast("bigint").alias("generation"), "n_calls", *[F.col("vector")[i].alias(f"n_{c}") for i, c in enumerate(_LETTERS)])
