"""Graph queries: one graph built from documents, one from the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegraph.functions import text as tx
from clausegraph.operators import graph as gx
from clausegraph.packs.demo import GRAPH as PACK
from clausegraph.registry.base import register, spread_table, sql_units, table
from clausegraph.registry.lexical import questions
from clausegraph.session import cut_table

# ------------------------------------------------------------------ text graph


def text_units(spark, d):
    docs = spread_table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("item_id"), F.col("source").alias("law"),
                       F.posexplode(tx.sentences("text", tx.LATIN_DELIMITERS)).alias("unit_no", "unit"))


def text_items(spark, d):
    return spread_table(spark, d, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("source").alias("law"), "text")


def text_graph(spark, d):
    return gx.build_graph(text_units(spark, d), text_items(spark, d), PACK)


def has(col: str, words) -> str:
    words = [w for w in words if w]
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")" if words else "false"


def chain(col: str, mapping) -> str:
    return "CASE " + " ".join(f"WHEN {has(col, words)} THEN '{name}'" for name, words in mapping) + " END"


def names(col: str, mapping) -> str:
    cases = ", ".join(f"CASE WHEN {has(col, words)} THEN '{name}' END" for name, words in mapping)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def _behavior_case(value) -> str:
    out = "CASE "
    for b in PACK.behaviors:
        out += f"WHEN ({has('unit', b.aliases)} OR ({has('unit', b.verbs)} AND {has('unit', b.objects)})) THEN '{value(b)}' "
    return out + "END"


_SUBJECTS = sorted(PACK.subjects, key=lambda s: -len(s[0]))
SQL_FACTS = f"""{sql_units(extra=', source AS law')},
facts0 AS (SELECT item_id, law, unit_no, unit, {_behavior_case(lambda b: b.name)} AS behavior, {_behavior_case(lambda b: b.kind)} AS kind,
   coalesce({chain('unit', [(n, [n, *a]) for n, a in _SUBJECTS])}, CASE WHEN {has('unit', PACK.unit_phrases)} THEN '{PACK.unit_subject}'
     WHEN {has('unit', PACK.person_phrases)} AND {has('unit', PACK.modal_words)} THEN '{PACK.person_subject}' END) AS subject,
   {names('unit', PACK.objects)} AS objects, {names('unit', PACK.penalties)} AS penalties FROM units),
facts AS (SELECT *, kind || ':' || behavior AS b, CASE WHEN {has('unit', PACK.prohibit_words)} THEN 'prohibit'
   WHEN kind = 'violation' THEN CASE WHEN {has('unit', PACK.breach_words)} THEN 'prohibit' ELSE 'responsibility' END
   WHEN {has('unit', PACK.duty_words)} THEN 'duty' WHEN kind IN ('duty', 'government') THEN 'duty' ELSE 'responsibility' END AS relation
   FROM facts0 WHERE behavior IS NOT NULL),
itempen AS (SELECT doc_id AS item_id, source AS law, {names('text', PACK.penalties)} AS ps FROM documents),
e1 AS (SELECT 'subject:' || subject AS source, b AS target, relation, item_id, law, 1 AS pass, unit_no AS pos, 0 AS ord FROM facts WHERE subject IS NOT NULL
  UNION ALL SELECT b, 'object:' || unnest(objects), 'involve', item_id, law, 1, unit_no, generate_subscripts(objects, 1) FROM facts
  UNION ALL SELECT b, 'penalty:' || unnest(penalties), 'punish', item_id, law, 1, unit_no, 1000 + generate_subscripts(penalties, 1) FROM facts),
e2 AS (SELECT f.b AS source, 'penalty:' || p.p AS target, 'punish' AS relation, p.item_id, p.law, 2 AS pass, 0 AS pos, p.ord FROM
   (SELECT DISTINCT item_id, b FROM facts) f JOIN
   (SELECT item_id, law, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS ord FROM itempen) p USING (item_id)),
base AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2)"""


def _theme_rows() -> str:
    rows = []
    kinds = {b.name: b.kind for b in PACK.behaviors}
    for name, _, behaviors in PACK.themes:
        for i, b in enumerate(behaviors):
            if b in kinds:
                rows.append(f"('theme:{name}', '{kinds[b]}:{b}', {i})")
    return ", ".join(rows)


SQL_EDGES = f"""{SQL_FACTS},
ends AS (SELECT source AS node, pass, item_id, pos, ord, law FROM base UNION ALL SELECT target, pass, item_id, pos, ord, law FROM base),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY pass, item_id, pos, ord) AS rk FROM ends) x WHERE rk = 1),
themed AS (SELECT t.source, t.target, t.ord, f.item_id, f.law FROM (VALUES {_theme_rows()}) t(source, target, ord) JOIN firsts f ON f.node = t.target),
pentheme AS (SELECT 'theme:{PACK.penalty_theme}' AS source, node AS target, 0 AS ord, item_id, law FROM firsts
   WHERE node = (SELECT min(node) FROM firsts WHERE node LIKE 'penalty:%') AND NOT EXISTS (SELECT 1 FROM themed WHERE source = 'theme:{PACK.penalty_theme}')),
e3 AS (SELECT source, target, 'involve' AS relation, item_id, law, 3 AS pass, 0 AS pos, ord FROM (SELECT * FROM themed UNION ALL SELECT * FROM pentheme) z),
alle AS (SELECT * FROM base UNION ALL SELECT * FROM e3),
edges AS (SELECT source, target, relation, item_id, law, pass, pos, ord FROM
   (SELECT *, row_number() OVER (PARTITION BY source, target, relation, item_id ORDER BY pass, pos, ord) AS rk FROM alle) x WHERE rk = 1),
degree AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) x GROUP BY id)"""


@register("sentence_facts", f"""WITH {SQL_FACTS}
SELECT item_id, CAST(unit_no AS BIGINT) AS unit_no, behavior, kind, coalesce(subject, '') AS subject, relation,
   array_to_string(objects, ',') AS objects, array_to_string(penalties, ',') AS penalties FROM facts""")
def sentence_facts(spark, d):
    return gx.sentence_facts(text_units(spark, d), PACK).select(
        "item_id", F.col("unit_no").cast("bigint").alias("unit_no"), "behavior", "kind",
        F.coalesce("subject", F.lit("")).alias("subject"), "relation",
        F.array_join("objects", ",").alias("objects"), F.array_join("penalties", ",").alias("penalties"))


@register("graph_nodes_edges", f"""WITH {SQL_EDGES}
SELECT source, target, relation, item_id, law, CAST(pass AS BIGINT) AS pass, CAST(pos AS BIGINT) AS pos FROM edges""")
def graph_nodes_edges(spark, d):
    _, edges = text_graph(spark, d)
    return edges.select("source", "target", "relation", "item_id", "law",
                        F.col("pass").cast("bigint").alias("pass"), F.col("pos").cast("bigint").alias("pos"))


@register("degree_prune", f"WITH {SQL_EDGES} SELECT id, degree FROM degree")
def degree_prune(spark, d):
    nodes, _ = text_graph(spark, d)
    return nodes.select("id", "degree")


@register("penalty_propagation", f"""WITH {SQL_FACTS}
SELECT source, target, relation, item_id, law FROM e2""")
def penalty_propagation(spark, d):
    facts = gx.sentence_facts(text_units(spark, d), PACK)
    return gx.propagated_edges(facts, gx.item_penalties(text_items(spark, d), PACK), PACK).select(
        "source", "target", "relation", "item_id", "law")


@register("theme_link", f"WITH {SQL_EDGES} SELECT source, target, item_id, law FROM e3")
def theme_link(spark, d):
    facts = cut_table(gx.sentence_facts(text_units(spark, d), PACK).drop("unit"))  # read twice, the texts once
    base = gx.sentence_edges(facts, PACK).unionByName(
        gx.propagated_edges(facts, gx.item_penalties(text_items(spark, d), PACK), PACK))
    return gx.theme_edges(base, gx.pack_nodes(spark, PACK), PACK).select("source", "target", "item_id", "law")


def _nodes_sql() -> str:
    rows = []
    for kind, entries in (("subject", PACK.subjects), ("object", PACK.objects), ("penalty", PACK.penalties)):
        rows += [(f"{kind}:{n}", n, kind, a, []) for n, a in entries]
    rows += [(f"{b.kind}:{b.name}", b.name, b.kind, b.aliases, []) for b in PACK.behaviors]
    rows += [(f"theme:{n}", n, "theme", a, b) for n, a, b in PACK.themes]

    def arr(xs):
        return "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"

    return ", ".join(f"('{i}', '{n}', '{t}', {arr(a)}, {arr(b)})" for i, n, t, a, b in rows)


_BEH = "('violation', 'duty', 'government')"
SQL_SEARCH = f"""{SQL_EDGES},
nodes AS (SELECT n.* FROM (VALUES {_nodes_sql()}) n(id, name, type, aliases, behaviors) JOIN degree USING (id)),
grams AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(trim(alias))), lambda i: substring(trim(alias), i, 2))) AS gram FROM
   (SELECT id, unnest(aliases) AS alias FROM nodes WHERE type IN {_BEH}) a),
fuzzy AS (SELECT b.item_id AS query_id, g.id FROM benchmark b JOIN grams g ON contains(b.text, g.gram) GROUP BY ALL HAVING count(*) >= 2),
seed0 AS (SELECT b.item_id AS query_id, n.id AS node, n.name, n.type, n.behaviors, {has('b.text', PACK.punish_words)} AS pun,
   CASE WHEN contains(b.text, n.name) THEN 1.0::DOUBLE WHEN len(list_filter(n.aliases, lambda a: a <> '' AND contains(b.text, a))) > 0 THEN 0.95::DOUBLE
     WHEN f.id IS NOT NULL THEN 0.7::DOUBLE END AS s
   FROM benchmark b CROSS JOIN nodes n LEFT JOIN fuzzy f ON f.query_id = b.item_id AND f.id = n.id),
seeds AS (SELECT *, max(type IN {_BEH}) OVER (PARTITION BY query_id) AS hb FROM seed0 WHERE s IS NOT NULL),
ni AS (SELECT DISTINCT node, item_id FROM (SELECT source AS node, item_id FROM edges UNION ALL SELECT target, item_id FROM edges) x),
contrib AS (
  SELECT query_id, item_id, CASE WHEN type = 'subject' THEN s * 0.45::DOUBLE WHEN type = 'theme' THEN s * 0.9::DOUBLE
      WHEN type IN {_BEH} THEN s * CASE WHEN pun THEN 1.6::DOUBLE ELSE 1.0::DOUBLE END ELSE s END AS w, 1 AS p, name AS label
    FROM seeds JOIN ni USING (node) WHERE type <> 'subject' OR NOT hb
  UNION ALL SELECT t.query_id, ni.item_id, t.s * 0.85::DOUBLE, 2, t.name || ' → ' || n.name FROM
    (SELECT query_id, name, s, unnest(behaviors) AS bname FROM seeds WHERE type = 'theme') t
    JOIN nodes n ON n.name = t.bname AND n.type IN {_BEH} JOIN ni ON ni.node = n.id
  UNION ALL SELECT query_id, e.item_id, s * 0.8::DOUBLE * CASE WHEN pun THEN 1.6::DOUBLE ELSE 1.0::DOUBLE END, 3, name || ' → ' || split_part(e.target, ':', 2)
    FROM seeds JOIN edges e ON (e.source = node OR e.target = node) AND e.relation = 'punish' WHERE type IN {_BEH}),
gs AS (SELECT query_id, item_id, CAST(sum(CAST(round(w * 1e9) AS BIGINT)) AS BIGINT) AS raw, max(p * 1000) AS pp FROM contrib GROUP BY ALL),
gp AS (SELECT query_id, item_id, max(label) AS path FROM contrib JOIN gs USING (query_id, item_id) WHERE p * 1000 = pp GROUP BY ALL)"""


@register("graph_link", f"WITH {SQL_SEARCH} SELECT query_id, node, type, s AS strength FROM seeds")
def graph_link(spark, d):
    nodes, _ = text_graph(spark, d)
    return gx.link_entities(questions(spark, d), nodes, PACK.behavior_kinds).select("query_id", "node", "type", "strength")


@register("graph_search", f"""WITH {SQL_SEARCH}
SELECT query_id, item_id, path, round(raw / (max(raw) OVER (PARTITION BY query_id))::DOUBLE, 6) AS score, rank FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, item_id) AS rank FROM gs JOIN gp USING (query_id, item_id)) r WHERE rank <= 5""")
def graph_search(spark, d):
    nodes, edges = text_graph(spark, d)
    return gx.graph_search(questions(spark, d), nodes, edges, PACK, 5).select(
        "query_id", "item_id", "path", F.round("score", 6).alias("score"), "rank")


@register("graph_health", f"""WITH {SQL_EDGES},
pi AS (SELECT law, item_id, count(*) AS n FROM edges GROUP BY ALL),
bl AS (SELECT law, sum(n) AS edges, count(*) AS linked_items FROM pi GROUP BY law),
lost AS (SELECT law, count(*) AS orphan_items FROM (SELECT DISTINCT item_id, law FROM units) u
   WHERE item_id NOT IN (SELECT item_id FROM pi) GROUP BY law)
SELECT law, CAST(coalesce(edges, 0) AS BIGINT) AS edges, CAST(coalesce(linked_items, 0) AS BIGINT) AS linked_items,
  CAST(coalesce(orphan_items, 0) AS BIGINT) AS orphan_items FROM bl FULL JOIN lost USING (law)""")
def graph_health(spark, d):
    _, edges = text_graph(spark, d)
    return gx.graph_health(text_units(spark, d).select("item_id", "law"), edges)


@register("unknown_terms", """WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]{6,12}')) AS term FROM documents),
c AS (SELECT term, count(*) AS n, min(doc_id) AS first_item FROM runs WHERE NOT contains(term, 'thth') GROUP BY term)
SELECT term, n, first_item FROM c WHERE term NOT IN (SELECT unnest(regexp_extract_all(text, '[a-z]{6,12}')) FROM benchmark)
ORDER BY n DESC, term LIMIT 40""")
def unknown_terms(spark, d):
    from clausegraph.operators.lexicon import unknown_terms as mine

    docs = spread_table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    known = questions(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]{6,12})"), F.lit(1))).alias("term"))
    return mine(docs, known, "([a-z]{6,12})", skip=["thth"])


# ------------------------------------------------------------------ order graph

ORDER = ["item_id", "ord"]
RELATIONS = {"R": "punish", "A": "prohibit", "N": "duty"}


def order_edges(spark, d):
    """customer→part and part→supplier edges; the order is the item, its priority the law."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    rows = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    customer = F.concat(F.lit("customer:"), F.col("o_custkey"))
    part = F.concat(F.lit("part:"), F.col("l_partkey"))
    supplier = F.concat(F.lit("supplier:"), F.col("l_suppkey"))
    relation = F.coalesce(*[F.when(F.col("l_returnflag") == k, F.lit(v)) for k, v in RELATIONS.items()])

    def edge(s, t, r, ord_):
        return F.struct(s.alias("source"), t.alias("target"), r.alias("relation"), ord_.alias("ord"))

    pair = F.array(edge(customer, part, relation, F.col("l_linenumber") * 2),
                   edge(part, supplier, F.lit("involve"), F.col("l_linenumber") * 2 + 1))
    return rows.select(F.col("l_orderkey").alias("item_id"), F.col("o_orderpriority").alias("law"),
                       F.explode(pair).alias("e")).select("e.source", "e.target", "e.relation", "item_id", "law", "e.ord")


def order_nodes(spark, d):
    def nodes(name, key, label, alias, prefix):
        return table(spark, d, name).select(
            F.concat(F.lit(f"{prefix}:"), F.col(key)).alias("id"), F.col(label).alias("name"), F.lit(prefix).alias("type"),
            F.array(F.col(alias).cast("string")).alias("aliases"))

    return (nodes("customer", "c_custkey", "c_name", "c_mktsegment", "customer")
            .unionByName(nodes("part", "p_partkey", "p_name", "p_brand", "part"))
            .unionByName(nodes("supplier", "s_suppkey", "s_name", "s_nationkey", "supplier")))


SQL_ORDER_EDGES = """li AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
edges AS (SELECT 'customer:' || o_custkey AS source, 'part:' || l_partkey AS target,
     CASE l_returnflag WHEN 'R' THEN 'punish' WHEN 'A' THEN 'prohibit' ELSE 'duty' END AS relation, l_orderkey AS item_id, o_orderpriority AS law, l_linenumber * 2 AS ord FROM li
  UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'involve', l_orderkey, o_orderpriority, l_linenumber * 2 + 1 FROM li),
ends AS (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges),
degree AS (SELECT id, count(*) AS degree FROM ends GROUP BY id),
hub AS (SELECT id FROM degree ORDER BY degree DESC, id LIMIT 1)"""
SQL_ORDER_NODES = """nodes AS (SELECT 'customer:' || c_custkey AS id, c_name AS name, 'customer' AS type, [c_mktsegment] AS aliases FROM customer
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'part', [p_brand] FROM part
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier', [s_nationkey::VARCHAR] FROM supplier)"""
SQL_ADJ = """adj AS (SELECT DISTINCT a, b FROM (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges) x),
h1 AS (SELECT b AS id FROM adj, hub WHERE a = hub.id AND b <> hub.id),
br AS (SELECT adj.b AS id, count(*) AS bridges FROM h1 JOIN adj ON adj.a = h1.id GROUP BY adj.b),
cand AS (SELECT id, bridges, row_number() OVER (ORDER BY bridges DESC, id) AS r FROM br
   WHERE id NOT IN (SELECT id FROM h1) AND id NOT IN (SELECT id FROM hub)),
members AS (SELECT id, 0 AS hop, 0 AS bridges FROM hub UNION ALL SELECT id, 1, 0 FROM h1
   UNION ALL SELECT id, 2, bridges FROM cand WHERE r <= greatest(0, {max_nodes} - 1 - (SELECT count(*) FROM h1)))"""


@register("edge_dedupe_first", f"""WITH {SQL_ORDER_EDGES}
SELECT source, target, relation, item_id, min(ord)::BIGINT AS ord FROM edges GROUP BY ALL""")
def edge_dedupe_first(spark, d):
    from clausegraph.operators.scale import first_by

    return first_by(order_edges(spark, d), gx.EDGE_KEY, ["ord"]).select(
        "source", "target", "relation", "item_id", F.col("ord").cast("bigint").alias("ord"))


@register("edge_merge_list", f"""WITH {SQL_ORDER_EDGES},
f AS (SELECT *, row_number() OVER (PARTITION BY source, target, relation ORDER BY item_id, ord) AS rk,
   count(*) OVER (PARTITION BY source, target, relation) AS c FROM edges),
n AS (SELECT source, target, relation, count(DISTINCT item_id) AS n_items FROM edges GROUP BY ALL)
SELECT source, target, relation, item_id, law, n_items FROM f JOIN n USING (source, target, relation) WHERE rk = 1""")
def edge_merge_list(spark, d):
    return gx.merge_edges(order_edges(spark, d), ORDER)


@register("edge_items", f"""WITH {SQL_ORDER_EDGES}
SELECT source, target, relation, item_id, CAST(min(ord) AS BIGINT) AS first_ord FROM edges GROUP BY ALL""")
def edge_items(spark, d):
    return gx.edge_items(order_edges(spark, d), ["ord"]).select(
        "source", "target", "relation", "item_id", F.col("first_seq.ord").cast("bigint").alias("first_ord"))


@register("graph_stats", f"""WITH {SQL_ORDER_EDGES}, {SQL_ORDER_NODES}
SELECT 'relation' AS kind, relation AS key, CAST(count(*) AS BIGINT) AS n FROM edges GROUP BY relation
UNION ALL SELECT 'type', type, count(*) FROM nodes GROUP BY type
UNION ALL SELECT 'law', law, count(DISTINCT item_id) FROM edges GROUP BY law""")
def graph_stats(spark, d):
    edges, nodes = order_edges(spark, d), order_nodes(spark, d)
    by_law = edges.select("law", "item_id").distinct()
    out = None
    for kind, df, column in (("relation", edges, "relation"), ("type", nodes, "type"), ("law", by_law, "law")):
        part = gx.distribution(df, column).select(F.lit(kind).alias("kind"), F.col(column).alias("key"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@register("graph_hubs", f"WITH {SQL_ORDER_EDGES} SELECT id, degree FROM degree ORDER BY degree DESC, id LIMIT 12")
def graph_hubs(spark, d):
    return gx.hubs(order_edges(spark, d))



@register("graph_ego", f"""WITH {SQL_ORDER_EDGES}, {SQL_ADJ.format(max_nodes=2000)}
SELECT hub.id AS center, m.id, CAST(hop AS BIGINT) AS hop, CAST(bridges AS BIGINT) AS bridges FROM members m, hub""")
def graph_ego(spark, d):
    edges = order_edges(spark, d)
    return gx.ego_nodes(edges, gx.hubs(edges, 1), 2, 2000).select(
        "center", "id", F.col("hop").cast("bigint").alias("hop"), "bridges")


@register("graph_ego_edges", f"""WITH {SQL_ORDER_EDGES}, {SQL_ADJ.format(max_nodes=2000)},
inside AS (SELECT e.* FROM edges e JOIN members s ON s.id = e.source JOIN members t ON t.id = e.target WHERE least(s.hop, t.hop) < 2)
SELECT source, target, relation, CAST(count(DISTINCT item_id) AS BIGINT) AS n_items FROM inside GROUP BY ALL""")
def graph_ego_edges(spark, d):
    edges = order_edges(spark, d)
    members = gx.ego_nodes(edges, gx.hubs(edges, 1), 2, 2000)
    return gx.merge_edges(gx.ego_edges(edges, members), ORDER).select("source", "target", "relation", "n_items")


@register("graph_subgraph", f"""WITH {SQL_ORDER_EDGES},
asked AS (SELECT o_orderkey AS item_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000)
SELECT source, target, relation, item_id, CAST(ord AS BIGINT) AS ord FROM edges
WHERE item_id IN (SELECT item_id FROM asked) OR source IN (SELECT id FROM hub) OR target IN (SELECT id FROM hub)""")
def graph_subgraph(spark, d):
    edges = order_edges(spark, d)
    asked = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 400000").select(
        F.col("o_orderkey").alias("item_id"))
    return gx.subgraph(edges, asked, gx.hubs(edges, 1)).select(
        "source", "target", "relation", "item_id", F.col("ord").cast("bigint").alias("ord"))


@register("entity_detail", f"""WITH {SQL_ORDER_EDGES}
SELECT relation, item_id, law, o_orderstatus AS status, CAST(count(*) AS BIGINT) AS n FROM edges JOIN orders ON o_orderkey = item_id
WHERE (source = 'supplier:1' OR target = 'supplier:1') AND law IN ('1-URGENT', '2-HIGH') GROUP BY ALL""")
def entity_detail(spark, d):
    triples = gx.entity_detail(order_edges(spark, d), "supplier:1", laws=["1-URGENT", "2-HIGH"])
    facts = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("status"))
    return triples.join(facts, "item_id").groupBy("relation", "item_id", "law", "status").agg(F.count(F.lit(1)).alias("n"))


@register("graph_filter", f"""WITH {SQL_ORDER_EDGES}, {SQL_ORDER_NODES},
matched AS (SELECT id FROM nodes WHERE type = 'part' AND (contains(name, '#1') OR contains(name, '1') OR contains(aliases[1], '1'))),
pool AS (SELECT * FROM edges WHERE law = '1-URGENT' AND relation IN ('punish', 'involve')
   AND (source IN (SELECT id FROM matched) OR target IN (SELECT id FROM matched))),
ids AS (SELECT source AS id FROM pool UNION SELECT target FROM pool)
SELECT n.id, n.type, n.id NOT IN (SELECT id FROM matched) AS contextual FROM nodes n WHERE id IN (SELECT id FROM ids)""")
def graph_filter(spark, d):
    nodes, _ = gx.graph_filter(order_nodes(spark, d), order_edges(spark, d), types=["part"], laws=["1-URGENT"],
                               relations=["punish", "involve"], query="1", order=ORDER)
    return nodes.select("id", "type", "contextual")


