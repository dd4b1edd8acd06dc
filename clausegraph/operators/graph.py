"""Typed property graph: building it from sentences, searching and exploring it.

Edges are ``(source, target, relation, item_id, law, seq)`` where ``seq`` is a
sortable struct that fixes which of several equal edges came first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.config import GraphWeights
from clausegraph.functions import text as tx
from clausegraph.functions.exact import to_fixed
from clausegraph.operators.lexicon import PhraseMatcher, contains_join
from clausegraph.operators.scale import first_by, fits, lookup_join, top_per_key
from clausegraph.packs.base import GraphPack
from clausegraph.session import cut_lineage, cut_table

EDGE_KEY = ["source", "target", "relation", "item_id"]


# ---------------------------------------------------------------- building

def pack_nodes(spark, pack: GraphPack) -> DataFrame:
    """Lexicon entities as ``(id, name, type, aliases, behaviors)``; the first entry of an id wins."""
    rows, seen = [], set()

    def add(name, kind, aliases, behaviors=()):
        key = f"{kind}:{name}"
        if key not in seen:
            seen.add(key)
            rows.append((key, name, kind, list(aliases), list(behaviors)))

    for name, aliases in pack.subjects:
        add(name, pack.subject_type, aliases)
    for b in pack.behaviors:
        add(b.name, b.kind, b.aliases)
    for name, aliases in pack.objects:
        add(name, pack.object_type, aliases)
    for name, aliases in pack.penalties:
        add(name, pack.penalty_type, aliases)
    for name, aliases, behaviors in pack.themes:
        add(name, pack.theme_type, aliases, behaviors)
    return spark.createDataFrame(rows, "id string, name string, type string, aliases array<string>, behaviors array<string>")


def sentence_facts(units: DataFrame, pack: GraphPack) -> DataFrame:
    """Per sentence: subject, behavior, kind, relation, objects and penalties."""
    words = [w for m in (pack.subjects, pack.objects, pack.penalties) for n, a in m for w in (n, *a)]
    words += [w for b in pack.behaviors for w in (*b.aliases, *b.verbs, *b.objects)]
    words += [*pack.prohibit_words, *pack.breach_words, *pack.duty_words, *pack.unit_phrases, *pack.person_phrases,
              *pack.modal_words]
    m = PhraseMatcher(words)
    rows = m.annotate(units, "unit")

    by_length = sorted(pack.subjects, key=lambda s: -len(s[0]))  # stable: list order breaks ties
    named = m.first([(name, [name, *aliases]) for name, aliases in by_length])
    behaviors = [(b, m.any_of(b.aliases) | (m.any_of(b.verbs) & m.any_of(b.objects))) for b in pack.behaviors]
    behavior = F.coalesce(*[F.when(test, F.lit(b.name)) for b, test in behaviors])
    kind = F.coalesce(*[F.when(test, F.lit(b.kind)) for b, test in behaviors])
    fallback = (F.when(m.any_of(pack.unit_phrases), F.lit(pack.unit_subject))
                .when(m.any_of(pack.person_phrases) & m.any_of(pack.modal_words), F.lit(pack.person_subject)))
    rows = rows.withColumns({
        "behavior": behavior, "kind": kind, "subject": F.coalesce(named, fallback),
        "objects": m.canonicals(pack.objects), "penalties": m.canonicals(pack.penalties),
    })
    relation = (F.when(m.any_of(pack.prohibit_words), pack.prohibit)
                .when(F.col("kind") == pack.violation_kind,
                      F.when(m.any_of(pack.breach_words), pack.prohibit).otherwise(pack.responsibility))
                .when(m.any_of(pack.duty_words), pack.duty)
                .when(F.col("kind").isin(*pack.duty_kinds), pack.duty)
                .otherwise(pack.responsibility))
    return rows.withColumn("relation", relation).drop(m.column).where(F.col("behavior").isNotNull())


def _edge(source: Column, target: Column, relation: Column | str, order: Column) -> Column:
    rel = F.lit(relation) if isinstance(relation, str) else relation
    return F.struct(source.alias("source"), target.alias("target"), rel.alias("relation"),
                    order.cast("int").alias("ord"))


def sentence_edges(facts: DataFrame, pack: GraphPack) -> DataFrame:
    """Subject→behavior, behavior→object and behavior→penalty edges of every sentence."""
    behavior = F.concat_ws(":", "kind", "behavior")
    subject = F.concat(F.lit(f"{pack.subject_type}:"), F.col("subject"))
    head = F.when(F.col("subject").isNotNull(), F.array(_edge(subject, behavior, F.col("relation"), F.lit(0))))
    objects = F.transform("objects", lambda o, i: _edge(
        behavior, F.concat(F.lit(f"{pack.object_type}:"), o), pack.involve, i + 1))
    penalties = F.transform("penalties", lambda p, i: _edge(
        behavior, F.concat(F.lit(f"{pack.penalty_type}:"), p), pack.punish, i + 1001))
    empty = F.array().cast("array<struct<source:string,target:string,relation:string,ord:int>>")
    edges = F.concat(F.coalesce(head, empty), objects, penalties)
    return facts.select("item_id", "law", F.lit(1).alias("pass"), F.col("unit_no").alias("pos"),
                        F.explode(edges).alias("e")).select(
        "e.source", "e.target", "e.relation", "item_id", "law", "pass", "pos", "e.ord")


def propagated_edges(facts: DataFrame, item_penalties: DataFrame, pack: GraphPack) -> DataFrame:
    """Every behavior of an item to every penalty named anywhere in the item's text.

    ``item_penalties(item_id, law, penalties)``.  Both lists are bounded by the lexicon.
    """
    behaviors = facts.select("item_id", F.concat_ws(":", "kind", "behavior").alias("source")).distinct()
    targets = item_penalties.where(F.size("penalties") > 0).select(
        "item_id", "law", F.posexplode("penalties").alias("ord", "p"))
    return behaviors.join(targets, "item_id").select(
        "source", F.concat(F.lit(f"{pack.penalty_type}:"), F.col("p")).alias("target"),
        F.lit(pack.punish).alias("relation"), "item_id", "law", F.lit(2).alias("pass"), F.lit(0).alias("pos"), "ord")


def item_penalties(items: DataFrame, pack: GraphPack, text: str = "text") -> DataFrame:
    m = PhraseMatcher([w for n, a in pack.penalties for w in (n, *a)])
    return m.annotate(items, text).select("item_id", "law", m.canonicals(pack.penalties).alias("penalties"))


def theme_edges(edges: DataFrame, nodes: DataFrame, pack: GraphPack) -> DataFrame:
    """Theme→behavior edges, placed on the item of the behavior's first edge."""
    order = ["pass", "item_id", "pos", "ord"]
    ends = edges.withColumn("node", F.explode(F.array("source", "target")))
    firsts = cut_lineage(ends.groupBy("node").agg(F.min(F.struct(*order, "law")).alias("f")))  # one row a node, read up to four times
    themes = nodes.where(F.col("type") == pack.theme_type)
    wanted = themes.select(F.col("id").alias("source"), F.posexplode("behaviors").alias("ord", "name"))
    behaviors = nodes.where(F.col("type").isin(*pack.behavior_kinds)).select(F.col("id").alias("node"), "name")
    linked = wanted.join(behaviors, "name").join(firsts, "node")
    out = linked.select("source", F.col("node").alias("target"), "ord", "f")
    if pack.penalty_theme:
        theme_id = f"{pack.theme_type}:{pack.penalty_theme}"
        penalties = nodes.where(F.col("type") == pack.penalty_type).select(F.col("id").alias("node"))
        pick = penalties.join(firsts, "node").agg(F.min_by(F.struct("node", "f"), "node").alias("p"))
        alone = pick.where(F.col("p").isNotNull()).select(
            F.lit(theme_id).alias("source"), F.col("p.node").alias("target"), F.lit(0).alias("ord"), F.col("p.f").alias("f"))
        out = out.unionByName(alone.join(out.select("source").distinct(), "source", "left_anti"))
    return out.select("source", "target", F.lit(pack.involve).alias("relation"), F.col("f.item_id").alias("item_id"),
                      F.col("f.law").alias("law"), F.lit(3).alias("pass"), F.lit(0).alias("pos"), "ord")


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """First edge per (source, target, relation, item)."""
    return first_by(edges, EDGE_KEY, ["pass", "pos", "ord"])


def degrees(edges: DataFrame) -> DataFrame:
    """``(id, degree)``; both ends count, a self loop counts twice."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(
        F.count(F.lit(1)).alias("degree"))


def prune_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with at least one edge, with their degree."""
    return nodes.join(degrees(edges), "id")


def build_graph(units: DataFrame, items: DataFrame, pack: GraphPack) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` from ``units(item_id, law, unit_no, unit)`` and ``items(item_id, law, text)``.

    Facts and edges are checkpointed: searches read the graph many times and must
    not scan the texts again, also when executors are lost in between.
    """
    facts = cut_table(sentence_facts(units, pack).drop("unit"))
    nodes = pack_nodes(units.sparkSession, pack)
    base = sentence_edges(facts, pack).unionByName(propagated_edges(facts, item_penalties(items, pack), pack))
    base = cut_table(dedupe_edges(base))
    themes = cut_lineage(dedupe_edges(theme_edges(base, nodes, pack)))  # at most the pack's theme entries
    same = [F.col(f"_b.{c}").eqNullSafe(F.col(f"_t.{c}")) for c in EDGE_KEY]
    known = base.alias("_b").join(F.broadcast(themes.alias("_t")), same, "left_semi").select(*EDGE_KEY)
    fresh = cut_lineage(themes.alias("_t").join(F.broadcast(known).alias("_b"), same, "left_anti").select(*base.columns))
    edges = base.unionByName(fresh)  # an edge of the text comes before the theme's
    return cut_lineage(prune_nodes(nodes, edges)), edges


# ---------------------------------------------------------------- merging for display

def merge_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """One row per (source, target, relation): the first edge's item and the number of items.

    The item list itself stays in long form (:func:`edge_items`): one popular
    pair may own a large share of all edges.
    """
    fields = [*order, *[c for c in ("item_id", "law") if c not in order]]
    per_item = edges.groupBy("source", "target", "relation", "item_id").agg(F.min(F.struct(*fields)).alias("f0"))
    return per_item.groupBy("source", "target", "relation").agg(
        F.min("f0").alias("f"), F.count(F.lit(1)).alias("n_items")).select(
        "source", "target", "relation", F.col("f.item_id").alias("item_id"), F.col("f.law").alias("law"), "n_items")


def edge_items(edges: DataFrame, order: list[str]) -> DataFrame:
    """Distinct items of every merged edge with their first position."""
    return edges.groupBy("source", "target", "relation", "item_id").agg(F.min(F.struct(*order)).alias("first_seq"))


# ---------------------------------------------------------------- search

def node_items(edges: DataFrame) -> DataFrame:
    """``(node, item_id)`` for every node that touches an edge of the item."""
    return edges.where(F.col("item_id").isNotNull()).select(
        F.explode(F.array("source", "target")).alias("node"), "item_id").distinct()


def link_entities(queries: DataFrame, nodes: DataFrame, behavior_kinds: tuple[str, ...],
                  w: GraphWeights = GraphWeights()) -> DataFrame:
    """``(query_id, node, name, type, strength, behaviors)``.

    Name hit, else alias hit, else for behaviors two distinct alias bigrams.
    """
    named = nodes.select("id", F.col("name").alias("term"), F.lit(w.name_hit).alias("s"))
    aliased = nodes.select("id", F.explode("aliases").alias("term"), F.lit(w.alias_hit).alias("s"))
    terms = named.unionByName(aliased).where(F.col("term") != "").withColumn("term_id", F.xxhash64("id", "term", "s"))
    hits = contains_join(queries.select("query_id", "text"), terms).select("query_id", "term_id")
    direct = hits.join(F.broadcast(terms) if fits(terms) else terms, "term_id").select("query_id", "id", "s")

    grams = nodes.where(F.col("type").isin(*behavior_kinds)).select("id", F.explode("aliases").alias("alias")).select(
        "id", F.explode(tx.char_bigrams(F.trim("alias"))).alias("gram")).distinct()
    asked = queries.select("query_id", F.explode(F.array_distinct(tx.char_bigrams("text"))).alias("gram"))
    fuzzy = lookup_join(asked, grams, "gram").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    fuzzy = fuzzy.select("query_id", "id", F.lit(w.fuzzy_hit).alias("s"))

    best = direct.unionByName(fuzzy).groupBy("query_id", "id").agg(F.max("s").alias("strength"))
    return lookup_join(best, nodes.select("id", "name", "type", "behaviors"), "id").withColumnRenamed("id", "node")


def item_profiles(edges: DataFrame, pack: GraphPack, k: int) -> DataFrame:
    """``(profile, marks, first, items)``: items that touch the same nodes and punishment edges get the same scores and paths.

    ``marks(hop, node, target, n)`` are the nodes of an item and its ``n`` punishment edges at a node (``hop``); of a
    profile's items the ``k`` smallest are kept, ``first`` is the least of them.  The lexicon bounds the marks of an item.
    """
    nodes = node_items(edges).select("item_id", F.lit(False).alias("hop"), "node", F.lit(None).cast("string").alias("target"), F.lit(1).cast("bigint").alias("n"))
    penal = edges.where(F.col("relation") == pack.punish).select(
        "item_id", F.lit(True).alias("hop"), F.explode(F.array_distinct(F.array("source", "target"))).alias("node"), "target")
    marks = nodes.unionByName(penal.groupBy(*penal.columns).agg(F.count(F.lit(1)).alias("n")))
    per_item = marks.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("hop", "node", "target", "n"))).alias("marks"))
    ranked = top_per_key(per_item, ["marks"], [F.col("item_id").asc()], k)
    grouped = ranked.groupBy("marks").agg(F.min_by("item_id", "rank").alias("first"), F.collect_list(F.struct("item_id")).alias("items"))
    return cut_lineage(grouped.withColumn("profile", F.monotonically_increasing_id()))


def graph_search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, pack: GraphPack, k: int = 5,
                 w: GraphWeights = GraphWeights()) -> DataFrame:
    """``(query_id, item_id, score, path, rank)``: items supported by the linked entities.

    Evidence adds up over seeds, themes drilled down to behaviors, and punishment
    edges of behavior seeds; the path names the strongest kind of evidence.
    """
    punish = tx.contains_any("text", pack.punish_words)
    seeds = link_entities(queries, nodes, pack.behavior_kinds, w)
    seeds = seeds.join(queries.select("query_id", punish.alias("asks_punish")), "query_id")
    is_behavior = F.col("type").isin(*pack.behavior_kinds)
    seeds = cut_lineage(seeds.withColumn("has_behavior", F.max(is_behavior).over(Window.partitionBy("query_id"))))
    boost = F.when(F.col("asks_punish"), w.punish_boost).otherwise(1.0)
    weight = (F.when(F.col("type") == pack.subject_type, F.col("strength") * w.subject)
              .when(F.col("type") == pack.theme_type, F.col("strength") * w.theme)
              .when(is_behavior, F.col("strength") * boost).otherwise(F.col("strength")))
    direct = seeds.where((F.col("type") != pack.subject_type) | ~F.col("has_behavior")).select(
        "query_id", "node", weight.alias("w"), F.struct(F.lit(1).alias("p"), F.col("name").alias("label")).alias("path"))
    targets = nodes.where(F.col("type").isin(*pack.behavior_kinds)).select(
        F.col("id").alias("node"), F.col("name").alias("behavior"))
    drilled = seeds.where(F.col("type") == pack.theme_type).select(
        "query_id", "name", "strength", F.explode("behaviors").alias("behavior"))
    drilled = lookup_join(drilled, targets, "behavior").select(
        "query_id", "node", (F.col("strength") * w.theme_drill).alias("w"),
        F.struct(F.lit(2).alias("p"), F.concat_ws(" → ", "name", "behavior").alias("label")).alias("path"))
    spread_ = direct.unionByName(drilled)
    profiles = item_profiles(edges, pack, k)
    marks = profiles.select("profile", "first", F.explode("marks").alias("m")).select("profile", "first", "m.*")
    touched = marks.where(~F.col("hop")).select("profile", "first", "node")
    found = lookup_join(touched, spread_, "node").select("query_id", "profile", "first", "w", F.lit(1).cast("bigint").alias("n"), "path")

    hop = seeds.where(is_behavior).select(
        "query_id", "node", "name", (F.col("strength") * w.punish_hop * boost).alias("w"))
    target_name = F.substring_index("target", ":", -1)
    hops = lookup_join(marks.where("hop").drop("hop"), hop, "node").select(
        "query_id", "profile", "first", "w", "n",
        F.struct(F.lit(3).alias("p"), F.concat_ws(" → ", "name", target_name).alias("label")).alias("path"))
    scored = found.unionByName(hops).groupBy("query_id", "profile", "first").agg(
        F.sum(to_fixed(F.col("w")) * F.col("n")).alias("raw"), F.max("path").alias("path"))
    # an item among the best k has fewer than k profiles before its own
    best = top_per_key(scored.where(F.col("raw") > 0), ["query_id"], [F.col("raw").desc(), F.col("first").asc()], k).drop("rank", "first")
    items = profiles.select("profile", F.explode("items.item_id").alias("item_id"))
    scored = lookup_join(items, best, "profile").select("query_id", "item_id", "raw", "path")
    from clausegraph.operators.lexical import normalized_top

    return normalized_top(scored, k).select("query_id", "item_id", "score", F.col("path.label").alias("path"), "rank")


# ---------------------------------------------------------------- exploration

def graph_filter(nodes: DataFrame, edges: DataFrame, types=(), laws=(), relations=(), query: str = "",
                 order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Visible nodes (with ``contextual``) and merged edges for a filter combination."""
    pool = edges
    if laws:
        pool = pool.where(F.col("law").isin(*laws))
    if relations:
        pool = pool.where(F.col("relation").isin(*relations))
    matched = nodes
    if types:
        matched = matched.where(F.col("type").isin(*types))
    if query.strip():
        q = F.lit(query.strip())
        matched = matched.where(F.contains("name", q) | F.exists("aliases", lambda a: F.contains(a, q)))
    ids = matched.select("id").withColumn("_m", F.lit(True))
    if types or query:
        ends = pool.join(ids.withColumnRenamed("id", "source").withColumnRenamed("_m", "_s"), "source", "left")
        ends = ends.join(ids.withColumnRenamed("id", "target").withColumnRenamed("_m", "_t"), "target", "left")
        pool = ends.where(F.col("_s") | F.col("_t")).drop("_s", "_t").select(*edges.columns)
    if types or query or laws or relations:
        touched = pool.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        shown = nodes.join(touched, "id", "left_semi")
    else:
        shown = nodes
    shown = shown.join(ids, "id", "left").withColumn("contextual", F.col("_m").isNull()).drop("_m")
    visible = nodes.select("id")
    inner = (pool.join(visible.withColumnRenamed("id", "source"), "source", "left_semi")
             .join(visible.withColumnRenamed("id", "target"), "target", "left_semi"))
    return shown, merge_edges(inner, order or ["pass", "pos", "ord"])


def neighbours(edges: DataFrame) -> DataFrame:
    """Undirected distinct adjacency ``(a, b)``."""
    pair = F.struct(F.col("source").alias("a"), F.col("target").alias("b"))
    back = F.struct(F.col("target").alias("a"), F.col("source").alias("b"))
    return edges.select(F.explode(F.array(pair, back)).alias("e")).select("e.a", "e.b").distinct()


def steps_from(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``(center, via, id)``: the distinct neighbours ``id`` of every node of ``start(center, id)``.

    Only edges that touch ``start`` are made distinct; those of all other nodes never cross the network.
    """
    ends = F.array(*[F.struct(F.col(a).alias("via"), F.col(b).alias("id")) for a, b in (("source", "target"), ("target", "source"))])
    both = edges.select("source", "target").select(F.explode(ends).alias("e")).select("e.via", "e.id")
    return lookup_join(both, start.withColumnRenamed("id", "via"), "via").select("center", "via", "id").distinct()


def ego_nodes(edges: DataFrame, centers: DataFrame, hops: int = 2, max_nodes: int = 56) -> DataFrame:
    """``(center, id, hop, bridges)`` around every center.

    All direct neighbours are kept; second-hop nodes fill what is left of
    ``max_nodes``, most bridges into the first hop first.
    """
    start = cut_lineage(centers.select(F.col("id").alias("center")).distinct())
    hop0 = start.select("center", F.col("center").alias("id"), F.lit(0).alias("hop"), F.lit(0).cast("bigint").alias("bridges"))
    hop1 = steps_from(edges, start.select("center", F.col("center").alias("id"))).where("id <> center").select("center", "id")
    hop1 = cut_lineage(hop1)  # read five times below; far smaller than the edges
    near = hop1.select("center", "id", F.lit(1).alias("hop"), F.lit(0).cast("bigint").alias("bridges"))
    if hops < 2:
        return hop0.unionByName(near)
    bridged = steps_from(edges, hop1).groupBy("center", "id").agg(F.count(F.lit(1)).alias("bridges"))
    known = hop0.select("center", "id").unionByName(hop1)
    fresh = bridged.join(known, ["center", "id"], "left_anti")
    room = hop1.groupBy("center").agg(F.greatest(F.lit(0), F.lit(max_nodes - 1) - F.count(F.lit(1))).alias("room"))
    ranked = top_per_key(fresh, ["center"], [F.col("bridges").desc(), F.col("id").asc()], max_nodes, "r")
    far = lookup_join(ranked, room, "center").where(F.col("r") <= F.col("room")).select(
        "center", "id", F.lit(2).alias("hop"), "bridges")
    return hop0.unionByName(near).unionByName(far)


def ego_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges inside each ego network, without those between two second-hop nodes."""
    members = cut_table(members.select("center", "id", "hop"))  # counted and read twice; far smaller than the edges
    s = members.select("center", F.col("id").alias("source"), F.col("hop").alias("hs"))
    t = members.select("center", F.col("id").alias("target"), F.col("hop").alias("ht"))
    inside = lookup_join(lookup_join(edges, s, "source"), t, ["center", "target"])
    return inside.where(F.least("hs", "ht") < 2).drop("hs", "ht")


def subgraph(edges: DataFrame, items: DataFrame, highlight: DataFrame) -> DataFrame:
    """Edges of the given items plus edges that touch a highlighted node."""
    asked = items.select("item_id").distinct().withColumn("_i", F.lit(True))
    marks = cut_table(highlight.select("id").distinct()).withColumn("_h", F.lit(True))  # counted and joined twice
    flagged = lookup_join(edges, asked, "item_id", "left")
    flagged = lookup_join(flagged, marks.select(F.col("id").alias("source"), F.col("_h").alias("_s")), "source", "left")
    flagged = lookup_join(flagged, marks.select(F.col("id").alias("target"), F.col("_h").alias("_t")), "target", "left")
    return flagged.where(F.coalesce("_i", F.lit(False)) | F.coalesce("_s", F.lit(False)) | F.coalesce("_t", F.lit(False))).select(
        *edges.columns)


def entity_detail(edges: DataFrame, node_id: str, laws=(), relations=()) -> DataFrame:
    """Edges incident to one node, optionally filtered."""
    out = edges.where((F.col("source") == node_id) | (F.col("target") == node_id))
    if laws:
        out = out.where(F.col("law").isin(*laws))
    if relations:
        out = out.where(F.col("relation").isin(*relations))
    return out


def graph_health(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Per law: edges, items with an edge, items without one.  ``units(item_id, law)``."""
    items = units.select("item_id", "law").distinct()
    per_item = edges.groupBy("law", "item_id").agg(F.count(F.lit(1)).alias("n"))
    by_law = per_item.groupBy("law").agg(F.sum("n").alias("edges"), F.count(F.lit(1)).alias("linked_items"))
    lost = items.join(per_item.select("item_id").distinct(), "item_id", "left_anti").groupBy("law").agg(
        F.count(F.lit(1)).alias("orphan_items"))
    zero = F.lit(0).cast("bigint")
    return by_law.join(lost, "law", "full_outer").select(
        "law", F.coalesce("edges", zero).alias("edges"), F.coalesce("linked_items", zero).alias("linked_items"),
        F.coalesce("orphan_items", zero).alias("orphan_items"))


def hubs(edges: DataFrame, k: int = 12) -> DataFrame:
    return degrees(edges).orderBy(F.col("degree").desc(), F.col("id").asc()).limit(k)


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
