from pyspark.sql import functions as F

from clausegraph.functions import text as tx
from clausegraph.operators import graph as gx
from clausegraph.packs.base import Behavior, GraphPack

PACK = GraphPack(
    subjects=[("owner", ["landlord"]), ("building owner", [])], behaviors=[
        Behavior("block exit", "violation", ["blocked exit"], ["block"], ["exit"]), Behavior("train staff", "duty", ["training"])],
    objects=[("exit", ["exit", "doorway"])], penalties=[("fine", ["fined"])], themes=[("escape", ["get out"], ["block exit"])],
    prohibit_words=["must not"], breach_words=["illegal"], duty_words=["shall"], unit_phrases=["every company"],
    person_phrases=["anyone"], modal_words=["shall", "must not"], punish_words=["penalty"], unit_subject="company", person_subject="person")


def build(spark):
    items = spark.createDataFrame([
        (1, "L1", "The building owner must not block the exit; anyone shall attend training"),
        (2, "L1", "A blocked exit is fined"), (3, "L2", "Nothing here")], "item_id bigint, law string, text string")
    units = items.select("item_id", "law", F.posexplode(tx.sentences("text")).alias("unit_no", "unit"))
    return units, *gx.build_graph(units, items, PACK)


def test_build(spark):
    units, nodes, edges = build(spark)
    got = {(r["source"], r["target"], r["relation"], r["item_id"]) for r in edges.collect()}
    b, t = "violation:block exit", "duty:train staff"
    assert got == {
        ("subject:building owner", b, "prohibit", 1), (b, "object:exit", "involve", 1), ("subject:person", t, "duty", 1),
        (b, "object:exit", "involve", 2), (b, "penalty:fine", "punish", 2), ("theme:escape", b, "involve", 1)}
    degree = {r["id"]: r["degree"] for r in nodes.collect()}
    assert degree[b] == 5 and degree["penalty:fine"] == 1 and "subject:owner" not in degree
    health = {r["law"]: (r["edges"], r["linked_items"], r["orphan_items"]) for r in gx.graph_health(units.select("item_id", "law"), edges).collect()}
    assert health == {"L1": (6, 2, 0), "L2": (0, 0, 1)}


def test_search(spark):
    _, nodes, edges = build(spark)
    q = spark.createDataFrame([(1, "penalty for a blocked exit"), (2, "how to get out"), (3, "zq")], "query_id bigint, text string")
    links = {(r["query_id"], r["node"]): r["strength"] for r in gx.link_entities(q, nodes, PACK.behavior_kinds).collect()}
    assert links[(1, "violation:block exit")] == 0.95 and links[(1, "object:exit")] == 1.0 and links[(2, "theme:escape")] == 0.95
    got = {(r["query_id"], r["item_id"]): (round(r["score"], 4), r["path"]) for r in gx.graph_search(q, nodes, edges, PACK).collect()}
    # item 2: behavior .95*1.6 + object 1 + punish hop .95*.8*1.6; item 1: behavior + object
    one, two = 0.95 * 1.6 + 1.0, 0.95 * 1.6 + 1.0 + 0.95 * 0.8 * 1.6
    assert got[(1, 2)] == (1.0, "block exit → fine") and got[(1, 1)][0] == round(one / two, 4)
    assert not any(k[0] == 3 for k in got)


def test_ego_and_filters(spark):
    rows = [("a", "b", 1), ("b", "c", 2), ("c", "d", 3), ("b", "e", 1), ("f", "c", 4), ("a", "g", 5), ("g", "c", 5), ("c", "e", 6)]
    edges = spark.createDataFrame([(s, t, "involve", i, "L", n) for n, (s, t, i) in enumerate(rows)],
                                  "source string, target string, relation string, item_id int, law string, ord int")
    center = spark.createDataFrame([("a",)], "id string")
    got = {r["id"]: (r["hop"], r["bridges"]) for r in gx.ego_nodes(edges, center, 2, 56).collect()}
    assert got == {"a": (0, 0), "b": (1, 0), "g": (1, 0), "c": (2, 2), "e": (2, 1)}
    tight = gx.ego_nodes(edges, center, 2, 4)
    assert {r["id"] for r in tight.collect()} == {"a", "b", "g", "c"}
    inside = {(r["source"], r["target"]) for r in gx.ego_edges(edges, gx.ego_nodes(edges, center, 2, 56)).collect()}
    assert ("c", "e") not in inside and ("b", "c") in inside
    items, mark = spark.createDataFrame([(3,)], "item_id int"), spark.createDataFrame([("f",)], "id string")
    assert {r["ord"] for r in gx.subgraph(edges, items, mark).collect()} == {2, 4}
    assert gx.entity_detail(edges, "c", laws=["X"]).count() == 0 and gx.entity_detail(edges, "c").count() == 5
    assert [r["id"] for r in gx.hubs(edges, 2).collect()] == ["c", "b"]


def test_dedupe_first_and_merge(spark):
    e = spark.createDataFrame([("s", "t", "r", 1, "L", 1, 5, 0), ("s", "t", "r", 1, "L", 1, 2, 0), ("s", "t", "r", 2, "L", 1, 1, 0)],
                              "source string, target string, relation string, item_id bigint, law string, pass int, pos int, ord int")
    first = gx.dedupe_edges(e)
    assert {(r["item_id"], r["pos"]) for r in first.collect()} == {(1, 2), (2, 1)}
    merged = gx.merge_edges(e, ["pass", "pos", "ord"]).collect()
    assert [(r["item_id"], r["n_items"]) for r in merged] == [(2, 2)]
