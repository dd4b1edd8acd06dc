"""Graph operators read their edges and facts once, and send few of them over the network."""

import pytest
from pyspark.sql import functions as F

from clausegraph.operators import graph as gx

from test_graph import PACK, build

EDGES = "source string, target string, relation string, item_id int, law string, ord int"


@pytest.fixture
def counted(spark):
    """``counted(frame)``: the frame, and an accumulator of the rows that were computed."""
    def of(frame):
        seen = spark.sparkContext.accumulator(0)

        @F.udf("boolean")
        def look(_):
            seen.add(1)
            return True

        return frame.where(look.asNondeterministic()(F.lit(1))), seen

    return of


def star(spark, n=40):
    rows = [(f"p{i % 9}", f"s{i % 7}", "involve", i, "L", i) for i in range(n)]
    return spark.createDataFrame(rows, EDGES)


def test_ego_filters_before_it_makes_distinct(spark):
    start = spark.createDataFrame([("p1", "p1")], "center string, id string")
    steps = gx.steps_from(star(spark), start)
    plan = steps._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Aggregate") < plan.index("Join")  # the distinct is above the join
    assert {r["id"] for r in steps.collect()} == {f"s{i % 7}" for i in range(40) if i % 9 == 1}


def test_ego_edges_compute_the_members_once(spark, counted):
    members, seen = counted(spark.createDataFrame([("p1", "p1", 0)] + [("p1", f"s{i}", 1) for i in range(7)], "center string, id string, hop int"))
    got = gx.ego_edges(star(spark), members).collect()
    assert {r["source"] for r in got} == {"p1"} and seen.value == 8


def test_subgraph_computes_the_highlight_once(spark, counted):
    marks, seen = counted(spark.createDataFrame([("s3",)], "id string"))
    got = gx.subgraph(star(spark), spark.createDataFrame([(0,)], "item_id int"), marks).collect()
    assert {r["item_id"] for r in got} == {0} | {i for i in range(40) if i % 7 == 3} and seen.value == 1


def test_theme_edges_compute_the_edges_once(spark, counted):
    _, nodes, edges = build(spark)
    base = edges.where("pass < 3")
    rows, seen = counted(base)
    got = gx.theme_edges(rows, nodes.drop("degree"), PACK).collect()
    assert [(r["source"], r["target"], r["item_id"]) for r in got] == [("theme:escape", "violation:block exit", 1)]
    assert seen.value == base.count()


def test_search_scores_equal_items_once(spark):
    rows = []
    for i in [None, *range(30)]:
        law = None if i is None else f"L{i % 2}"
        rows += [("violation:block exit", "object:exit", "involve", i, law, 1, 0, 0)]
        if i is not None and i % 3 == 0:
            rows += [("violation:block exit", "penalty:fine", "punish", i, law, 1, 0, 1)]
    edges = spark.createDataFrame(rows, "source string, target string, relation string, item_id int, law string, pass int, pos int, ord int")
    profiles = gx.item_profiles(edges, PACK, 4).collect()
    assert sorted((r["first"], len(r["items"]), len(r["marks"])) for r in profiles) == [(0, 4, 5), (1, 4, 2)]
    nodes = gx.prune_nodes(gx.pack_nodes(spark, PACK), edges)
    q = spark.createDataFrame([(1, "a blocked exit"), (2, "exit")], "query_id int, text string")
    got = sorted((r["query_id"], r["rank"], r["item_id"]) for r in gx.graph_search(q, nodes, edges, PACK, 12).collect())
    with_fine, plain = [i for i in range(30) if i % 3 == 0], [i for i in range(30) if i % 3]
    assert got == [(q, n + 1, i) for q in (1, 2) for n, i in enumerate([*with_fine, *plain][:12])]  # 2: by two bigrams
