"""Rounds of the near-copy selection send the sets of their pairs only, and are few."""

import random

from clausegraph.operators import dedupe

from test_jobs import near_brute


def test_sets_outside_the_pairs_stay(spark):
    sets = spark.createDataFrame([(i, list(range(i, i + 10))) for i in range(50)], "id long, s array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 9), (3, 3 + 1)], "a long, b long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = dedupe._similar(pairs, sets, 0.8)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("BroadcastHashJoin") == 2  # both sides of the pairs meet their sets without a shuffle
        assert sorted(map(tuple, found.collect())) == [(1, 2), (3, 4)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_unlike_items_of_a_group_cost_no_round_each(spark, monkeypatch):
    """30 texts that share one passage and little else, between them some near copies."""
    calls, similar = [], dedupe._similar
    monkeypatch.setattr(dedupe, "_similar", lambda *a: calls.append(1) or similar(*a))
    texts = [(i, " ".join([*(f"shared{j}" for j in range(12)), *(f"own{i % 27}x{j}" for j in range(3)), *(["more"] if i > 26 else [])])) for i in range(30)]
    got = dedupe.near_dedupe(spark.createDataFrame(texts, "id bigint, text string"), "id", threshold=0.9, size=1).where("kept").collect()
    assert sorted(r["id"] for r in got) == list(range(27))
    assert len(calls) == 1


def test_both_ways_equal_the_sequential_selection(spark, monkeypatch):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(40)}" for _ in range(30)] for _ in range(6)]
    texts = []
    for i in range(90):
        words = list(base[i % 6])
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(40)}"
        texts.append((i, " ".join(words)))
    df = spark.createDataFrame(texts, "id bigint, text string")
    for pairs in (0, 16):
        monkeypatch.setattr(dedupe, "PAIRS", pairs)
        got = {r["id"] for r in dedupe.near_dedupe(df, "id", threshold=0.7, size=2).where("kept").collect()}
        assert got == near_brute(texts, 2, 0.7)
