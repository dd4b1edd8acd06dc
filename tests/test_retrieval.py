import math

import numpy as np
from pyspark.sql import functions as F

from clausegraph.operators import dense, fusion, lexical as lx, lexicon, rerank as rr
from clausegraph.operators.scale import bucketed_lag, order_statistics, salted_join


def units(spark, rows):
    return lx.tokenized(spark.createDataFrame(rows, "part string, item_id bigint, unit_no int, unit string"))


def questions(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, text string")


def test_bm25_formula(spark):
    u = units(spark, [("all", 1, 0, "a b"), ("all", 2, 0, "a c")])
    got = {r["item_id"]: r["raw"] / 1e9 for r in lx.bm25_scores(u, questions(spark, [(1, "b")])).collect()}
    assert list(got) == [1] and abs(got[1] - math.log(2)) < 1e-8
    got = {r["item_id"]: r["raw"] / 1e9 for r in lx.bm25_scores(u, questions(spark, [(1, "b b")])).collect()}
    assert abs(got[1] - 2 * math.log(2)) < 1e-8


def test_bm25_same_result_without_broadcast(spark):
    rows = [("all", i % 7, i, f"w{i % 5} common w{i % 3} x") for i in range(60)]
    q = questions(spark, [(1, "w1 common"), (2, "w2 x x"), (3, "nothing")])
    a = lx.bm25_search(units(spark, rows), q, 5).collect()
    b = lx.bm25_search(units(spark, rows), q, 5, broadcast_rows=0).collect()
    assert sorted(a) == sorted(b) and {r["query_id"] for r in a} == {1, 2}
    assert all(r["score"] == 1.0 for r in a if r["rank"] == 1)


def test_tfidf_paths_agree(spark):
    rows = [("all", i % 9, i, f"w{i % 5} common w{i % 3} x{i}") for i in range(80)]
    q = questions(spark, [(1, "w1 common"), (2, "w2 x7 x7")])
    plain = lx.tfidf_search(units(spark, rows), q, 5).collect()
    split = lx.tfidf_search(units(spark, rows), q, 5, broadcast_rows=10, hot_df=30).collect()
    assert sorted(plain) == sorted(split) and len(plain) == 10


def test_two_index_gate(spark):
    u = units(spark, [("core", 1, 0, "fire door"), ("special", 2, 0, "fire bike"), ("special", 3, 0, "fire hall")])
    laws = spark.createDataFrame([(1, "core"), (2, "bike"), (3, "hall")], "item_id bigint, law string")
    out = lx.bm25_two_index_search(u, questions(spark, [(1, "fire bike"), (2, "fire door")]), [("bike", "bike")], 5, laws)
    got = {(r["query_id"], r["item_id"]) for r in out.collect()}
    assert got == {(1, 1), (1, 2), (2, 1)}


def test_dense_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    vectors = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id bigint, embedding array<double>")
    q = vectors.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), "embedding")
    for block in (1024, 15):
        got = {(r["query_id"], r["rank"]): r["vec_id"] for r in dense.dense_search(vectors.repartition(5), q, 4, block=block).collect()}
        for i in range(20):
            best = sorted(range(300), key=lambda j: (-round(float(v[i] @ v[j]) * 1e9), j))[:4]
            assert [got[(i, k)] for k in range(1, 5)] == best


def channel(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, channel string, item_id bigint, score double, path string")


def test_rrf(spark):
    rows = [(1, c, 7, 1.0, None) for c in ("bm25", "vector", "graph")]
    rows += [(2, "bm25", 7, 1.0, None), (2, "bm25", 8, 0.5, None), (2, "vector", 9, 1.0, None), (2, "graph", 10, 1.0, "p")]
    got = {(r["query_id"], r["item_id"]): r["retrieval_score"] for r in fusion.rrf(channel(spark, rows)).collect()}
    assert abs(got[(1, 7)] - 1.0) < 1e-12
    assert abs(got[(2, 7)] - 0.42) < 1e-12 and abs(got[(2, 8)] - 0.42 * 61 / 62) < 1e-12


def test_rrf_without_graph_rows_renormalises(spark):
    got = fusion.rrf(channel(spark, [(1, "bm25", 7, 1.0, None)])).first()
    assert abs(got["retrieval_score"] - 0.42 / 0.75) < 1e-12 and got["bm25_share"] == 1.0 and not got["graph_hit"]


def test_demote_and_inject(spark):
    pool = spark.createDataFrame([(1, 5, 0.5, True), (1, 6, 0.5, False)], "query_id bigint, item_id bigint, retrieval_score double, d boolean")
    pool = fusion.demote(pool, F.col("d"))
    assert {r["item_id"]: r["retrieval_score"] for r in pool.collect()} == {5: 0.31, 6: 0.5}
    forced = spark.createDataFrame([(1, 5), (1, 9)], "query_id bigint, item_id bigint")
    got = {r["item_id"]: (r["retrieval_score"], r["cite_inject"]) for r in fusion.inject(pool.drop("d"), forced).collect()}
    assert got == {5: (0.98, True), 6: (0.5, False), 9: (0.98, True)}


def test_coverage_and_rules(spark):
    c = spark.createDataFrame([(1, 1, "abcd", "ab", "xxabc", "L", 0.5)],
                              "query_id bigint, item_id bigint, query_text string, title string, body string, law string, retrieval_score double")
    r = rr.rerank(c, [{"q_all": ["ab"], "text_any": ["abc"], "delta": 0.1}, {"q_any": ["zz"], "delta": 1.0}]).first()
    # grams of abcd: ab bc cd abc bcd abcd; body+title "abxxabc" has ab bc abc
    assert abs(r["coverage"] - 3 / 6) < 1e-12 and abs(r["title_coverage"] - 1 / 6) < 1e-12
    assert abs(r["rerank_score"] - (0.62 * 0.5 + 0.18 * 0.5 + 0.2 / 6 + 0.1)) < 1e-12


def test_contains_join_paths(spark):
    texts = spark.createDataFrame([(i, f"alpha{i} beta gam{i % 3}") for i in range(30)], "id bigint, text string")
    terms = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha1", "beta", "gam2", "zzz", "lpha", "a1 b"])], "term_id bigint, term string")
    a = {(r["id"], r["term_id"]) for r in lexicon.contains_join(texts, terms).collect()}
    b = {(r["id"], r["term_id"]) for r in lexicon.contains_join(texts, terms, chunk=4).collect()}
    want = {(i, j) for i in range(30) for j, t in enumerate(["alpha1", "beta", "gam2", "zzz", "lpha", "a1 b"]) if t in f"alpha{i} beta gam{i % 3}"}
    assert a == b == want


def test_matcher_native_and_automaton(spark):
    df = spark.createDataFrame([("one two",), ("three",), (None,)], "t string")
    small = lexicon.PhraseMatcher(["one", "two", "hre"])
    big = lexicon.PhraseMatcher(["one", "two", "hre"] + [f"pad{i}" for i in range(400)])
    for m in (small, big):
        got = [r["h"] for r in m.annotate(df, "t").select(m.any_of(["two", "hre"]).alias("h")).collect()]
        assert got == [True, True, False]


def test_salted_join(spark):
    big = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("k"))
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, v string")
    assert salted_join(big, small, ["k"]).count() == big.join(small, "k").count()


def test_order_statistics(spark):
    rows = [("a", v) for v in [4, 1, 3, 2]] + [("b", v) for v in [7] * 50 + [1, 9]] + [("c", 5)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    for buckets in (2, 4096):
        got = {r["k"]: r["v"] for r in order_statistics(df, ["k"], "v", F.floor(F.col("n") / 2), buckets).collect()}
        assert got == {"a": 3, "b": 7, "c": 5}
    total = order_statistics(df, [], "v", F.floor(F.col("n") / 2)).first()["v"]
    assert total == sorted(v for _, v in rows)[len(rows) // 2]


def test_bucketed_lag(spark):
    df = spark.createDataFrame([(1, t, f"t{t}") for t in (0, 3, 9, 10, 40)], "c bigint, t bigint, x string")
    got = {r["t"]: r["prev_x"] for r in bucketed_lag(df, "c", F.col("t"), ["x"], F.floor(F.col("t") / 5)).collect()}
    assert got == {0: None, 3: "t0", 9: "t3", 10: "t9", 40: "t10"}
