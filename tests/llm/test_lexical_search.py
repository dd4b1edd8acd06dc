"""Ranked lexical search against brute force, its bounds and edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from clausegraph.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def plain_search(docs, items, k=10):
    held = [(key, Counter(plain_terms(text))) for key, text in docs]
    held = [(key, c, sum(c.values())) for key, c in held if c]
    count, words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for key, c, n in held:
            m = 10 + (90 * n * count) // words
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in set(plain_terms(text)) if t in c)
            if score > 0:
                found.append((-score, key is None, key or 0))
        out += [(item, rank + 1, None if none else key, -score) for rank, (score, none, key) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def found(docs, items, **options):
    return sorted((tuple(r) for r in lexical_search.search(docs, items, **options).collect()), key=repr)


def test_terms():
    text = "Ab-9 Été, İx\tA_b\x00c€ d{e}~"
    assert [t.decode() for t in lexical_search.terms(text)] == plain_terms(text)
    assert lexical_search.terms(None) == lexical_search.terms(" .,;") == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(docs, items) == want
    assert found(docs, items, most_items=7, most_terms=300) == want  # several passes


def test_edge_rows(spark):
    rows = [(1, "red fox"), (2, "RED fox red"), (3, None), (4, ""), (5, "... --"), (6, "red fox"), (6, "blue"), (None, "red fox"), (7, "fox " * 50_000)]
    asked = [(1, "Red fox!"), (2, None), (3, ""), (4, "unseen"), (1, "blue"), (None, "blue fox")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("ids", F.lit(1))
    items = spark.createDataFrame(asked, "item_id long, text string").withColumn("score", F.lit("x"))
    assert found(docs, items, k=3) == plain_search(rows, asked, 3)
    assert found(docs.limit(0), items) == [] and found(docs, items.limit(0)) == []
    assert lexical_search.search(docs.limit(0), items).columns == ["item_id", "rank", "doc_id", "score"]


def test_ties_by_key(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(500)] + [(1000 + i, "other") for i in range(600)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    assert [r[2] for r in sorted(found(docs.repartition(7), items), key=lambda r: r[1])] == list(range(10))


def test_tree_prunes_and_loses_nothing():
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(400, rng.integers(1, 20), replace=False) // 2 + 200 * (i % 2)) for i in range(3000)]
    rows = [np.unique(r) for r in rows]
    values = [rng.integers(1, 10**6, len(r)) * 5000 for r in rows]
    cuts = np.cumsum([0, *map(len, rows)])
    tree = lexical_search.BallTree(cuts, np.concatenate(rows), np.concatenate(values), 400)
    random.seed(5)
    visited = []
    for _ in range(50):
        query = np.array(sorted(random.sample(range(200), 6)))
        best = []
        visited.append(tree.search(query, best, list(range(3000))))
        scores = [int(v[np.isin(r, query)].sum()) for r, v in zip(rows, values, strict=True)]
        want = sorted((-s, False, i) for i, s in enumerate(scores) if s > 0)[:10]
        assert best == want
    assert np.mean(visited) < 0.7 * len(tree.leaves)
