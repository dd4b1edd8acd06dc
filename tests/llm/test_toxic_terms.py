"""Toxicity by the cosine over all terms of the examples."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from clausegraph.llm import toxicity

from test_operators import docs, sentence


def test_every_term_counts(spark):
    """A copy of a labelled example finds it, though no term of it tells the labels apart."""
    rng = random.Random(4)
    learned = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"{sentence(rng, 30)} own{chr(97 + i % 26)}{chr(97 + i // 26)}", "en", "a") for i in learned]
    labels = spark.createDataFrame([(i, 1, int(n % 6 == 0)) for n, i in enumerate(learned)], "doc_id long, quality int, toxic int")
    copies = [(i + 10_000, t, "en", "a") for i, t, *_ in rows]
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs(spark, rows + copies), labels).collect()}
    for i in learned:
        first = got[i + 10_000]["evidence"][0]
        assert first["id"] == i and abs(first["cosine"] - 1) < 1e-6


def plain_nearest(model, row, k):
    """By all examples, one after the other."""
    own = dict(zip(row[0].tolist(), row[1].tolist(), strict=True))
    scores = [sum(own.get(c, 0.0) * v for c, v in zip(columns.tolist(), values.tolist(), strict=True)) for columns, values in model.rows]
    order = sorted((i for i, s in enumerate(scores) if s > 0), key=lambda i: (-round(scores[i], 12), i))[:k]
    return order, [scores[i] for i in order]


def test_pruned_search_equals_full_search_and_leaves_blocks_out():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    counts = [{w: 1 + rng.randrange(3) for w in rng.sample(words[40 * (i // 100): 40 * (i // 100) + 80], 25)} for i in range(900)]
    model = toxicity.Examples(list(range(900)), np.array([i % 2 for i in range(900)]), counts, {0: 1.0, 1: 1.0})
    model.scored = model.offered = 0
    for row in [model.vector(c) for c in counts[::7]]:
        at, best = model.nearest(*row, 25)
        want = plain_nearest(model, row, 25)
        assert at.tolist() == want[0] and np.allclose(best, want[1])
    assert model.scored < 0.7 * model.offered


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.1"
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    known = labels.where(toxicity.held_out("doc_id") & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    got = toxicity.score(frame.join(known, "doc_id", "left_semi"), toxicity.fit(frame, labels)).join(known, "doc_id").select("score", "toxic").collect()
    bad, good = ([r["score"] for r in got if r["toxic"] == y] for y in (1, 0))
    assert len(bad) > 80 and len(good) > 600
    auc = sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / len(bad) / len(good)
    assert auc >= 0.95
    assert sum(a > sorted(good)[int(0.9 * len(good))] for a in bad) / len(bad) >= 0.9
