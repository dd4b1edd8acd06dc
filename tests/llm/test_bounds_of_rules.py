"""Vectors of few dimensions and long url rules."""

import numpy as np
from pyspark.sql import functions as F

from clausegraph.llm import embedding_dedup, url_filter

from test_operators import groups


def test_vectors_of_one_to_three_dimensions(spark):
    rng = np.random.default_rng(5)
    rows = [(1000 * d + i, rng.standard_normal(d).tolist()) for d in (1, 2, 3) for i in range(25)]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    links = [(a, b) for a in unit for b in unit if a < b and a // 1000 == b // 1000 and float(unit[a] @ unit[b]) >= 0.95]
    want = groups(links, unit)
    got = {r["vec_id"]: r["component_id"] for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_rules_of_four_tokens_are_mined(spark):
    parts = ("a", "b", "c", "d")
    rows = []
    for i in range(320):
        held = [p for n, p in enumerate(parts) if i >> n & 1]
        rows.append((held + ([url_filter.BAD] if len(held) == 4 else []),))
    rules = url_filter.mine(spark.createDataFrame(rows, "items array<string>").where(F.size("items") > 0), 0.01, 0.9).collect()
    assert [(sorted(r["tokens"]), r["confidence"]) for r in rules] == [(["a", "b", "c", "d"], 1.0)]
