"""The best items of a question by products of postings and weights: equal to the join, without a row per posting and question."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausegraph.operators import lexical as lx, ranking
from clausegraph.operators.scale import top_per_key
from clausegraph.sources.index import StoredIndex

WORDS = ["the", "fire", "door", "bike", "le", "und", "ñ"]


def text(seed, size):
    return " ".join(WORDS[(seed * 7 + i * i * (seed % 5 + 1)) % len(WORDS)] for i in range(size)) + ". " + WORDS[seed % 7] + " the"


def ranked(scores, k, keys):
    return sorted(map(tuple, top_per_key(scores, keys, [F.col("raw").desc(), F.col("item_id").asc()], k).select(*keys, "item_id", "raw").collect()), key=repr)


@pytest.mark.parametrize("item", ["long", "string"])
def test_best_items_equal_the_join(spark, monkeypatch, item):
    monkeypatch.setattr(ranking, "WIDTH", 3)
    monkeypatch.setattr(ranking, "KEPT", 5)
    rows = [(i % 50 if i % 9 else None, text(i % 40, 3 + i % 11), "en" if i % 3 else "fr") for i in range(120)]  # repeated and null keys, copies
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("doc_id", F.col("doc_id").cast(item))
    units = lx.tokenized(lx.explode_units(docs, "doc_id", "text", F.col("lang"), ".")).repartition(5)
    asked = spark.createDataFrame([(q, f"{text(q, 2 + q % 4)} fire fire") for q in range(8)] + [(None, "bike the"), (3, "le"), (9, None), (10, "absent")],
                                  "query_id long, text string")
    for by_part in (False, True):
        keys = ["query_id", *(["part"] if by_part else [])]
        own = units if by_part else units.withColumn("part", F.lit("all"))
        whole = lx.bm25_scores(own, asked, by_part=by_part)
        assert ranked(lx.bm25_scores(own, asked, by_part=by_part, k=4), 4, keys) == ranked(whole, 4, keys)
    # slices of the questions give the same
    own = units.withColumn("part", F.lit("all"))
    assert ranked(lx.bm25_scores(own, asked, broadcast_rows=20, k=4), 4, ["query_id"]) == ranked(lx.bm25_scores(own, asked), 4, ["query_id"])
    assert sorted(map(tuple, lx.tfidf_search(own, asked, 4).collect()), key=repr) == sorted(map(tuple, lx.tfidf_search(own, asked, 4, broadcast_rows=0).collect()), key=repr)


def test_no_row_per_posting_and_question(spark):
    docs = spark.createDataFrame([(i, text(i, 9)) for i in range(40)], "doc_id long, text string")
    units = lx.tokenized(lx.explode_units(docs, "doc_id", "text", delimiters="."))
    asked = spark.createDataFrame([(q, "the fire door und le bike") for q in range(30)], "query_id long, text string")
    found = lx.bm25_search(units, asked, 3)
    assert "MapInArrow" in found._jdf.queryExecution().toString()  # products of postings and weights, not a join with the questions
    assert found.count() == 90


def test_a_product_takes_a_cell_per_hit(monkeypatch):
    """200 questions, of which each token is asked by few: cells are postings times the questions that ask them, and blocks change nothing."""
    rng = np.random.default_rng(2)
    tokens, columns = rng.integers(0, 300, 2000), np.repeat(np.arange(200), 10)
    tokens, columns = np.unique(np.stack([tokens, columns]), axis=1)
    values = rng.random(len(tokens))
    weights = ranking.Weights(tokens, columns, values, np.arange(200))
    asked, x = rng.integers(0, 400, 3000), rng.random(3000)
    units = np.r_[0, np.sort(rng.choice(np.arange(1, 3000), 400, replace=False))]
    items = np.r_[0, np.sort(rng.choice(units[1:], 90, replace=False))]
    want = np.zeros((len(items), 200))
    table = np.zeros((400, 200))
    table[tokens, columns] = values
    for a, b in zip(units, [*units[1:], 3000]):
        row = np.searchsorted(items, a, side="right") - 1
        want[row] = np.maximum(want[row], np.floor(table[asked[a:b]] * x[a:b, None] * float(ranking.SCALE) + 0.5).sum(0))
    taken, sums = [], ranking.Weights._sums
    monkeypatch.setattr(ranking.Weights, "_sums", staticmethod(lambda head, count, *rest: taken.append(count.sum()) or sums(head, count, *rest)))
    assert (weights.products(asked, x, units, items) == want).all()
    assert sum(taken) == (table[asked] > 0).sum() < 3000 * 200 / 20
    monkeypatch.setattr(ranking, "SUMS", 400)
    monkeypatch.setattr(ranking, "HITS", 30)
    assert (weights.products(asked, x, units, items) == want).all()


def test_a_block_keeps_its_best_only():
    best = ranking._Best(3, 5, pa.int64())
    best.add("all", pa.chunked_array([pa.array(range(1000))]), np.arange(1.0, 5001).reshape(1000, 5))
    assert best.size == 15
    assert sorted(best.result()["item_id"].to_pylist()) == sorted([997, 998, 999] * 5)


def test_sums_below_the_floor_are_left_out_and_the_others_exact():
    rng = np.random.default_rng(5)
    pairs = np.unique(np.stack([rng.integers(0, 60, 3000), rng.integers(0, 300, 3000)]), axis=1)
    groups = np.sort(rng.integers(0, 90, 300))
    groups = np.unique(groups, return_inverse=True)[1]
    weights = ranking.Weights(pairs[0], pairs[1], rng.random(pairs.shape[1]) + 0.01, groups)
    tokens, x = np.where(rng.random(4000) < 0.6, rng.integers(0, 4, 4000), rng.integers(0, 70, 4000)), rng.random(4000)
    units = np.r_[0, np.sort(rng.choice(np.arange(1, 4000), 500, replace=False))]
    whole = weights.products(tokens, x, units, units)
    for share in (0.0, 0.5, 0.99):
        floor = np.maximum(1, np.quantile(whole, share, axis=0, method="higher"))  # sums at the floor itself count
        unit, group, score = weights.reaching(tokens, x, units, floor)
        got = np.zeros_like(whole)
        np.maximum.at(got, (unit, group), score)
        assert (got == np.where(whole >= floor, whole, 0)).all()
        assert share < 0.9 or len(unit) < whole.size / 20


@pytest.mark.parametrize("by_part", [False, True])
def test_units_of_an_index_are_scored_where_they_lie(spark, tmp_path, monkeypatch, by_part):
    """Repeated and null ids, copies and several lengths of a unit; the postings neither cross the network nor are written."""
    monkeypatch.setattr(ranking, "FIRST", 3)
    rows = [(i % 50 if i % 9 else None, text(i % 40, 3 + i % 11), "en" if i % 3 else "fr") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    units = lx.tokenized(lx.explode_units(docs, "doc_id", "text", F.col("lang"), ".")).repartition(5)
    asked = spark.createDataFrame([(q, f"{text(q, 2 + q % 4)} fire fire") for q in range(8)] + [(None, "bike the"), (9, None), (10, "absent")], "query_id long, text string")
    small = StoredIndex(spark, str(tmp_path / "s")).append(units)
    assert not small.in_all_buckets(lx.query_terms(asked))
    index = StoredIndex(spark, str(tmp_path / "i")).append(units, buckets=2)
    keys = ["query_id", *(["part"] if by_part else [])]
    whole = ranked(lx.bm25_scores(small, asked, by_part=by_part), 4, keys)
    found = lx.bm25_scores(index, asked, by_part=by_part, k=4)
    assert ranked(found, 4, keys) == whole == ranked(lx.bm25_scores(small, asked, by_part=by_part, k=4), 4, keys)
    if not by_part:
        tfidf = [sorted(map(tuple, lx.tfidf_search(i, asked, 4).collect()), key=repr) for i in (index, small)]
        assert tfidf[0] == tfidf[1]
    assert not list(tmp_path.glob("i/segments/*/inverted")) and list(tmp_path.glob("s/segments/*/inverted"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(item_id" not in plan and "unit_no" not in "".join(line for line in plan.split("\n") if "Exchange" in line)
