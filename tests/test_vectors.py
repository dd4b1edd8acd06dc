"""Content-addressed vector store: how often the model is called, changed texts, compaction."""

import pytest
from pyspark.sql import functions as F

from clausegraph.sources.vectors import VectorStore


@pytest.fixture
def model(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def embed(text):
        calls.add(1)
        return [float(len(text)), float(text.count("e"))]

    return calls, lambda rows: rows.withColumn("vector", embed("text"))


def test_only_new_texts_reach_the_model(spark, tmp_path, model):
    calls, embed = model
    texts = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, None), (5, "")], "id long, text string")
    store = VectorStore(spark, str(tmp_path / "v")).upsert(texts, embed)
    assert calls.value == 3
    again = store.upsert(texts, embed)
    assert calls.value == 3 and again.version == store.version
    changed = texts.withColumn("text", F.when(F.col("id") == 2, "three").otherwise(F.col("text")))
    later = again.upsert(changed, embed)
    assert calls.value == 4 and later.version == 2
    got = {r["id"]: (r["vector"], r["generation"]) for r in later.lookup(changed).collect()}
    assert got == {1: ([3.0, 1.0], 1), 2: ([5.0, 2.0], 2), 3: ([3.0, 1.0], 1), 4: (None, None), 5: ([0.0, 0.0], 1)}
    assert store.lookup(changed).where("id = 2").first()["vector"] is None  # pinned
    packed = later.compact()
    assert len(packed.generations) == 1
    assert {r["id"]: (r["vector"], r["generation"]) for r in packed.lookup(changed).collect()} == got
    assert packed.upsert(texts.unionByName(changed), embed).version == packed.version and calls.value == 4


def test_two_writers_of_one_text(spark, tmp_path, model):
    calls, embed = model
    texts = spark.createDataFrame([(1, "one")], "id long, text string")
    a, b = (VectorStore(spark, str(tmp_path / "v")) for _ in range(2))
    a.upsert(texts, embed)
    both = b.upsert(texts, embed)
    assert len(both.generations) == 2 and both.lookup(texts).count() == 1 and both.compact().rows().count() == 1
    with pytest.raises(FileNotFoundError):
        VectorStore(spark, str(tmp_path / "none")).lookup(texts)
