"""Stored index and published snapshots: pruning, appends, tombstones, variants, two writers at once."""

import re
import threading

import pytest
from pyspark.sql import functions as F

from clausegraph.functions import text as tx
from clausegraph.operators import lexical as lx
from clausegraph.sources import snapshots
from clausegraph.sources.index import StoredIndex, bucket_of

SF = "/root/testdata/sf0.001"


def units(docs, tokenizer=tx.words):
    part = F.when(F.col("lang") == "en", "core").otherwise("special")
    return lx.tokenized(lx.explode_units(docs, "doc_id", "text", part, tx.LATIN_DELIMITERS), tokenizer)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").repartition(4).cache()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


def rows(df):
    return sorted(map(tuple, df.collect()))


def plain(docs, asked, **kw):
    return rows(lx.bm25_search(units(docs).withColumn("part", F.lit("all")), asked, 5, **kw))


def test_index_answers_like_a_pass_over_the_text(spark, docs, asked, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "i")).append(units(docs), files=2)
    assert rows(lx.bm25_search(index, asked, 5)) == plain(docs, asked)
    by_part = rows(lx.bm25_scores(index, asked, by_part=True))
    assert by_part == rows(lx.bm25_scores(units(docs), asked, by_part=True))
    features = StoredIndex(spark, str(tmp_path / "f")).append(units(docs, tx.mixed_features))
    assert rows(lx.tfidf_search(features, asked, 5)) == rows(lx.tfidf_search(units(docs, tx.mixed_features), asked, 5))


def test_appends_replacements_and_removals_equal_a_rebuild(spark, docs, asked, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "i"))
    old = docs.withColumn("text", F.concat("text", F.lit(" more words of before")))
    first = index.append(units(old.where("doc_id % 3 < 2")))
    second = first.append(units(docs.where("doc_id % 3 = 2")))
    third = second.append(units(docs.where("doc_id % 3 = 0"))).remove(docs.where("doc_id % 3 = 1").select(F.col("doc_id").alias("item_id")))
    left = docs.where("doc_id % 3 != 1")
    want = plain(left, asked)
    assert rows(lx.bm25_search(third, asked, 5)) == want
    packed = third.compact()
    assert [s["kind"] for s in packed.content["segments"]] == ["rows"]
    assert rows(lx.bm25_search(packed, asked, 5)) == want
    whole = packed.append(units(docs.where("doc_id % 3 = 1")))
    assert rows(lx.bm25_search(whole, asked, 5)) == plain(docs, asked)
    # pinned objects keep their version
    assert rows(lx.bm25_search(first, asked, 5)) == plain(old.where("doc_id % 3 < 2"), asked)
    assert StoredIndex(spark, str(tmp_path / "i"), second.version).content == second.content


def test_only_the_asked_buckets_are_read(spark, docs, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "i")).append(units(docs))
    tokens = spark.createDataFrame([("the",), ("und",)], "token string")
    want = {r["b"] for r in tokens.select(bucket_of(F.col("token"), index.buckets).alias("b")).collect()}
    found = index.postings(tokens)
    plan = found._jdf.queryExecution().toString()
    pruned = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert pruned and all("bucket" in p and {int(n) for n in re.findall(r"\b\d{1,2}\b", p)} == want for p in pruned)
    assert found.where("token = 'the'").count() == units(docs).select(F.explode(F.array_distinct("tokens")).alias("t")).where("t = 'the'").count()


def test_a_posting_meets_a_question_once_for_all_variants(spark, docs, asked):
    synonyms = [("the ", "thereof tion"), ("with", "avec mit con"), ("une", "des les")]
    variants = lx.expand_queries(asked, synonyms)
    got = rows(lx.bm25_search(units(docs), variants, 5, parts=1))
    best = {}
    for v in range(4):
        one = variants.where(F.col("variant") == v).drop("variant")
        for q, i, raw in rows(lx.bm25_scores(units(docs), one, parts=1)):
            best[q, i] = max(raw, best.get((q, i), 0))
    want = []
    for q in {q for q, _ in best}:
        top = sorted(((-raw, i) for (k, i), raw in best.items() if k == q))[:5]
        want += [(q, i, -raw / -top[0][0], r + 1) for r, (raw, i) in enumerate(top)]
    assert got == sorted(want)
    terms = lx.query_terms(variants)
    assert lx.variant_slots(terms, 4).count() == terms.select("query_id", "token").distinct().count()


def test_an_empty_index_says_so(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        StoredIndex(spark, str(tmp_path / "none")).units()


def test_two_writers_leave_one_valid_line_of_versions(spark, tmp_path):
    folder = str(tmp_path / "s")
    errors = []

    def write(name):
        try:
            for i in range(4):
                snapshots.publish(spark, folder, {f"{name}{i}": spark.range(i + 1)})
        except Exception as error:  # shown below
            errors.append(error)

    threads = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    versions = snapshots.Versions(spark, folder)
    assert versions.numbers() == list(range(1, 9))
    assert sorted(snapshots.open_snapshot(spark, folder)) == sorted(f"{n}{i}" for n in "ab" for i in range(4))
    pinned = snapshots.open_snapshot(spark, folder, 1)
    assert len(pinned) == 1 and next(iter(pinned.values())).count() == 1


def test_build_if_absent_builds_once(spark, tmp_path):
    folder = str(tmp_path / "b")
    calls = []

    def build():
        calls.append(1)
        return {"rows": spark.range(3)}

    assert snapshots.build_if_absent(spark, folder, build) == snapshots.build_if_absent(spark, folder, build) == 1
    assert len(calls) == 1 and snapshots.open_snapshot(spark, folder)["rows"].count() == 3
    with pytest.raises(FileNotFoundError):
        snapshots.open_snapshot(spark, folder, 7)


def test_hidden_items_build_no_table_on_the_driver(spark, docs, tmp_path, monkeypatch):
    """Readers of the live rows share one array of hidden ids; a null key hides nothing; too many ids are joined by shuffle."""
    lone = docs.limit(5).withColumn("doc_id", F.lit(None).cast("bigint"))
    index = StoredIndex(spark, str(tmp_path / "i")).append(units(docs.unionByName(lone)))
    index = index.append(units(docs.where("doc_id % 2 = 0"))).remove(docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("item_id")))
    live = index.forward()
    assert "Broadcast" not in live._jdf.queryExecution().executedPlan().toString()
    got = sorted(str(r["item_id"]) for r in live.select("item_id").distinct().collect())
    assert got == sorted([str(r["doc_id"]) for r in docs.where("doc_id % 5 > 0").select("doc_id").distinct().collect()] + ["None"])
    assert len(index._hidden) == 2  # one of the first segment, one of the second
    want = rows(live.select(F.coalesce("item_id", F.lit(-1)), "unit_no"))
    monkeypatch.setattr("clausegraph.sources.index.BROADCAST_ROWS", 3)
    assert rows(StoredIndex(spark, index.folder).forward().select(F.coalesce("item_id", F.lit(-1)), "unit_no")) == want


def test_cosine_reads_the_units_once_to_count_and_once_to_weigh(spark, docs, asked, tmp_path, monkeypatch):
    index = StoredIndex(spark, str(tmp_path / "f")).append(units(docs, tx.mixed_features))
    n, seen, forward = index.forward().count(), spark.sparkContext.accumulator(0), StoredIndex.forward

    def counted(self):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        rows = forward(self)
        return rows.mapInArrow(run, rows.schema)

    monkeypatch.setattr(StoredIndex, "forward", counted)
    got = rows(lx.tfidf_search(index, asked, 5))
    assert got == rows(lx.tfidf_search(units(docs, tx.mixed_features), asked, 5))
    assert seen.value <= 5 * n
