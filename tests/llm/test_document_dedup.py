"""The pipeline's near copies against brute-force Jaccard similarity of five-word shingles."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from clausegraph.llm import document_dedup, simhash

from test_operators import EDGE, docs, groups, sentence


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [plain_set(t) for _, t, *_ in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group = groups(near, range(len(rows)))
    least = {}
    for i, (key, *_) in enumerate(rows):
        if key is not None:
            least[group[i]] = min(least.get(group[i], key), key)
    return sorted((str(r[0]), r[1] or "") for i, r in enumerate(rows) if r[0] is None or r[0] == least[group[i]])


def changed(rng, text, edits):
    words = text.split()
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("longest", [12, 400])
def test_stage_matches_brute_force(spark, longest):
    rng = random.Random(longest)
    rows = []
    for i in range(60):
        text = " ".join(sentence(rng, 9) for _ in range(rng.randrange(1, max(2, longest // 9))))
        for n in range(6):
            rows.append((1000 * n + i, changed(rng, text, min(len(text.split()), n * len(text.split()) // 120 + n // 3)), "en", "a"))
    rng.shuffle(rows)
    got = corpus_pipeline.remove_near_copies(spark, docs(spark, rows + EDGE), "")
    assert got.columns == docs(spark, rows).columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got.collect()) == brute(rows + EDGE)


def test_language_stage_keeps_every_text_with_letters(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted(r["doc_id"] for r in frame.collect() if any(c.isalpha() for c in r["text"] or ""))
    assert sorted(r["doc_id"] for r in corpus_pipeline.identify_language(spark, frame, "").collect()) == want


def test_a_clean_row_with_a_repeated_key_stays(spark):
    rng = random.Random(2)
    text, other = sentence(rng, 80), sentence(rng, 80)
    rows = [(1, text, "en", "a"), (2, text + " more", "en", "a"), (2, other, "en", "a")]
    left = document_dedup.drop_near_copies(docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == [(1, text), (2, other)]


def test_a_bucket_of_dissimilar_members_gives_no_pairs(spark):
    """2,000 texts that share most of one bucket's signature: the hubs are as many as have a partner, not the pairs."""
    rng = np.random.default_rng(1)
    sigs = rng.integers(0, 256, (2000, 128), np.uint8)
    sigs[:, :4] = 7
    sigs[1990:] = sigs[1990]
    rows = [(1, 0, f"{i:04d}".encode(), 100, sigs[i].tobytes()) for i in range(2000)]
    frame = spark.createDataFrame(rows, "k long, t long, digest binary, n int, sig binary")
    got = document_dedup.bucket_hubs(frame, 0.8).collect()
    assert sorted(bytes(r["digest"]) for r in got) == [f"{i:04d}".encode() for i in range(1990, 2000)]
    assert {bytes(r["hub"]) for r in got} == {b"1990"}


def test_split_buckets_and_hubs_lose_nothing(spark, monkeypatch):
    for name, size in (("CHUNK", 7), ("TEXT_CHUNK", 5), ("SPOKES", 3)):
        monkeypatch.setattr(document_dedup, name, size)
    rng = random.Random(6)
    text = sentence(rng, 150)
    rows = [(i, changed(rng, text, i % 9), "en", "a") for i in range(60)] + [(100 + i, changed(rng, text, 14 + i % 5), "en", "a") for i in range(40)]
    got = document_dedup.drop_near_copies(docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == brute(rows)


def test_signatures_keep_similar_pairs():
    rng = np.random.default_rng(3)
    lost = 0
    for size in [5, 9, 40, 200, 1000] * 200:
        common = rng.integers(0, 2**63, int(np.ceil(size * 0.8)), np.uint64) * np.uint64(2)
        rest = (size - len(common)) // 2
        sets = [np.unique(np.concatenate((common, rng.integers(0, 2**63, rest + (size - len(common)) % 2 * i, np.uint64)))) for i in range(2)]
        least = [document_dedup.signature(s) for s in sets]
        sigs = np.array([(x >> np.uint64(20)).astype(np.uint8) for x in least])
        keys = [set(document_dedup.band_keys(x).tolist()) for x in least]
        lost += not (keys[0] & keys[1]) or not document_dedup.plausible(0, sigs, np.array([len(s) for s in sets]), 0.8)[1]
    assert lost == 0


def test_class_table_on_edge_rows(spark):
    got = document_dedup.near_classes(docs(spark, EDGE)).groupBy("component_id").agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in got) == len(EDGE)
    assert document_dedup.near_classes(docs(spark, EDGE).limit(0)).collect() == []


def test_simhash_links_alone_find_near_copies(spark, monkeypatch):
    """Without any MinHash bucket the fingerprints within 4 bits still join the copies that they reach, and nothing dissimilar."""
    monkeypatch.setattr(document_dedup, "bucket_hubs", lambda rows, threshold: spark.createDataFrame([], "k long, digest binary, hub binary"))
    rng = random.Random(9)
    rows = []
    for i in range(20):
        text = sentence(rng, 600)
        rows += [(i, text, "en", "a"), (100 + i, changed(rng, text, 1), "en", "a"), (200 + i, sentence(rng, 30), "en", "a")]
    got = {r["doc_id"] for r in document_dedup.drop_near_copies(docs(spark, rows)).collect()}
    near = {100 + i for i in range(20) if bin(simhash.fingerprint(rows[3 * i][1]) ^ simhash.fingerprint(rows[3 * i + 1][1])).count("1") <= 4}
    assert len(near) > 10 and got == {r[0] for r in rows} - near


def test_every_simhash_pair_is_compared(spark, monkeypatch):
    """Without MinHash bands: texts of one fingerprint, pairwise similar but unlike the one that stands for it, still find each other."""
    lone = iter(range(10**9))
    monkeypatch.setattr(document_dedup, "band_keys", lambda least: np.array([next(lone)], np.uint64))
    monkeypatch.setattr(document_dedup, "spread_rows", lambda df: df.coalesce(1))  # one counter for all rows
    rng = random.Random(4)
    rows = []
    for i in range(12):
        tail = " ".join(f"t{rng.randrange(10**6)}" for _ in range(60))
        rows += [(i, "x y z " * 150 + tail, "en", "a"), (100 + i, "x y z " * 150 + tail + " more", "en", "a")]
    assert len({simhash.fingerprint(r[1]) for r in rows}) == 1
    got = document_dedup.drop_near_copies(docs(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(12))
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == brute(rows)
