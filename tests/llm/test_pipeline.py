"""The pipeline's stages against brute force, one after the other."""

from collections import Counter, defaultdict

import corpus_pipeline
from clausegraph.llm.queries import QUERIES

from test_document_dedup import brute
from test_operators import DOCS, EDGE, docs

SF = "/root/testdata/sf0.001"


def test_registered_queries():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))


def test_stages(spark, tmp_path):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    columns = frame.columns
    rows = frame.collect()
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, SF)
        out.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        after = frame.collect()
        if number < 4:
            assert frame.columns == columns
        if name == "language_id":
            assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in rows if any(c.isalpha() for c in r["text"] or ""))
        elif name == "exact_dedup":
            keep = defaultdict(int)
            for r in rows:
                t = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
                keep[t] = max(keep[t], r["doc_id"])
            assert {r["doc_id"] for r in after} == set(keep.values()) and len(after) == len(keep)
        elif name == "simhash_near_dedup":
            assert sorted((str(r["doc_id"]), r["text"]) for r in after) == brute([(r["doc_id"], r["text"]) for r in rows])
        elif name == "source_mix":
            size = {r["doc_id"]: len(r["text"].split()) for r in rows}
            taken = Counter()
            for r in after:
                taken[r["doc_id"]] += len(r["text"].split())
            assert all(taken[i] <= 2 * size[i] for i in taken)
            assert abs(sum(taken.values()) / sum(size.values()) - 1.5) < 0.02
        else:
            assert len(after) == len(rows) and all(r["exact"] for r in after)
            assert Counter((r["doc_id"], r["decoded"]) for r in after) == Counter((r["doc_id"], r["text"]) for r in rows)
        rows = after


def kept(frame):
    return sorted((str(r["doc_id"]), r["text"] or "") for r in frame.select("doc_id", "text").collect())


def test_stages_on_edge_rows(spark):
    rows = docs(spark, EDGE)
    language, copies, near, mix, tokens = (stage for _, stage in corpus_pipeline.STAGES)
    assert kept(language(spark, rows, SF)) == sorted((str(i), t) for i, t, *_ in EDGE if any(c.isalpha() for c in t or ""))
    plain = defaultdict(list)
    for i, t, *_ in EDGE:
        plain[(t or "").lower() if (t or "").isascii() else t].append(i)
    assert sorted(k for k, _ in kept(copies(spark, rows, SF))) == sorted(str(max((i for i in g if i is not None), default=None)) for g in plain.values())
    assert kept(near(spark, rows, SF)) == brute(EDGE)
    size = Counter()
    for i, t, *_ in EDGE:
        size[str(i)] += len((t or "").split())
    taken = Counter()
    for i, t in kept(mix(spark, rows, SF)):
        taken[i] += len(t.split())
    assert all(taken[i] <= 2 * size[i] for i in taken) and sum(taken.values()) > 0
    out = tokens(spark, rows, SF).collect()
    assert sorted((str(r["doc_id"]), r["decoded"] or "") for r in out) == kept(rows)
    assert all(r["exact"] for r in out)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows.limit(0), SF).collect() == []
    assert corpus_pipeline.STAGES[0][1](spark, spark.createDataFrame([], DOCS), SF).columns == spark.createDataFrame([], DOCS).columns
