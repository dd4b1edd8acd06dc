import json
import random

from pyspark.sql import functions as F

from clausegraph.operators import dedupe, evaluate as ev, limits
from clausegraph.sources import audit, corpus
from clausegraph.streaming import logs


def brute_limit(rows, limit, seconds):
    accepted, out = {}, {}
    for client, eid, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        past = [t for t in accepted.get(client, []) if at - t < seconds]
        out[eid] = len(past) < limit
        accepted[client] = past + ([at] if out[eid] else [])
    return out


def limit_rows():
    rng = random.Random(3)
    rows, eid = [], 0
    for client in range(4):
        at = 0
        for _ in range(120):
            at += rng.choice([1, 2, 5, 9, 40, 70])
            rows.append((client, eid, at))
            eid += 1
    return rows


def test_rate_limit_fixture_and_brute_force(spark):
    rows = [(9, 1000, 0), (9, 1001, 10), (9, 1002, 20), (9, 1003, 60)]
    for data, limit in ((rows, 2), (limit_rows(), 3)):
        df = spark.createDataFrame(data, "c bigint, e bigint, s bigint").withColumn("ts", F.timestamp_seconds("s")).repartition(5)
        got = {r["e"]: r["accepted"] for r in limits.rate_limit(df, "c", "ts", "e", limit, 60).collect()}
        assert got == brute_limit(data, limit, 60)


def test_trailing_count(spark):
    data = limit_rows()
    df = spark.createDataFrame(data, "c bigint, e bigint, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["e"]: r["n_trailing"] for r in limits.trailing_count(df, "c", "ts", 60, spans=2).collect()}
    want = {e: sum(1 for c2, _, s2 in data if c2 == c and s - 60 <= s2 <= s) for c, e, s in data}
    assert got == want


def near_brute(texts, size, threshold):
    kept = []
    for key, text in texts:
        words = text.split()
        s = {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} or {tuple(words)}
        if not any(len(s & k) / len(s | k) >= threshold for _, k in kept):
            kept.append((key, s))
    return {k for k, _ in kept}


def test_near_dedupe_equals_sequential(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    texts, base = [], [rng.choice(vocabulary) for _ in range(40)]
    for i in range(60):
        words = list(base) if i % 3 == 0 else [rng.choice(vocabulary) for _ in range(40)] if i % 3 == 1 else texts[rng.randrange(len(texts))][1].split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append((i, " ".join(words)))
    df = spark.createDataFrame(texts, "id bigint, text string")
    got = {r["id"] for r in dedupe.near_dedupe(df, "id", threshold=0.7, size=2).where("kept").collect()}
    assert got == near_brute(texts, 2, 0.7)


def test_exact_dedupe_and_fingerprint(spark):
    df = spark.createDataFrame([(1, "消防 法。"), (2, "消防法"), (3, "other")], "id bigint, text string")
    got = {r["kept"]: r["copies"] for r in dedupe.exact_dedupe(df, "id", "id").collect()}
    assert got == {1: 2, 3: 1}
    a = dedupe.corpus_fingerprint(df, "id").first()
    assert a == dedupe.corpus_fingerprint(df.orderBy(F.desc("id")).repartition(3), "id").first()
    assert a != dedupe.corpus_fingerprint(df.where("id < 3"), "id").first()


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (2, 20, 1), (2, 21, 3), (3, 30, 1)], "query_id bigint, item_id bigint, rank bigint")
    gold = spark.createDataFrame([(1, 10), (2, 21), (3, 99)], "query_id bigint, item_id bigint")
    m = ev.hit_mrr(ranked, gold).first()
    assert (m["cases"], round(m["hit1"], 4), round(m["hit3"], 4), round(m["mrr"], 4)) == (3, 0.3333, 0.6667, 0.4444)
    empty = ev.hit_mrr(ranked, gold.limit(0)).first()
    assert (empty["cases"], empty["hit1"], empty["mrr"]) == (0, 0.0, 0.0)


def test_split_is_a_partition(spark):
    df = spark.range(103).select("id", F.when(F.col("id") < 100, "big").otherwise("tiny").alias("s"))
    out = {(r["s"], r["split"]): r["count"] for r in ev.stratified_split(df, "s", "id").groupBy("s", "split").count().collect()}
    assert out[("big", "train")] == 70 and out[("big", "dev")] == 15 and out[("big", "test")] == 15
    assert sum(v for (s, _), v in out.items() if s == "tiny") == 3 and out[("tiny", "test")] >= 1


def test_case_metrics(spark):
    rows = spark.createDataFrame([
        ("law", "law", False, False, "ok 119", "text fine", ["bad"], ["ok", "fine"], True, ["a"], ["a", "b"]),
        ("law", "refuse", False, True, "bad answer", "", ["bad"], ["none"], True, ["z"], ["a"]),
        ("chat", "chat", False, None, "hi", "", [], [], False, [], [])],
        "intent string, want_intent string, refused boolean, should_refuse boolean, answer string, ref_text string, forbidden array<string>,"
        "musts array<string>, has_gold boolean, cited array<string>, ref_items array<string>")
    m = ev.case_metrics(rows).first()
    assert (m["cases"], round(m["route_accuracy"], 4), m["refusal_accuracy"], round(m["severe_error_rate"], 4)) == (3, 0.6667, 0.5, 0.3333)
    assert m["must_conclusion_accuracy"] == 0.5 and m["citation_accuracy"] == 0.5


def test_law_json_roundtrip(spark, tmp_path):
    law = {"law_name": "甲法", "law_abbr": "甲", "effective_date": "", "chapters": [{"chapter_title": "第一章", "articles": [
        {"num": "第一条", "title": "t", "text": "（一）甲。乙"}, {"num": "第一条", "title": "u", "text": "丙"}]}]}
    path = tmp_path / "a.json"
    path.write_text(json.dumps(law, ensure_ascii=False))
    laws = corpus.read_laws(spark, [str(path), str(tmp_path / "missing.json")])
    rows = corpus.articles(laws).collect()
    assert [(r["item_id"], r["text"], r["status"]) for r in rows] == [("甲·第一条", "丙", "现行")]
    assert [r["id"] for r in corpus.chunks(corpus.articles(laws)).collect()] == ["甲·第一条#0"]
    assert corpus.read_laws(spark, [str(tmp_path / "missing.json")]).count() == 0
    corpus.write_laws(laws, str(tmp_path / "out"), minimum=2)
    try:
        corpus.write_laws(laws, str(tmp_path / "no"), minimum=3)
        raise AssertionError("expected a rejection")
    except ValueError:
        pass


def test_markdown(spark):
    text = "# 法\n## 第一章 甲\n第一条 一：\n（一）二\n第二条 三\n四\n---\n## 第二章 乙\n第三条 五"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = [(r["chapter"], r["num"], r["body"]) for r in corpus.parse_markdown(df, "id").orderBy("chapter_no", "article_no").collect()]
    assert got == [("第一章 甲", "第一条", "一：（一）二"), ("第一章 甲", "第二条", "三 四"), ("第二章 乙", "第三条", "五")]


def test_sections(spark):
    body = "内容" * 12
    text = f"前言 1.0.1 {body} 2.1 {body} 3.1.2 短 4.2 {body}"
    got = [r["num"] for r in corpus.parse_sections(spark.createDataFrame([(1, text)], "id int, text string"), "id").orderBy("pos").collect()]
    assert got == ["1.0.1", "4.2"]


def test_html(spark):
    page = "<html><style>x{}</style><body><p>a &amp; b</p><script>no</script><p> c </p><p>end</p></body></html>"
    df = spark.createDataFrame([(page,)], "h string").select(corpus.html_lines("h").alias("a"), corpus.html_lines_sql("h").alias("b"))
    row = df.first()
    assert row["a"] == row["b"] == ["a & b", "c", "end"]
    cut = df.select(corpus.slice_body(F.col("a"), F.lit("c"), F.lit("end")).alias("x"), corpus.slice_body(F.col("a"), F.lit("c"), F.lit("zz")).alias("y")).first()
    assert cut["x"] == ["c"] and cut["y"] is None


def test_audit_log(spark, tmp_path):
    rows = spark.createDataFrame([("2024-05-01T10:00:00", "ip", "q1"), ("2024-05-02T00:00:00", "ip", "q2")], "ts string, client string, question string")
    path = str(tmp_path / "log")
    audit.append_log(rows, path)
    audit.append_log(rows.limit(1), path)
    folder = tmp_path / "log" / "day=20240501"
    (folder / "broken.json").write_text('{"ts": "x"\nnot json\n')
    assert audit.read_day(spark, path, "2024-05-01").count() == 2
    assert audit.read_day(spark, path, "20240601").count() == 0
    assert [r["day"] for r in audit.list_days(spark.read.json(path).select(F.col("day").cast("string"))).collect()] == ["20240502", "20240501"]
    feedback = spark.createDataFrame([("q", "wrong", "", "", "", [str(i) for i in range(20)]), ("q", "other", "", "", "", [])],
                                     "question string, reason string, comment string, answer_preview string, intent string, articles array<string>")
    kept = audit.valid_feedback(feedback, ["wrong"]).collect()
    assert len(kept) == 1 and len(kept[0]["articles"]) == 12


def test_streaming(spark, tmp_path):
    data = limit_rows()
    src = str(tmp_path / "in")
    df = spark.createDataFrame(data, "c bigint, e bigint, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    for low in (0, 800, 1600):  # three micro-batches in time order
        df.where((F.col("s") >= low) & (F.col("s") < low + 800)).coalesce(1).write.mode("append").parquet(src)
    df.where("s >= 2400").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    query = logs.live_rate_limit(stream, "c", "ts", 3, 60).writeStream.format("memory").queryName("limited").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r["c"], r["at"] // 1_000_000, r["accepted"]) for r in spark.sql("select * from limited").collect())
    want = brute_limit(data, 3, 60)
    assert got == sorted((c, s, want[e]) for c, e, s in data)


def test_audit_sink(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("2024-05-01T10:00:00", "a"), ("2024-05-02T10:00:00", "b")], "ts string, client string").write.json(src)
    stream = spark.readStream.schema("ts string, client string").json(src)
    query = logs.audit_sink(stream, out, str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert audit.read_day(spark, out, "20240502", "ts string, client string").count() == 1


def test_final_records(spark):
    rows = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", None), (2, 1, "x", None), (2, 2, None, "done")],
                                 "request_id int, seq int, delta string, final string")
    assert {r["request_id"]: r["content"] for r in logs.final_records(rows).collect()} == {1: "ab", 2: "done"}
