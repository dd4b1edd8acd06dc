"""Streams in event-time order: rows out of order, two events at one time, late rows, a client that owns most events."""

import random

from pyspark.sql import functions as F

from clausegraph.streaming import ordered


def run(spark, tmp_path, name, batches, schema, build):
    src = str(tmp_path / name)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(src)
        if i == 0:
            kind = spark.read.parquet(src).schema
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(src)
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return [tuple(r) for r in spark.sql(f"select * from {name}").collect()]


def brute(rows, limit, width):
    accepted, out = {}, {}
    for client, event, s in sorted(rows, key=lambda r: (r[2], len(str(r[1])), str(r[1]))):
        held = [t for t in accepted.get(client, []) if s - t < width]
        out[event] = len(held) < limit
        accepted[client] = [*held, s] if out[event] else held
    return out


def test_rate_limit_in_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(1 if rng.random() < 0.8 else rng.randint(2, 5), i, 1000 + i // 2) for i in range(300)]  # two events at one time, one client has most
    batches = []
    for at in range(0, 300, 60):  # out of order within the delay
        part = rows[at: at + 60]
        rng.shuffle(part)
        batches.append(part)
    batches.append([(9, 900, 2000)])  # moves the watermark
    batches.append([(1, 901, 1001), (9, 902, 3000)])  # 901 is late
    batches.append([(9, 903, 4000)])
    got = run(spark, tmp_path, "ordered_limit", batches, "c bigint, e bigint, s bigint", lambda s: ordered.rate_limit_in_order(s, "c", "ts", "e", 3, 20, "40 seconds"))
    want = brute(rows, 3, 20)
    assert {int(e): a for c, e, _, a in got if int(e) < 300} == want
    assert "901" not in {e for _, e, *_ in got}  # behind the watermark
    assert {e for _, e, *_ in got} >= {"900", "902"} and len(got) == len({e for _, e, *_ in got})


def test_followups_in_order(spark, tmp_path):
    batches = [[("a", 2, 20, "second"), ("a", 1, 10, "first")], [("b", 1, 30, "other"), ("a", 3, 25, None)], [("z", 1, 500, "x")], [("z", 2, 900, "y")]]
    got = run(spark, tmp_path, "ordered_turns", batches, "c string, n bigint, s bigint, text string", lambda s: ordered.followups_in_order(s, "c", "ts", "n", delay="15 seconds"))
    assert {(c, e): p for c, e, _, p in got if c != "z"} == {("a", "1"): None, ("a", "2"): "first", ("a", "3"): "second", ("b", "1"): None}
