"""The same functions on streams: chunks once, sessions as they close."""

import os
import random
from datetime import datetime, timedelta

from cutloom.streaming import ingest, live

T0 = datetime(2024, 1, 1)


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_chunks_once(spark, tmp_path):
    rows = [("a", 1, i, T0 + timedelta(seconds=i)) for i in range(5)]
    for _ in range(2):
        spark.createDataFrame(rows, "asset_id string, chunk int, word_idx int, ts timestamp").write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("asset_id string, chunk int, word_idx int, ts timestamp").parquet(str(tmp_path / "in"))
    drain(ingest.chunks_once(s), "once")
    assert spark.table("once").count() == 5
    t = spark.read.parquet(str(tmp_path / "in"))
    assert ingest.chunks_once(t).count() == 5
    assert ingest.new_chunks(t, t.filter("chunk = 1")).count() == 0


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    at = [0, 1, 2, 5, 6, 100, 5000]
    spark.createDataFrame([("a", T0 + timedelta(seconds=x)) for x in at], "asset_id string, ts timestamp").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("asset_id string, ts timestamp").parquet(str(tmp_path / "in"))
    drain(ingest.sessions(s, "asset_id", 3000, "10 seconds"), "closed")
    closed = sorted(((r.start - T0).total_seconds(), (r.end - T0).total_seconds(), r.n) for r in spark.table("closed").collect())
    assert closed == [(0, 6, 5), (100, 100, 1)]
    both = ingest.sessions(spark.read.parquet(str(tmp_path / "in")), "asset_id", 2000)
    assert sorted(((r.start - T0).total_seconds(), r.n) for r in both.collect()) == [(0, 3), (5, 2), (100, 1), (5000, 1)]


def test_live_segments_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(2)
    words = []
    for asset in range(4):
        at = 0
        for i in range(120):
            at += rng.choice([0, 100, 799, 800, 801, 2500]) * 1000
            end = at + rng.choice([20, 90, 300]) * 1000
            words.append((asset, i, f"w{i}", at, end, None if i % 9 == 0 else i, T0 + timedelta(microseconds=at)))
            at = end
    schema = "asset_id long, word_idx int, word string, start_us long, end_us long, conf_milli int, ts timestamp"
    words.sort(key=lambda w: (w[6] - T0).total_seconds() + rng.uniform(0, 8))  # chunks up to 8 s out of order
    chunks = [words[i : i + 60] + words[max(0, i - 5) : i] for i in range(0, len(words), 60)]  # some words come twice
    chunks.append([(99, 0, "end", 0, 1, 1, T0 + timedelta(hours=9))])
    for n, chunk in enumerate(chunks):
        spark.createDataFrame(chunk, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n:03}"))
        for f in (tmp_path / f"in/{n:03}").glob("part*"):
            os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    drain(live.live_segments(s, "10 seconds"), "live")
    names = ["asset_id", "start_us", "end_us", "n_words", "text", "first_idx", "last_idx", "mean_conf", "seg_id"]
    want = live.live_segments(spark.createDataFrame(words, schema)).select(*names).collect()
    got = spark.table("live").select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 60
    assert sorted(r.seg_id for r in got if r.asset_id == 1) == list(range(1, 1 + sum(r.asset_id == 1 for r in got)))


def test_a_late_word_joins_what_stood_apart(spark, tmp_path):
    schema = "asset_id long, word_idx int, word string, start_us long, end_us long, conf_milli int, ts timestamp"
    at = lambda i, s: (1, i, f"w{i}", s * 1000, (s + 400) * 1000, 5, T0 + timedelta(milliseconds=s))
    for n, rows in enumerate([[at(0, 0), at(2, 1500)], [at(1, 800)], [at(9, 60_000)], [at(10, 61_000)], [at(3, 2000)]]):  # the last one is too late
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        for f in (tmp_path / f"in/{n}").glob("part*"):
            os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    drain(live.live_segments(s, "5 seconds"), "late")
    assert [(r.first_idx, r.last_idx, r.text) for r in spark.table("late").collect()] == [(0, 2, "w0 w1 w2")]
