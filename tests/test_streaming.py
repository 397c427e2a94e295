import datetime as dt
import random

from sonolith import streaming

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, ts timestamp"


def brute(rows, gap):
    out = []
    for user in sorted({r[1] for r in rows}):
        times = sorted(r[2] for r in rows if r[1] == user)
        first, last, n = times[0], times[0], 0
        for t in times:
            if t >= last + gap and n:
                out.append((user, first, last + gap, n))
                first, n = t, 0
            last, n = t, n + 1
        out.append((user, first, last + gap, n))
    return sorted(out)


def events(n=300):
    rng = random.Random(3)
    return [(i, rng.randrange(4), START + dt.timedelta(minutes=rng.randrange(20_000))) for i in range(n)]


def test_sessions_of_a_batch(spark):
    rows = events()
    got = streaming.sessions(spark.createDataFrame(rows, SCHEMA), "user_id", "ts").collect()
    assert sorted(tuple(r) for r in got) == brute(rows, dt.timedelta(hours=2))
    assert streaming.sessions(spark.createDataFrame([], SCHEMA), "user_id", "ts").collect() == []


def test_appended_once(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows = events(60)
    run = lambda checkpoint: streaming.appending(
        streaming.stream(spark, folder, spark.createDataFrame([], SCHEMA).schema), path, ("event_id",), str(tmp_path / checkpoint)
    ).awaitTermination(120)
    spark.createDataFrame(rows[:40], SCHEMA).write.parquet(folder)
    assert run("c")
    spark.createDataFrame(rows[30:], SCHEMA).write.mode("append").parquet(folder)
    assert run("c")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == rows
    assert run("lost")  # a stream without its checkpoint reads all files again
    assert spark.read.parquet(path).count() == len(rows)


def test_closed_sessions_of_a_stream(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows = events()
    run = lambda: streaming.appending(
        streaming.sessions(streaming.stream(spark, folder, spark.createDataFrame([], SCHEMA).schema), "user_id", "ts"), path, ("user_id", "start"),
        str(tmp_path / "c"),
    ).awaitTermination(120)
    spark.createDataFrame(rows, SCHEMA).write.parquet(folder)
    assert run()
    # A row far ahead moves the watermark past all others; one behind it is late and changes nothing.
    ahead = (9_000, 9, START + dt.timedelta(days=60))
    spark.createDataFrame([ahead], SCHEMA).write.mode("append").parquet(folder)
    assert run()
    spark.createDataFrame([(9_001, 0, START)], SCHEMA).write.mode("append").parquet(folder)
    assert run()
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == brute(rows, dt.timedelta(hours=2))
