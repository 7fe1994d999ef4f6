"""Streaming operators give what the batch ones give, over two micro-batches."""

import datetime

import pytest
from pyspark.sql import functions as F

from strandlore.operators import lifecycle, observability
from strandlore.streaming import operators as S


@pytest.fixture(scope="module")
def halves(spark, sf, tmp_path_factory):
    """``events`` in two files by time, so that a stream reads them in order."""
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    middle = events.selectExpr("percentile_approx(unix_timestamp(ts), 0.5)").first()[0]
    path = str(tmp_path_factory.mktemp("events"))
    early = F.unix_timestamp("ts") <= middle
    for rows in (events.where(early), events.where(~early)):
        rows.coalesce(1).write.mode("append").parquet(path)
    return events, path


def run(spark, df, mode, tmp_path, name):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def stream(spark, halves):
    events, path = halves
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_access_counters(spark, halves, tmp_path):
    out = run(spark, S.access_counters(stream(spark, halves), "user_id", "ts"), "update", tmp_path, "acc")
    last = {r.user_id: tuple(r) for r in out.orderBy("access_count").collect()}
    want = {r.user_id: tuple(r) for r in lifecycle.access_records(halves[0], "user_id", "ts").collect()}
    assert last == want


def test_idempotent_puts(spark, halves, tmp_path):
    doubled = stream(spark, halves).select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("again"))
    out = run(spark, S.idempotent_puts(doubled, "event_id", "ts"), "append", tmp_path, "puts")
    assert out.count() == halves[0].count()


def test_windowed_histogram(spark, halves, tmp_path):
    out = run(spark, S.windowed_histogram(stream(spark, halves), "event_type", "value", "ts"), "append", tmp_path, "hist")
    got = {(r.window_start, r.event_type, r.bucket): r.n for r in out.collect()}
    rows = halves[0].groupBy(F.date_trunc("day", "ts").alias("d"), "event_type", observability.bucket(F.col("value")).alias("b")).count().collect()
    want = {(r.d, r.event_type, r.b): r["count"] for r in rows}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) > 0.8 * len(want)


def test_zero_streaks(spark, halves, tmp_path):
    active = F.col("event_type") == "purchase"
    out = run(spark, S.zero_streaks(stream(spark, halves).select("user_id", "event_id", active.alias("on")), "user_id", "event_id", "on", 3), "update", tmp_path, "streaks")
    got = {}
    for r in out.collect():
        got.setdefault(r.user_id, []).append(r.streak)
    middle = halves[0].selectExpr("percentile_approx(unix_timestamp(ts), 0.5)").first()[0]
    late = (F.unix_timestamp("ts") > middle).cast("int")
    for r in halves[0].select("user_id", F.struct(late.alias("half"), "event_id", active.alias("on")).alias("e")).groupBy("user_id").agg(F.array_sort(F.collect_list("e")).alias("es")).collect():
        streak = 0
        for e in r.es:
            streak = 0 if e.on else streak + 1
        assert streak in got[r.user_id] and len(got[r.user_id]) <= 2


def test_heartbeats_time_out(spark, tmp_path):
    path = str(tmp_path / "beats")
    day = "2024-01-01 00:0"
    for rows in ([("a", f"{day}0:00"), ("b", f"{day}0:00")], [("b", f"{day}5:00")], [("b", f"{day}5:30")]):
        spark.createDataFrame(rows, "node string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)
    beats = spark.readStream.schema("node string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    out = run(spark, S.heartbeats(beats, "node", "ts"), "update", tmp_path, "hb").collect()
    assert ("a", "unreachable") in {(r.node, r.status) for r in out}
    assert [r.status for r in out if r.node == "b"].count("alive") == 3


def test_chunk_accumulator(spark, tmp_path):
    path, kind = str(tmp_path / "data"), "k string, n int, data binary, ts timestamp"
    at = lambda minute: datetime.datetime(2024, 1, 1, 0, minute)
    for rows in ([("k", 1, b"abcdefg", at(0)), ("j", 1, b"xy", at(0))], [("k", 2, b"hij", at(1))], [("z", 1, b"012", at(9))], [("z", 2, b"345", at(20))], [("z", 3, b"", at(30))]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    data = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)
    out = run(spark, S.chunk_accumulator(data, "k", "n", "data", 3, "ts"), "append", tmp_path, "chunks").collect()
    whole = {k: b"".join(bytes(r.chunk) for r in sorted(out, key=lambda r: r.ordinal) if r.k == k) for k in "jkz"}
    assert whole == {"k": b"abcdefghij", "j": b"xy", "z": b"012345"} and all(len(r.chunk) <= 3 for r in out)


def test_flush_latest(spark, halves, tmp_path):
    query = S.flush_latest(stream(spark, halves), str(tmp_path / "out"), ["user_id"], ["ts", "event_id"], str(tmp_path / "cp"))
    query.awaitTermination(120)
    stored = spark.read.parquet(str(tmp_path / "out"))
    got = {r.user_id: r.event_id for r in lifecycle.latest_wins(stored, ["user_id"], ["ts", "event_id"]).collect()}
    assert got == {r.user_id: r.event_id for r in lifecycle.latest_wins(halves[0], ["user_id"], ["ts", "event_id"]).collect()}
