import os
import shutil

from pyspark.sql import functions as F

from marlstone.streaming import events as ev

DATA = "/root/testdata/sf0.001/events.parquet"


def split_files(spark, tmp_path):
    src = spark.read.parquet(DATA)
    folder = tmp_path / "in"
    for k in range(3):  # in time order, as a log arrives
        src.filter((F.col("event_id") >= k * 400) & (F.col("event_id") < (k + 1) * 400)).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    folder.mkdir()
    for k in range(3):
        part = next((tmp_path / f"part{k}").glob("part-*.parquet"))
        shutil.copy(part, folder / f"{k}.parquet")
        os.utime(folder / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))  # the source reads files in order of their times
    return str(folder), src


def through_memory(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    folder, src = split_files(spark, tmp_path)
    batch, stream = ev.derived(src), ev.derived(ev.source(spark, folder))
    assert sorted(map(str, through_memory(spark, stream, "derived", "append").collect())) == sorted(map(str, batch.collect()))
    days = through_memory(spark, ev.by_day(stream), "days", "complete")
    assert sorted(map(str, days.collect())) == sorted(map(str, ev.by_day(batch).collect()))
    rates = through_memory(spark, ev.rate(stream), "rates", "complete")
    assert sorted(map(str, rates.collect())) == sorted(map(str, ev.rate(batch).collect()))
    sessions = through_memory(spark, ev.sessions(stream), "sessions", "complete")
    assert sorted(map(str, sessions.collect())) == sorted(map(str, ev.sessions(batch).collect()))


def test_duplicates_go_once(spark, tmp_path):
    folder, src = split_files(spark, tmp_path)
    shutil.copy(f"{folder}/2.parquet", f"{folder}/3.parquet")
    stream = ev.once(ev.derived(ev.source(spark, folder)))
    ev.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == src.count()


def test_reservoir_state(spark, tmp_path):
    folder, src = split_files(spark, tmp_path)
    table = through_memory(spark, ev.last_values(ev.derived(ev.source(spark, folder)), 50), "last", "update")
    finals = {r["kind"]: r for r in table.orderBy("n").collect()}
    counts = {r["event_type"]: r["count"] for r in src.groupBy("event_type").count().collect()}
    assert all(finals[k]["n"] == min(50, n) and finals[k]["p50"] <= finals[k]["p95"] for k, n in counts.items())
