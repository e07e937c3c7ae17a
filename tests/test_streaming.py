import json
import time

from pyspark.sql import functions as F

from corpusloom.streaming import ingest


def drain(writer, where):
    q = writer.option("checkpointLocation", str(where)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_files_update_an_index(spark, tmp_path):
    inbox, table = tmp_path / "in", str(tmp_path / "table")
    for i in "123":
        (inbox / i).mkdir(parents=True)
    assert ingest.live_chunks(spark, table).count() == 0
    schema = "path string, modificationTime timestamp, length long, content binary"
    run = lambda: drain(ingest.index_files(spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(str(inbox)), table, F.regexp_extract("path", "([^/]+)$", 1)), tmp_path / "state")
    live = lambda: {r.heading for r in ingest.live_chunks(spark, table).collect()}
    (inbox / "1" / "a.md").write_text("# A\n" + "alpha " * 20)
    (inbox / "1" / "b.md").write_text("# B\n" + "beta " * 20)
    run()
    assert live() == {"A", "B"}
    time.sleep(1.1)
    (inbox / "2" / "a.md").write_text("# C\n" + "gamma " * 20)
    run()
    assert live() == {"C", "B"}
    run()
    assert live() == {"C", "B"}
    time.sleep(1.1)
    (inbox / "3" / "b.md").write_text("\n")  # what a file held goes when it is emptied
    run()
    assert live() == {"C"}
    assert ingest.live_chunks(spark, table).columns == [f.split()[0] for f in ingest.CHUNKS.split(", ")]


def events(tmp_path, name, rows):
    (tmp_path / "ev").mkdir(exist_ok=True)
    (tmp_path / "ev" / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n{broken\n")


def test_counters_windows_and_streaks(spark, tmp_path):
    row = lambda i, kind, tool=None, hit=None: {"project": 1, "ts": f"2024-01-0{1 + i // 4}T00:00:0{i % 10}", "event_id": i, "kind": kind, "tool": tool, "hit": hit}
    read = lambda: spark.readStream.schema(ingest.EVENTS).option("mode", "DROPMALFORMED").json(str(tmp_path / "ev"))
    events(tmp_path, "1.json", [row(0, "search_result", "search_docs", True), row(1, "failure"), row(2, "failure"), row(3, "search_result", "search_docs", False)])
    drain(ingest.event_counters(read()).writeStream.format("memory").queryName("counted").outputMode("complete"), tmp_path / "c1")
    assert [(r.searches, r.hits, r.misses) for r in spark.table("counted").collect()] == [(2, 1, 1)]
    state = ingest.streaks(read()).writeStream.format("memory").queryName("streaks").outputMode("update")
    drain(state, tmp_path / "c2")
    assert [r.streak for r in spark.table("streaks").collect()] == [2]
    drain(ingest.windowed_hits(read()).writeStream.format("memory").queryName("hits").outputMode("complete"), tmp_path / "c3")
    assert [(r.searches, r.hits) for r in spark.table("hits").collect()] == [(2, 1)]


def test_states_and_rate_limits_as_streams(spark, tmp_path):
    row = lambda i, second, kind: {"project": 1, "ts": f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}", "event_id": i, "kind": kind}
    read = lambda: spark.readStream.schema(ingest.EVENTS).json(str(tmp_path / "ev"))
    events(tmp_path, "1.json", [row(0, 0, "synced"), row(1, 1, "ahead"), row(2, 62, "unknown")])
    limited = lambda: drain(ingest.rate_limited(read()).writeStream.format("memory").queryName("passed").outputMode("append"), tmp_path / "c4")
    limited()
    assert sorted(r.event_id for r in spark.table("passed").collect()) == [0, 2]
    drain(ingest.last_states(read(), F.col("kind")).writeStream.format("memory").queryName("states").outputMode("complete"), tmp_path / "c5")
    assert [r.state for r in spark.table("states").collect()] == ["ahead"]


def test_events_are_appended_to_a_log(spark, tmp_path):
    log = str(tmp_path / "log")
    d = spark.createDataFrame([(1, 10, "x", None, True), (2, 11, "y", "t", None)], "project long, event_id long, kind string, tool string, hit boolean").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    ingest.append_events(d, log)
    ingest.append_events(d.where("project = 1"), log)
    (tmp_path / "log" / "day=2024-01-01" / "more.json").write_text("{broken\n")
    assert ingest.event_log(spark, log).count() == 3
    assert [r.event_id for r in ingest.event_log(spark, log, 2).collect()] == [11]
