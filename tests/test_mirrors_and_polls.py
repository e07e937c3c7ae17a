"""Mirrored summaries over restarts, and folders that are polled."""

import os
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import maintained
from corpusloom.streaming import mirrors, polling

EVENT = "project long, ts timestamp, event_id long, kind string, tool string, hit boolean, found int, blocking int, fixed int"


@pytest.fixture
def stream(spark, tmp_path):
    """Runs what there is of events below tmp_path/ev through a mirror that waits `gap` seconds."""
    few = {"spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k) for k in few}
    for k, v in few.items():
        spark.conf.set(k, v)
    n = [0]

    def put(*rows):
        (tmp_path / "ev").mkdir(exist_ok=True)
        d = spark.createDataFrame([(p, None, i, kind, tool, hit, *more) for p, i, kind, tool, hit, *more in rows], EVENT)
        n[0] += 1
        d.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).coalesce(1).write.json(f"{tmp_path}/ev/{n[0]}")

    def run(gap, checkpoint="c"):
        read = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").json(f"{tmp_path}/ev")
        q = mirrors.mirrored_summaries(read, f"{tmp_path}/mirror", gap).option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(processingTime="200 milliseconds").start()
        try:  # timers keep such a query going; what there is has been read when rows have come and a batch has ended
            for _ in range(240):
                if any(x["numInputRows"] for x in q.recentProgress):
                    break
                assert q.exception() is None
                time.sleep(0.25)
        finally:
            q.stop()
        return {r.project: r for r in mirrors.mirrors(spark, f"{tmp_path}/mirror").collect()}

    yield put, run
    for k, v in before.items():
        spark.conf.set(k, v)


def call(project, i, tool):
    return (project, i, "tool_call", tool, None, None, None, None)


def test_counters_go_on_and_mirrors_wait(spark, stream, tmp_path):
    put, run = stream
    put(call(1, 1, "search_docs"), call(1, 2, "write_api_doc"), call(2, 3, "search_bugfixes"), (1, 4, "search_result", "search_docs", False, None, None, None), (1, 5, "guardrail_report", None, None, 4, -2, 1))
    one = run(3600)
    assert (one[1].total_calls, one[1].searches, one[1].writes, one[1].misses, one[1].reports, one[1].found, one[1].blocking, one[1].fixed, one[1].last_tool) == (2, 1, 1, 1, 1, 4, 0, 1, "write_api_doc")
    assert one[2].bugfix_searches == 1
    put(call(1, 6, "search_docs"))
    assert run(3600)[1].searches == 1  # within the gap nothing is mirrored
    put(call(1, 7, "save_session_summary"), call(3, 8, "write_bugfix_summary"))
    later = run(0)  # a restarted stream goes on with its counters
    assert (later[1].searches, later[1].session_saves, later[1].total_calls) == (2, 1, 4)
    assert later[2].bugfix_searches == 1 and later[3].bugfix_writes == 1


def test_a_lost_state_is_found_in_the_mirror(spark, stream, tmp_path):
    put, run = stream
    zeros = {f: 0 for f in mirrors.FIELDS}
    spark.createDataFrame([(1, 5, *(zeros | {"searches": 999}).values(), "x"), (2, 5, *(zeros | {"searches": 42}).values(), None)], mirrors.MIRRORED).write.json(f"{tmp_path}/mirror/writer=old/batch=0")
    put(call(1, 1, "search_docs"))
    got = run(0, "new")
    assert got[1].searches == 1000 and got[2].searches == 42
    put(call(1, 2, "search_docs"), call(2, 3, "search_docs"))
    got = run(0, "new")  # the state wins over the mirror from now on
    assert (got[1].searches, got[2].searches) == (1001, 43)
    mirrors.reset(spark, f"{tmp_path}/mirror", 2, 10**14)
    assert {r.project: r.searches for r in mirrors.mirrors(spark, f"{tmp_path}/mirror").collect()} == {1: 1001, 2: 0}


def body(name):
    return f"# {name}\n{name} has some text that is long enough for one chunk of an index"


def test_a_polled_folder(spark, tmp_path):
    folder, path = tmp_path / "docs", str(tmp_path / "index")
    (folder / "api").mkdir(parents=True)
    for n in ("a.md", "api/b.md", "c.txt", "skip.bin", ".hidden.md"):
        (folder / n).write_text(body(n))
    sources = lambda: {r.source for r in maintained.opened(spark, path).payload.select("source").collect()}
    first = polling.poll(spark, str(folder), path).first()
    assert (first.files_seen, first.files_new) == (3, 3) and sources() == {"a.md", "api/b.md", "c.txt"}
    os.remove(folder / "api/b.md")
    (folder / "a.md").write_text(body("other"))
    later = time.time() + 5
    os.utime(folder / "a.md", (later, later))
    second = polling.poll(spark, str(folder), path).first()
    assert (second.files_modified, second.files_unchanged, second.files_removed) == (1, 1, 1) and sources() == {"a.md", "c.txt"}
    last = maintained.current(spark, path).segments[-1]
    assert {r.path for r in spark.read.parquet(f"{path}/segments/{last}/files").collect()} == {"a.md", "api/b.md"}
    assert polling.poll(spark, str(folder), path).first().version == 2
    for n in ("a.md", "c.txt"):
        os.rename(folder / n, tmp_path / n)
    os.remove(folder / "skip.bin")
    assert polling.poll(spark, str(folder), path).first().files_removed == 0 and sources() == {"a.md", "c.txt"}  # an empty folder empties nothing


def test_polls_by_a_clock(spark, tmp_path):
    folder, path = tmp_path / "docs", str(tmp_path / "index")
    folder.mkdir()
    (folder / "a.md").write_text(body("a"))
    q = polling.every(spark, str(folder), path, 1).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(120):
            if maintained.current(spark, path).number:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert maintained.current(spark, path).number == 1
