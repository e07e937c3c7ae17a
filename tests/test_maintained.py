"""The kept index: equal to a fresh one after any history, only changed files read, versions whole or not there."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import classify, maintained, search

SIGNED = maintained.Model("signed", classify.BUCKETS, lambda texts, postings: classify.signed_terms(postings))


def body(name, words="plain words about nothing in particular"):
    return f"# {name}\n{words} {name} and more of the same text to fill a chunk of some length"


def tree(spark, **texts):
    return spark.createDataFrame([(f"{k}.md", v) for k, v in texts.items()] or None, "path string, text string") if texts else spark.createDataFrame([], "path string, text string")


def snapshot(spark, path, k=5):
    index = maintained.opened(spark, path)
    q = spark.createDataFrame([(1, "alpha words"), (2, "gamma delta text"), (3, "words")], "qid int, text string")
    vec = search.hashed_embedding(search.postings(q, "qid", "text")).select(F.col("id").alias("qid"), "vec")
    return {
        "chunks": sorted(map(tuple, index.payload.select("id", "source", "text").collect())),
        "terms": sorted(map(tuple, index.terms.collect())),
        "stats": index.stats.first().asDict(),
        "bm25": sorted(map(tuple, search.top(search.bm25(index, q), k).select("qid", "id", "score", "rank").collect())),
        "near": sorted(map(tuple, search.top(search.nearest(index, vec, k), k, "similarity").select("qid", "id", "similarity").collect())),
    }


@pytest.fixture
def path(spark, tmp_path):
    """Where an index goes. Its tables are tiny here: one partition, planned once."""
    few = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in few}
    for k, v in few.items():
        spark.conf.set(k, v)
    yield str(tmp_path / "index")
    for k, v in before.items():
        spark.conf.set(k, v)


FIRST = {"a": body("Alpha"), "b": body("Beta"), "c": body("Gamma"), "tests/bad": "# no sections\nat all, though long enough to be a chunk of its own"}
SECOND = {"a": body("Alpha"), "b": body("Delta", "other"), "d": body("Alpha"), "tests/bad": FIRST["tests/bad"]}


def test_after_updates_it_equals_a_fresh_one(spark, path, tmp_path):
    one = maintained.update(tree(spark, **FIRST), path).first()
    assert (one.files_new, one.files_rejected, one.chunks_added, one.version) == (3, 1, 3, 1)
    two = maintained.update(tree(spark, **SECOND), path).first()
    assert two.asDict() == {"files_seen": 4, "files_new": 1, "files_modified": 1, "files_unchanged": 1, "files_rejected": 1, "files_removed": 1, "chunks_added": 2, "chunks_removed": 2, "version": 2}
    maintained.update(tree(spark, **SECOND), str(tmp_path / "fresh"))
    fresh = snapshot(spark, str(tmp_path / "fresh"))
    assert snapshot(spark, path) == fresh and fresh["stats"]["n_docs"] == 3
    v = maintained.compact(spark, path)
    assert len(v.segments) == 1 and v.n_dead == 0 and snapshot(spark, path) == fresh
    back = maintained.update(tree(spark, **FIRST), path).first()
    assert (back.files_new, back.files_modified, back.files_removed) == (1, 1, 1)
    maintained.update(tree(spark, **FIRST), str(tmp_path / "first"))
    assert snapshot(spark, path) == snapshot(spark, str(tmp_path / "first"))
    assert snapshot(spark, path)["terms"] == sorted(t for t in snapshot(spark, path)["terms"] if t[1] > 0)


def test_only_changed_files_are_read_on(spark, path):
    maintained.update(tree(spark, **FIRST), path)
    maintained.update(tree(spark, **SECOND), path)
    last = maintained.current(spark, path).segments[-1]
    seg = lambda name: spark.read.parquet(f"{path}/segments/{last}/{name}")
    assert {r.path for r in seg("files").collect()} == {"b.md", "c.md", "d.md"}
    assert {r.source for r in seg("chunks").collect()} == {"b.md", "d.md"}
    assert {r.id for r in seg("postings").collect()} == {r.id for r in seg("vectors").collect()} == {r.id for r in seg("chunks").collect()}
    same = maintained.update(tree(spark, **SECOND), path).first()
    assert same.version == 2 and same.chunks_added == 0  # nothing changed, no new version
    assert maintained.update(tree(spark, **SECOND), path, force=True).first().files_unchanged == 3
    assert len(maintained.current(spark, path).segments) == 3


def test_rejected_files_keep_their_reasons_and_come_back(spark, path):
    maintained.update(tree(spark, **FIRST), path)
    state = {r.path: (r.rejected, r.reasons) for r in maintained.states(spark, path).collect()}
    assert state["tests/bad.md"] == (True, "missing section Expected Result; missing section Scenario; missing section Steps")
    good = "# T\n## Scenario\nwhen it is used by someone who waits\n## Steps\ndo all of them, one by one, in order\n## Expected Result\nit works as it did before this test"
    r = maintained.update(tree(spark, **(FIRST | {"tests/bad": good})), path).first()
    assert (r.files_new, r.files_rejected, r.chunks_removed) == (1, 0, 0)
    r = maintained.update(tree(spark, **FIRST), path).first()
    assert r.files_rejected == 1 and r.chunks_removed > 0
    assert {c.source for c in maintained.opened(spark, path).payload.collect()} == {"a.md", "b.md", "c.md"}


def test_nothing_found_empties_nothing_and_clear_does(spark, path):
    assert maintained.update(tree(spark), path).first().files_seen == 0
    maintained.update(tree(spark, **FIRST), path)
    before = snapshot(spark, path)
    r = maintained.update(tree(spark), path).first()
    assert (r.files_removed, r.chunks_removed) == (0, 0) and snapshot(spark, path) == before
    maintained.clear(spark, path)
    assert maintained.opened(spark, path).payload.count() == 0 and maintained.states(spark, path).count() == 0
    maintained.update(tree(spark, **FIRST), path, SIGNED)
    assert maintained.opened(spark, path).payload.count() == 3


def test_odd_rows(spark, path):
    rows = [("a.md", body("Alpha")), ("a.md", body("Alpha")), ("a.md", body("Beta")), (None, body("Gamma")), ("n.md", None), ("e.md", ""), ("two.md", body("X") + "\n" + body("X"))]
    files = spark.createDataFrame(rows, "path string, text string").withColumns({c: F.lit("own") for c in ("segment", "id", "content_md5", "change", "rejected")})
    r = maintained.update(files, path).first()
    assert r.files_seen == 3
    chunks = maintained.opened(spark, path).payload.collect()
    assert len({c.id for c in chunks}) == len(chunks) and {c.source for c in chunks} == {"a.md", "two.md"}
    again = maintained.update(files.repartition(5), path).first()  # of repeated paths the same one counts
    assert again.chunks_added == 0


def test_a_run_that_fails_leaves_the_version_before(spark, path):
    maintained.update(tree(spark, **FIRST), path)
    before = snapshot(spark, path)

    def broken(texts, postings):
        raise OSError("model is gone")

    with pytest.raises(OSError):
        maintained.update(tree(spark, **SECOND), path, maintained.Model("hashed-terms", search.BUCKETS, broken))
    assert maintained.current(spark, path).number == 1 and snapshot(spark, path) == before
    assert maintained.update(tree(spark, **SECOND), path).first().version == 2


def test_of_two_writers_the_second_fails(spark, path):
    maintained.update(tree(spark, **FIRST), path)
    v = maintained.current(spark, path)
    maintained._commit(spark, path, v, list(v.segments), None, v.n_chunks, v.n_dead, "first")
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        maintained._commit(spark, path, v, list(v.segments), None, v.n_chunks, v.n_dead, "second")


def test_old_versions_can_be_read(spark, path):
    maintained.update(tree(spark, **FIRST), path)
    old, v = snapshot(spark, path), maintained.current(spark, path)
    maintained.update(tree(spark, **SECOND), path)
    index = maintained.opened(spark, path, v)
    assert sorted(map(tuple, index.payload.select("id", "source", "text").collect())) == old["chunks"]
    assert sorted(map(tuple, index.terms.collect())) == old["terms"]
    assert maintained.versions(spark, path).count() == 2


def test_a_model_is_changed_beside_the_index(spark, path):
    maintained.update(tree(spark, **FIRST), path)
    before = snapshot(spark, path)
    assert maintained.rebuild_status(spark, path, SIGNED).first().status == "idle"
    calls = []

    def embed(texts, postings):
        calls.append(1)
        if len(calls) == 2:  # during the second step the index answers, changes, and the rebuild is asked to end
            assert snapshot(spark, path) == before
            maintained.update(tree(spark, **SECOND), path)
            maintained.cancel(spark, path, model)
        return SIGNED.embed(texts, postings)

    model = maintained.Model("signed", classify.BUCKETS, embed)
    v = maintained.rebuild(spark, path, model, steps=4)
    assert v.model == "hashed-terms" and len(calls) == 2
    s = maintained.rebuild_status(spark, path, model).first()
    assert s.asDict() == {"model": "signed", "status": "cancelled", "steps_done": 2, "steps": 4, "percent": 50}
    with pytest.raises(ValueError):
        maintained.update(tree(spark, **SECOND), path, model)
    v = maintained.rebuild(spark, path, model, steps=9)  # goes on with the two steps that are left, and what came late
    assert v.model == "signed" and len(calls) == 5
    assert maintained.rebuild_status(spark, path, model).first().status == "done"
    index = maintained.opened(spark, path)
    want = {r.id: r.vec for r in classify.signed_embedding(index.payload, "id", "text").collect()}
    assert {r.id: r.vec for r in index.vectors.collect()} == want and len(want) == 3
    maintained.update(tree(spark, **FIRST), path, model)
    assert maintained.opened(spark, path).payload.count() == 3


def test_a_killed_rebuild_goes_on(spark, path):
    maintained.update(tree(spark, **FIRST), path)
    calls = []

    def dies(texts, postings):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("killed")
        return SIGNED.embed(texts, postings)

    with pytest.raises(OSError):
        maintained.rebuild(spark, path, maintained.Model("signed", classify.BUCKETS, dies), steps=3)
    assert maintained.current(spark, path).model == "hashed-terms"
    assert maintained.rebuild_status(spark, path, SIGNED).first().percent == 67
    assert maintained.rebuild(spark, path, SIGNED).model == "signed"


def test_dimensions_are_checked_and_healed(spark, path):
    maintained.update(tree(spark, **FIRST), path)
    before = snapshot(spark, path)
    short = maintained.Model("short", 3, lambda texts, postings: texts.select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("vec")))
    with pytest.raises(RuntimeError):
        maintained.rebuild(spark, path, short, steps=2)
    assert snapshot(spark, path) == before
    three = maintained.Model("three", 3, lambda texts, postings: texts.select("id", F.array(*[F.lit(float(k)) for k in range(3)]).alias("vec")))
    assert {len(r.vec) for r in maintained.healed(spark, path, three).vectors.collect()} == {3}
    assert [tuple(r) for r in maintained.stored_dimensions(spark, path).collect()] == [(3, 3)]
    n = maintained.current(spark, path).number
    maintained.healed(spark, path, three)
    assert maintained.current(spark, path).number == n


def test_texts_of_files_stay_where_they_are(spark, path, monkeypatch):
    """Files are picked by digests: no join or distinct has their texts, unless a path comes twice or digests are too many."""
    rows = [(f"{k}.md", v, v[:3]) for k, v in (FIRST | {"e": body("Alpha")}).items()]
    files = spark.createDataFrame(rows, "path string, text string, content_md5 string").repartition(3)
    wanted = files.where("path IN ('a.md', 'b.md')").select("path", "content_md5")
    moved = lambda d: "Exchange hash" in d._jdf.queryExecution().executedPlan().toString()
    for every, part in ((True, files), (False, wanted)):
        got = maintained._picked(files, part.select("path", "content_md5"), every)
        assert sorted(r.path for r in got.collect()) == sorted(r.path for r in part.collect()) and not moved(got)
    assert sorted(r.path for r in maintained._picked(files.unionByName(files), wanted, False).collect()) == ["a.md", "b.md"]
    left = maintained._without(files, wanted.select("path"))
    assert sorted(r.path for r in left.collect()) == ["c.md", "e.md", "tests/bad.md"] and not moved(left)
    monkeypatch.setattr(maintained, "is_small", lambda d, width: False)
    assert sorted(r.path for r in maintained._picked(files, wanted, False).collect()) == ["a.md", "b.md"]
    assert left.count() == maintained._without(files, wanted.select("path")).count()
