"""Cell searches against brute force, and injected models."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import maintained, neighbours, scorers, search


def clustered(n=1200, dim=12, groups=24, seed=3):
    r = np.random.default_rng(seed)
    c = r.normal(size=(groups, dim))
    return c[r.integers(groups, size=n)] + 0.25 * r.normal(size=(n, dim))


def brute(rows, queries, k):
    out = {}
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for qid, q in queries:
        hits = sorted((-(math.floor(float(unit(q) @ unit(v)) * 1e6 + 0.5) / 1e6), i) for i, v in rows if i != qid)
        out[qid] = [i for _, i in hits[:k]]
    return out


@pytest.mark.parametrize("part", [4096, 40])
def test_cell_search(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(neighbours, "PART", part)
    monkeypatch.setattr(neighbours, "QUERY_PART", 4)
    x = clustered()
    x[100:500] = x[7]  # one vector holds a third of all rows
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "id long, vec array<double>").withColumns({c: F.lit("own") for c in ("cell", "part", "parts", "q", "nth")})
    index = neighbours.build(d.repartition(5), str(tmp_path / "cells"), 20)
    assert index.rows.count() == len(rows)
    largest = index.rows.groupBy("cell", "part").count().agg(F.max("count")).first()[0]
    assert largest < 3 * part
    asked = [(i, v) for i, v in rows if i % 50 == 0]
    q = spark.createDataFrame(asked, "qid long, vec array<double>")
    whole = neighbours.nearest(index, q, 5, None, others=True).collect()
    want = brute(rows, asked, 5)
    assert {qid: [r.id for r in sorted(whole, key=lambda r: r["rank"]) if r.qid == qid] for qid in want} == want
    probes = neighbours.probes_for(index, 5, 0.95)
    assert 1 <= probes < 20
    found = neighbours.nearest(neighbours.opened(spark, str(tmp_path / "cells")), q, 5, probes, others=True)
    got = neighbours.recall(found, spark.createDataFrame([(a, b) for a, ids in want.items() for b in ids], "qid long, id long")).first()
    assert got.n_queries == len(asked) and got.recall >= 0.9
    # only the cells that are opened are read
    plan = neighbours.nearest(index, q.where("qid = 0"), 5, 1)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\n]*cell#\d+ (=|IN) ", plan)


def test_odd_vectors(spark, tmp_path):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0]), (None, [1.0, 0.1]), (8, [None, 1.0])]
    d = spark.createDataFrame(rows, "id long, vec array<double>")
    index = neighbours.build(d, str(tmp_path / "a"), 3)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (9, [0.0, 2.0]), (10, None), (11, [1.0, 2.0, 3.0])], "qid long, vec array<double>")
    got = neighbours.nearest(index, q, 3, None, others=True).collect()
    assert sorted((r.qid, str(r.id), r.similarity) for r in got if r.qid == 9) == [(9, "2", 1.0), (9, "2", 1.0), (9, "None", 0.099504)]
    assert {r.id for r in got if r.qid == 1} == {None, 2} and {r.qid for r in got} == {1, 9}
    none = neighbours.build(d.where("false"), str(tmp_path / "b"))
    assert neighbours.nearest(none, q, 3).collect() == [] and neighbours.probes_for(none, 5) == 0


def points(name="points-8", dim=8):
    def load():
        return lambda texts: [[float(ord(c)) for c in t[:8].ljust(8, "\0")] for t in texts]

    return scorers.Embedder(name, dim, load)


def test_an_embedder_is_injected(spark, tmp_path):
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(["abc", None, "", "é" * 20])], "id long, text string")
    got = {r.id: r.vec for r in points().embed(texts.repartition(3)).collect()}
    assert got == {0: [97.0, 98.0, 99.0, 0, 0, 0, 0, 0], 1: [0.0] * 8, 2: [0.0] * 8, 3: [233.0] * 8}
    with pytest.raises(Exception, match="gave 4 vectors"):
        points("wrong", 7).embed(texts.coalesce(1)).collect()
    assert points().embed(texts.where("false")).collect() == []


def test_a_kept_index_uses_an_injected_model(spark, tmp_path):
    path = str(tmp_path / "index")
    body = lambda n: f"# {n}\n{n} has some text that is long enough for one chunk"
    files = spark.createDataFrame([(f"{n}.md", body(n)) for n in ("Alpha", "Beta", "Gamma")], "path string, text string")
    maintained.update(files, path, points().model)
    index = maintained.opened(spark, path)
    q = spark.createDataFrame([(1, body("Beta"))], "qid long, text string")
    embed = lambda t: points().embed(t)
    first = search.hybrid(index, q, 1, embed=embed).first()
    assert first.source == "Beta.md" and first.relevance > 90


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    marks = str(tmp_path)

    def load():
        import uuid

        open(f"{marks}/{uuid.uuid4()}", "w").close()
        return lambda texts: [[1.0] for _ in texts]

    texts = spark.range(0, 400, 1, 40).selectExpr("id", "'x' AS text")
    one = scorers.Embedder(f"once-{marks}", 1, load, 3)
    assert one.embed(texts).count() == 400 and one.embed(texts).count() == 400
    assert 1 <= len(list(tmp_path.iterdir())) <= 8  # workers, not the 80 tasks


def test_reranking(spark):
    pool = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "b", "xx"), (1, 3, "c", "xxx"), (2, 1, "d", "only"), (3, 1, "e", "s"), (3, 2, "f", "s")], "qid int, rank int, id string, text string")
    queries = spark.createDataFrame([(1, "q"), (2, "q"), (3, None)], "qid int, text string")
    by_length = scorers.Reranker("length", lambda: lambda pairs: [len(t) / 2 for _, t in pairs])
    got = sorted((r.qid, r["rank"], r.id, r.rerank) for r in scorers.reranked(pool, queries, by_length, 2).collect())
    assert got == [(1, 1, "c", 1.5), (1, 2, "b", 1.0), (2, 1, "d", None), (3, 1, "e", 0.5), (3, 2, "f", 0.5)]
    d = spark.createDataFrame([(0.5,), (1.5,), (-2.0,), (None,)], "s double")
    assert [r.r for r in d.select(scorers.rerank_relevance(F.col("s")).alias("r")).collect()] == [50.0, 100.0, 0.0, None]

    def gone():
        raise OSError("no such model")

    missing = scorers.reranked(pool, queries, scorers.Reranker("gone", gone), 2)
    assert sorted((r.qid, r["rank"], r.id) for r in missing.collect()) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "d"), (3, 1, "e"), (3, 2, "f")]
    bad = scorers.reranked(pool, queries, scorers.Reranker("nan", lambda: lambda pairs: [float("nan") for _ in pairs]), 1)
    assert {r.id for r in bad.collect()} == {"a", "d", "e"}
