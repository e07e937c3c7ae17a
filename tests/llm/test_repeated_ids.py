"""Vectors whose ids repeat, with equal and with other vectors: Spark, its SQL and brute force over rows."""

import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.llm import embeddings


def brute(rows, threshold=0.95):
    fine = [(k, i, np.array(v, float)) for k, (i, v) in enumerate(rows) if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for a, _, x in fine:
        for b, _, y in fine:
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a].add(b)
    out = []
    for k, (i, v) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        component = min((rows[j][0] for j in seen), key=lambda x: (x is None, x))
        same = sum(rows[j][1] == v for j in links[k])
        out.append((i, len(links[k]), component, i == component, same))
    return sorted(out, key=str)


def both(spark, rows):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("own") for c in ("node", "least", "part", "tab", "code", "cls", "chunk", "ti", "tj", "component")})
    got = embeddings.near_duplicates(d.repartition(3)).select("vec_id", "n_links", "component_id", "kept", "n_copies")
    con = duckdb.connect()
    given = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64()))})  # noqa: F841
    con.execute("CREATE TABLE embeddings AS SELECT * FROM given")
    said = con.execute(f"SELECT vec_id, n_links, component_id, kept, n_copies FROM ({embeddings.oracle()})").fetchall()
    return sorted(map(tuple, got.collect()), key=str), sorted(said, key=str)


def test_an_id_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (3, [1.0, 0.02]), (5, [0.0, 1.0]), (4, None), (None, [1.0, 0.0]), (6, [0.0, 0.0]), (6, [1.0, 0.0, 0.0])]
    got, said = both(spark, rows)
    assert got == said == brute(rows)
    assert {r[1] for r in got if r[0] == 5} == {1}


def test_random_rows_with_repeated_ids(spark):
    r = random.Random(8)
    base = [[r.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = []
    for _ in range(160):
        v = r.choice(base)
        if r.random() < 0.6:
            v = [x + r.gauss(0, 0.08) for x in v]
        rows.append((r.randrange(60), v))
    rows += rows[:15] + [(7, base[0])] * 40
    got, said = both(spark, rows)
    assert got == said == brute(rows)
