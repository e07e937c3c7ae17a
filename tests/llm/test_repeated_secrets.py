"""Secrets: rows that repeat id, text and source are scanned as one."""

import hashlib

from pyspark.sql import functions as F

from corpusloom.llm import secrets

DOC = "doc_id long, text string, source string"


def test_repeated_rows_with_secrets_are_scanned_as_one(spark):
    text = "a password=hunter2222 and token: abcdefgh1 and 0123456789abcdef01234567 too, Zx9Qw8Er7Ty6Ui5Op4As3"
    d = spark.createDataFrame([(1, text, "s")] * 3 + [(2, text, None)] * 2 + [(3, "none", "s")] * 2, DOC)
    one = {r.doc_id: r for r in secrets.secret_report(d.distinct()).collect()}
    got = secrets.secret_report(d).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 1, 2, 2, 3, 3]
    assert all(r == one[r.doc_id] for r in got)
    want = ["assign:2:21", "assign:26:42", "hex:47:71"]
    assert one[1].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
    assert (one[1].n_assign, one[1].n_hex, one[1].spans) == (2, 1, ",".join([*want, "owned:77:98"]))
    spans = secrets.secret_spans(d, d["doc_id"], d["source"]).select("start", "end", "key").where(F.col("kind") != "assign")
    assert all(hashlib.md5(text[r.start : r.end].encode()).digest() == bytes(r.key) for r in spans.collect())


def test_the_sql_takes_repeated_rows_as_one_too(spark):
    import duckdb

    text = "token=abcdefgh1, 0123456789abcdef01234567 and Zx9Qw8Er7Ty6Ui5Op4As3"
    rows = [(1, text, "s"), (1, text, "s"), (2, "see Ex4mpl3Ex4mpl3Ex4mpl3", "a"), (3, "Ex4mpl3Ex4mpl3Ex4mpl3", "b"), (4, "Ex4mpl3Ex4mpl3Ex4mpl3!", "c"), (5, None, "c"), (1, "other text", "s")]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    got = secrets.secret_report(spark.createDataFrame(rows, DOC))
    cols = sorted(got.columns)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(c.execute(f"SELECT {', '.join(cols)} FROM ({secrets.oracle()})").fetchall())


def test_very_long_texts(spark):
    text = "x " * 300_000 + "password=hunter2222 " + "é " * 1000 + "token: abcdefgh1"
    got = secrets.secret_report(spark.createDataFrame([(1, text, "s")], DOC)).first()
    assert got.spans == "assign:600000:600019,assign:602020:602036"
