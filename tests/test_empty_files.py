import hashlib

import __spark_entry__


def test_documents_that_hold_nothing_are_files_too(spark, tmp_path):
    rows = [(1, "text", "a"), (2, "", "a"), (3, None, "b c"), (4, "é\n", "b c")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.path: r.digest for r in __spark_entry__.queries()["written_documents"](spark, str(tmp_path)).collect()}
    assert got == {f"{source}/{i}.md": hashlib.sha256((text or "").encode()).hexdigest() for i, text, source in rows}
