"""Line dedup of runs that count by their words: brute force, and SQL of the rule in DuckDB."""

import random

import duckdb
import pytest

from corpusloom.llm import line_dedup

DOC = "doc_id long, text string, source string"


def py_kept(docs, m, many):
    seen, gone = set(), {}
    for i, t in sorted({(i, t or "") for i, t in docs}, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines, late = t.split("\n"), gone.setdefault((i, t), set())
        for s in range(len(lines)):
            for n in range(1, len(lines) - s + 1):
                run = tuple(lines[s : s + n])
                if n >= m or sum(len(x.split()) for x in run) > many:
                    if run in seen:
                        late.update(range(s, s + n))
                    seen.add(run)
    return {k: "\n".join(x for j, x in enumerate(k[1].split("\n")) if j not in v) for k, v in gone.items()}


def sql_kept(docs, m, many):
    """The rule in SQL, over all runs of up to m lines: longer ones are chains of them."""
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    return {
        (i, t): k
        for i, t, k in c.execute(f"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
a AS (SELECT doc_id, text, l, s, unnest(range(1, least({m}, len(l) - s) + 1)) AS n FROM (SELECT *, unnest(range(len(l))) AS s FROM d)),
w AS (SELECT *, array_to_string(l[s + 1 : s + n], chr(10)) AS win FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY win, n ORDER BY doc_id NULLS FIRST, md5(coalesce('=' || doc_id, '-') || chr(0) || text), s) AS k FROM w
      WHERE n = {m} OR len(regexp_extract_all(win, '[^ \t\r\n\f\x0B]+')) > {many}),
g AS (SELECT doc_id, text, list(DISTINCT j) AS j FROM (SELECT doc_id, text, unnest(range(s, s + n)) AS j FROM r WHERE k > 1) GROUP BY ALL)
SELECT d.doc_id, d.text, array_to_string(list_transform(list_filter(range(len(d.l)), lambda x: NOT list_contains(coalesce(g.j, []), x)), lambda x: d.l[x + 1]), chr(10))
FROM d LEFT JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND d.text = g.text""").fetchall()
    }


@pytest.mark.parametrize(("m", "many"), [(3, 4), (2, 3), (4, 6)])
def test_runs_of_many_words_equal_brute_force_and_sql(spark, noisy, m, many):
    r = random.Random(5)
    line = lambda: " ".join(r.choice("ab") for _ in range(r.randrange(7)))
    docs = [(i, "\n".join(line() for _ in range(r.randrange(9)))) for i in range(60)] + [(200, None), (201, ""), (None, "a b a b a b a b"), (202, " a  b\ta b a b \n")]
    docs += [docs[7]]
    want = py_kept(docs, m, many)
    assert sql_kept(docs, m, many) == want
    got = line_dedup.drop_repeated_runs(noisy(spark.createDataFrame([(i, t, "s") for i, t in docs], DOC)), m, many_words=many).select("row.doc_id", "row.text", "kept").collect()
    assert len(got) == len(docs)
    assert all(x.kept == want[(x.doc_id, x.text or "")] for x in got)


def test_one_and_two_lines_of_over_fifty_words_go(spark):
    say = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    one, a, b, short = say(51, "o"), say(26, "a"), say(25, "b"), say(50, "s")
    docs = [(1, one), (2, f"own\n{one}\nwords"), (3, f"{a}\n{b}"), (4, f"x\n{a}\n{b}\ny"), (5, short), (6, f"{short}\nz"), (7, f"{a}\nnot b"), (8, one)]
    d = spark.createDataFrame([(i, t, "s") for i, t in docs], DOC)
    got = {x.doc_id: x for x in line_dedup.dedup_report(d).collect()}
    assert {i: (x.n_removed, x.n_runs) for i, x in got.items()} == {1: (0, 0), 2: (1, 1), 3: (0, 0), 4: (2, 1), 5: (0, 0), 6: (0, 0), 7: (0, 0), 8: (1, 1)}
    left = {x.doc_id: x.text for x in line_dedup.without_repeated_runs(d).collect()}
    assert left[2] == "own\nwords" and left[4] == "x\ny" and 8 not in left


def test_nothing_very_long_texts_and_a_line_in_all_documents(spark, noisy):
    d = spark.createDataFrame([], DOC)
    assert line_dedup.dedup_report(d).count() == 0 and line_dedup.without_repeated_runs(d).count() == 0
    passage = ["p one", "p two", "p three", "p four"]
    long = "\n".join([f"line {i}" for i in range(150_000)] + passage + ["w " * 200_000])
    docs = [(1, "\n".join(passage)), (2, long), (3, "w " * 200_000), (4, "\n".join(["own", *passage, "end"]))]
    got = {x.doc_id: (x.n_lines, x.n_removed, x.n_runs) for x in line_dedup.dedup_report(noisy(spark.createDataFrame([(i, t, "s") for i, t in docs], DOC))).collect()}
    assert got == {1: (4, 0, 0), 2: (150_005, 4, 1), 3: (1, 1, 1), 4: (6, 4, 1)}


def test_windows_that_the_first_position_lacks_are_found_at_later_ones(spark):
    """Every document holds one line that comes first by no match: what stands around it decides."""
    docs = [(0, "common")] + [(i, f"a{i % 5}\ncommon\nb{i % 5}\nc{i % 7}") for i in range(1, 60)]
    want = py_kept(docs, 3, 50)
    d = spark.createDataFrame([(i, t, "s") for i, t in docs], DOC)
    got = {(x.doc_id, x.text): x.kept for x in line_dedup.drop_repeated_runs(d).select("row.doc_id", "row.text", "kept").collect()}
    assert got == want and sum(k != t for (_, t), k in got.items()) == 54


def test_fingerprints_are_one_row_for_each_place(spark):
    say = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    d = spark.createDataFrame([(1, "\n".join(["x", "y", say(51, "many"), "z", "u"]), "s"), (2, "one\ntwo", "s"), (3, say(60, "t"), "s")], DOC)
    marks = line_dedup.fingerprints(d, 3)
    # a line that counts alone is the fingerprint of all windows that hold it: itself, two of two lines, three of three
    assert sorted((r.id, r.pos, len(r.windows), len(r.around)) for r in marks.collect()) == [(1, 2, 6, 80), (3, 0, 1, 80)]
    assert line_dedup.extended(line_dedup.written(marks, "marks"), 3).count() == 0
