"""Toxicity: rare toxic words count at any size and at any cap."""

import re

import numpy as np
import pytest
from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import functions as F

from corpusloom.llm import toxicity

WORDS = ["vlurp", "zorkish", "quabble", "drimth"]


@pytest.mark.parametrize(("n", "most"), [(300, 1000), (800, 40)])
def test_words_of_few_toxic_examples_tell(spark, n, most):
    # each word stands in a quarter of the toxic rows and in no clean one
    docs = [(i, f"plain words {'x' * (3 + i % 11)} {'y' * (3 + i % 13)}{'z' * (i % 17)} {WORDS[i // 10 % 4] if i % 10 == 0 else 'more'}") for i in range(n)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = d.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    got = {r.doc_id for r in toxicity.scored(d, labels, most).where("score >= 0.5").select("row.doc_id").collect()}
    assert got <= set(range(0, n, 10)) and len(got) >= 0.75 * n / 10


def test_no_term_of_the_examples_is_left_out(spark):
    d = spark.createDataFrame([(i, f"common word{i} word{i} word{i}") for i in range(60)], "doc_id long, text string")
    labels = d.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"))
    index = toxicity.fit(d, labels)
    assert set(index.number) == {"common", "word"} and (index.scale > 0).all()


def test_a_term_weighs_more_where_it_stands_more_often():
    index = toxicity.Index({"vlurp": 0, "word": 1}, np.ones(2), [(np.array([0, 1]), np.array([2.0, 1.0])), (np.array([0, 1]), np.ones(2))], np.zeros(2), np.ones(2), ["1", "2"])
    terms, times = index.row(toxicity.words_of("Vlurp vlurp word other"))
    assert times.tolist() == [2, 1]
    w = dict(zip(terms.tolist(), index.vector(terms, times).tolist(), strict=True))
    assert w[0] > w[1] > 0


def test_words_are_the_runs_of_letters_of_any_script():
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for text in (every[:0x10000], every, " ".join(every[:0x3000]), "Añb_c1d²e\x1cf\x85g\xa0h i　jİK 𝐀b\x00c", "", None):
        assert toxicity.words_of(text) == re.findall(r"[^\W\d_]+", (text or "").lower())


@pytest.mark.parametrize(("texts", "entries", "long"), [(128, 4 << 20, 16), (7, 4 << 20, 3), (128, 900, 10**9), (128, 4 << 20, 1)])
def test_texts_looked_up_together_get_the_exact_neighbours_and_the_lists_are_read_once_a_group(monkeypatch, texts, entries, long):
    monkeypatch.setattr(toxicity, "TEXTS", texts)
    monkeypatch.setattr(toxicity, "ENTRIES", entries)
    monkeypatch.setattr(toxicity, "LONG", long)
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    r, terms, n = np.random.default_rng(3), 60, 230
    rows = []
    for i in range(n):
        t = np.flatnonzero(r.random(terms) < 3 / (2 + np.arange(terms))) if i % 40 else np.zeros(0, np.int64)
        rows.append((t, r.integers(1, 4, len(t)).astype(float)))
    rows[50:55] = rows[60:65]  # equally near ones
    scale = 1 + r.random(terms)
    index = toxicity.Index({}, scale, rows, (np.arange(n) % 3 == 0).astype(float), np.ones(n), [str(i) for i in range(n)])
    dense = np.zeros((n, terms))
    for i, (t, k) in enumerate(rows):
        v = (1 + np.log(k)) * scale[t]
        dense[i, t] = v / max(1e-12, np.sqrt(v @ v))
    calls, count = [], np.bincount
    monkeypatch.setattr(toxicity.np, "bincount", lambda *a, **k: calls.append(1) or count(*a, **k))
    for without in (None, list(range(n))):
        calls.clear()
        got = index.nearest_of(rows, without=without)
        assert len(got) == n and (texts < 128 or entries < 1000 or len(calls) <= 3 * -(-n // texts))
        for i, near in enumerate(got):
            want = sorted((-c, j) for j, c in enumerate((dense @ dense[i]).round(12)) if c > 0 and j != (i if without else -1))[: toxicity.NEIGHBOURS]
            assert np.allclose([c for c, _ in near], [-c for c, _ in want], atol=1e-11) and len(near) == len(want)
            assert near == index.nearest(rows[i], without=i if without else -1)  # to the last bit


def test_the_index_is_sent_once_and_not_with_each_function(spark, monkeypatch):
    words = "transform(sequence(85 * id, 85 * id + 84), x -> concat('word', translate(string(x), '0123456789', 'abcdefghij')))"
    d = spark.range(200).selectExpr("id AS doc_id", f"concat_ws(' ', {words}) AS text")
    labels = d.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"))
    sizes, dumps = [], CloudPickleSerializer.dumps
    monkeypatch.setattr(CloudPickleSerializer, "dumps", lambda self, obj: sizes.append(len(out := dumps(self, obj))) or out)
    assert toxicity.scored(d, labels).count() == 200
    assert len(sizes) >= 3 and max(sizes) < 250_000  # the examples' words alone are more; the table of letters is 131,072


def test_no_more_texts_are_held_than_are_looked_up_at_once(monkeypatch):
    monkeypatch.setattr(toxicity, "TEXTS", 7)
    rows = [(np.array([i % 5, 5]), np.ones(2)) for i in range(100)]
    index = toxicity.Index({}, np.ones(6), rows, np.zeros(100), np.ones(100), [str(i) for i in range(100)])
    taken = []
    each = index.nearest_each(taken.append(i) or (*index.example_vector(i), i) for i in range(100))
    assert next(each) == index.nearest(rows[0], without=0) and len(taken) == 8
    assert [*each] == index.nearest_of(rows, without=list(range(100)))[1:]
