"""The byte network against finite differences and a plain recurrence, and the operator on held-out rows and odd tables."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import langid


def network(units=3, languages=("a", "b")):
    return langid.Network.new(list(languages), units, np.random.default_rng(3))


def plain(net, data):
    """Probabilities at each position of one segment, one byte and one direction at a time."""
    units, out = net.u.shape[2], []
    for d, places in ((0, range(len(data))), (1, range(len(data) - 1, -1, -1))):
        h, states = np.zeros(units), {}
        for t in places:
            a, u = net.w[d][:, data[t]].astype(float), net.u[d].astype(float) @ h
            z, r = np.clip(a[:units] + u[:units], 0, 1), np.clip(a[units : 2 * units] + u[units : 2 * units], 0, 1)
            n = np.tanh(a[2 * units :] + r * u[2 * units :])
            h = n + z * (h - n)
            states[t] = h
        out.append(states)
    logits = np.array([net.v[0] @ out[0][t] + net.v[1] @ out[1][t] + net.c for t in range(len(data))])
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def test_gradients_are_those_of_finite_differences():
    net, rng = network(), np.random.default_rng(1)
    x, y = rng.integers(0, 256, (6, 5)), np.array([0, 1, 1, 0, 1])
    _, grads = net.gradients(x, y)
    for weights, g in zip((net.w, net.u, net.v, net.c), grads, strict=True):
        for at in zip(*np.unravel_index(np.argsort(-np.abs(g).ravel())[:4], g.shape), strict=True):
            old, ends = weights[at], []
            for e in (1e-2, -1e-2):
                weights[at] = old + e
                ends.append(net.gradients(x, y)[0])
            weights[at] = old
            assert abs((ends[0] - ends[1]) / 2e-2 - g[at]) < 2e-3 * max(1, abs(g[at]) * 100)


def test_pooling_reads_every_byte_once():
    net, rng = network(), np.random.default_rng(2)
    texts = [rng.integers(0, 256, n).astype(np.uint8) for n in (1, 5, 127, 128, 129, 300, 0, 1000)]
    data = np.concatenate(texts)
    sizes = np.array([len(t) for t in texts])
    got = net.pooled(data, np.cumsum(sizes) - sizes, sizes)
    for t, row in zip(texts, got, strict=True):
        cut = [t[k : k + langid.SEGMENT] for k in range(0, len(t), langid.SEGMENT)]
        want = np.concatenate([plain(net, c) for c in cut]).mean(axis=0) if cut else np.zeros(2)
        assert np.allclose(row, want, atol=1e-5)


def test_held_out_rows_are_told(spark, noisy):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = noisy(docs).withColumns({c: F.lit("own") for c in ("lang_pred", "held_out", "letters", "at", "k")})
    got = {r.doc_id: r for r in langid.language_report(rows).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert held and all((zlib.crc32(str(i).encode()) % 4 == 2) == r.held_out for i, r in got.items())
    assert sum(got[i].lang_pred == truth[i] for i in held) / len(held) >= 0.97


def test_held_out_and_unlabelled_rows_teach_nothing(spark):
    ids = range(400)
    rows = [(i, "der und die das nicht " * 4, "x" if zlib.crc32(str(i).encode()) % 4 == 2 else "de") for i in ids] + [(None, "le la les", "fr"), (401, "und", None), (402, "12 34", "num")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert list(langid.sample(docs)) == ["de"]
    assert {r.lang_pred for r in langid.language_report(docs).where("doc_id < 400").collect()} == {"de"}


def test_odd_rows_and_tables(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (4, "the of and " * 30000, "en"), (5, "é", "fr"), (5, "é", "fr"), (None, "the", "en"), (7, "le la les des", "fr")], "doc_id long, text string, lang string")
    got = langid.language_report(docs).collect()
    assert len(got) == 8
    assert {(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3)} == {(i, "und", 0.0) for i in (1, 2, 3)}
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 5}) == 1
    assert next(r for r in got if r.doc_id is None).held_out
    assert langid.language_report(docs.where("false")).collect() == []
    assert {(r.lang_pred, r.score) for r in langid.language_report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}


def test_the_sample_is_bounded_and_spread(spark):
    docs = spark.createDataFrame([(i, f"text {i} " + "abc " * 2000, "en") for i in range(0, 80)], "doc_id long, text string, lang string")
    got = langid.sample(docs, most=7)["en"]
    assert len(got) == 7 * langid.SPREAD
    again = langid.sample(docs.union(docs).repartition(9), most=7)["en"]  # copies don't count twice
    assert got == again
