"""Jaccard join, embeddings, suffixes, toxicity, packing, components and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import components, embeddings, jaccard, packing, suffixes, tiles, toxicity

DOC = "doc_id long, text string"


def shingles(t):
    w = re.findall(r"[0-9A-Za-z_\x80-\U0010ffff]+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


def near_texts(seed=4, groups=12):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(2, 7)))
    out = [None, "", "!!", "one two", "One, two!", "one two three four five"]
    for _ in range(groups):
        base = [word() for _ in range(r.randrange(30, 200))]
        out.append(" ".join(base))
        for _ in range(r.randrange(1, 14)):
            w = list(base)
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("side", [1024, 3])
def test_jaccard_join_equals_brute_force(spark, noisy, monkeypatch, side):
    monkeypatch.setattr(jaccard, "SIDE", side)
    monkeypatch.setattr(jaccard, "EXACT_SIDE", side)
    monkeypatch.setattr(jaccard, "CHUNK_BYTES", 16 << 20 if side > 3 else 3000)
    texts = near_texts()
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root, n = linked(len(texts), pairs), Counter(x for p in pairs for x in p)
    d = noisy(spark.createDataFrame(list(enumerate(texts)), DOC))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicate_report(d).collect()}
    assert got == {i: (root[i], n[i]) for i in range(len(texts))}
    kept = jaccard.one_of_each(d)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(len(texts)) if root[i] == i}


def test_jaccard_join_of_nothing_and_of_repeated_rows(spark):
    assert jaccard.near_duplicate_report(spark.createDataFrame([], DOC)).count() == 0
    d = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(None, "a b c d e f")], DOC)
    got = jaccard.near_duplicate_report(d).collect()
    assert [r.n_links for r in got] == [3] * 4 and {r.class_id for r in got} == {1}
    assert jaccard.one_of_each(d).count() == 1


def test_prefixes_are_shortened_until_the_recall_is_met():
    k = jaccard.least_depth()
    miss = lambda k: (1 - 0.8**k) ** jaccard.TREES
    assert miss(k) <= 1 - jaccard.RECALL < miss(k + 1)
    assert abs(jaccard.met(0.8, k) - (1 - miss(k))) < 1e-12


@pytest.mark.parametrize(("changed", "ends"), [(0, jaccard.DEPTH), (6, None)])
def test_close_copies_end_the_shortening_early(spark, changed, ends):
    r = random.Random(12)
    rows = []
    for g in range(30):
        base = [f"w{r.randrange(10**6)}" for _ in range(300)]
        rows += [" ".join(base), " ".join([*base, "end"]), " ".join(x if i % 50 or not changed else f"v{r.randrange(10**6)}" for i, x in enumerate(base))]
    d = spark.createDataFrame(list(enumerate(rows)), DOC)
    reps = jaccard.signatures(d, "doc_id", "text").groupBy(F.col("cls").alias("node")).agg(F.first("sig").alias("sig"))
    edges, depth = jaccard._forest(reps.cache(), jaccard.THRESHOLD, jaccard.RECALL)
    assert depth == ends if ends else jaccard.least_depth() <= depth < jaccard.DEPTH
    assert edges.count() >= 60
    assert jaccard.near_duplicate_report(d).where("n_links >= 1").count() == 90


def test_shingles_don_t_depend_on_the_batch():
    s = jaccard.Shingler()
    t = ["a b c d e f g", "x", "", "ÉÉ b c d e f"]
    assert [x.tolist() for x in s.sets(t)] == [s.sets([x])[0].tolist() for x in t]
    assert len(s.sets(["a b c d e f g"])[0]) == 3


def test_embeddings_equal_brute_force(spark, noisy, monkeypatch):
    monkeypatch.setattr(embeddings, "SIDE", 8)
    monkeypatch.setattr(embeddings, "LOAD", 16)
    r = np.random.default_rng(5)
    v = r.standard_normal((150, 16))
    v = np.concatenate([v, v[:5], v[:60] + 0.12 * r.standard_normal((60, 16)), v[:1] + 0.05 * r.standard_normal((40, 16))]).astype(np.float32)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    close = (u @ u.T >= 0.95) & ~np.eye(len(v), dtype=bool)
    root = linked(len(v), zip(*np.nonzero(close), strict=True))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (905, [float("inf")] * 16), (906, [1.0, 2.0]), (None, v[0].tolist())]
    d = noisy(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>"))
    got = {x.vec_id: x for x in embeddings.near_duplicates(d).collect()}
    found = sum(got[i].n_links for i in range(len(v)))
    assert found >= 0.99 * close.sum()
    assert all(got[i].n_links <= close[i].sum() for i in range(len(v)))
    assert sum(got[i].component_id != root[i] for i in range(len(v))) <= 2
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 907))
    assert got[None].component_id is None and got[None].n_links == 0
    assert embeddings.near_duplicates(d.where("false")).count() == 0
    named = d.where("vec_id < 150").withColumn("vec_id", F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 3, "0"))).withColumn("tab", F.lit(0)).withColumn("code", F.lit(1)).withColumn("cls", F.lit("c"))
    few = linked(150, zip(*np.nonzero(close[:150, :150]), strict=True))
    got = embeddings.near_duplicates(named.withColumn("embedding", F.col("embedding").cast("array<double>"))).collect()
    assert {x.vec_id: x.component_id for x in got} == {f"v{i:03d}": f"v{few[i]:03d}" for i in range(150)}


def test_more_vectors_take_more_bits_and_tables():
    plans = [embeddings.plan(n) for n in (100, 10**5, 10**9)]
    assert plans == sorted(plans)
    for bits, tables in plans:
        assert 1 - (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** tables >= embeddings.RECALL


def test_components_of_chains_stars_and_repeats(spark):
    e = [(i, i + 1) for i in range(100, 130)] + [(7, i) for i in range(1000, 1100)] + [(5, 5), (3, 4), (4, 3), (None, 1)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 131)} | {i: 7 for i in [7, *range(1000, 1100)]} | {3: 3, 4: 3}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_local_union_find():
    assert tiles.union_find(6, np.array([1, 2, 5]), np.array([2, 3, 4])).tolist() == [0, 1, 1, 1, 4, 4]


def py_suffix(texts, length):
    data = [(t or "").encode() for t in texts]
    n = Counter(b[s : s + length] for b in data for s in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if n[b[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize(("most", "batch"), [(256, 8192), (1, 16), (4, 16), (30, 40)])
def test_suffix_dedup_equals_brute_force(spark, noisy, monkeypatch, most, batch):
    monkeypatch.setattr(suffixes, "MOST", batch)
    r = random.Random(6)
    say = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    base = say(700)
    texts = [None, "", "x" * 900, "ab" * 300, base, base + base, say(199)] + [base[: r.randrange(700)] + say(r.randrange(60)) + base[r.randrange(700) :] for _ in range(25)] + [say(r.randrange(250)) + base[100:330] + say(r.randrange(250)) for _ in range(25)]
    d = noisy(spark.createDataFrame(list(enumerate(texts)), DOC))
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n, x.h) for x in suffixes.dedup_bytes(d, most=most).select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("kept", 256).alias("h")).collect()}
    assert [got[i] for i in range(len(texts))] == py_suffix(texts, 200)


def test_suffix_dedup_of_nothing_and_of_repeated_rows(spark):
    assert suffixes.dedup_report(spark.createDataFrame([], DOC)).count() == 0
    got = suffixes.dedup_report(spark.createDataFrame([(1, "q" * 100 + "abc" * 100)] * 2 + [(None, "z" * 10)], DOC)).collect()
    assert sorted(x.n_removed for x in got) == [0, 400, 400]


def test_parts_of_long_texts_overlap():
    parts = [p for b in suffixes._buffers([b"a" * 2500, b"", b"b" * 10], 1000, 199) for p in b]
    seen = {(i, o + k) for i, o, b in parts for k in range(max(0, len(b) - 199))}
    assert {s for i, s in seen if i == 0} == set(range(2500 - 199))


def test_the_suffix_sort_sorts():
    r = np.random.default_rng(7)
    reach = r.integers(0, 9, 300)
    text = np.zeros((300, 8), np.uint8)
    for i, n in enumerate(reach):
        text[i, :n] = r.integers(97, 99, n)
    h = suffixes.Hashes()
    h.running(np.zeros(8, np.uint8))
    rows = [bytes(t[:n]) for t, n in zip(text, reach, strict=True)]
    assert [rows[i] for i in suffixes.sort_suffixes(text, reach, h)] == sorted(rows)


def toxic_table(spark, n=600):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 8)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(40)]
        bad = i % 6 == 0
        if bad:
            for _ in range(4):
                w[r.randrange(40)] = r.choice(["zorkish", "zorkable", "vlurp"])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_generalises_to_the_held_out_fifth(spark, noisy):
    docs, labels = toxic_table(spark)
    rows = toxicity.toxicity_report(noisy(docs), labels).collect()
    out = [x for x in rows if x.held_out]
    assert {x.doc_id for x in out} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(x.predicted == (x.doc_id % 6 == 0) for x in out) >= 0.97 * len(out)
    assert all(0 <= x.score <= 1 for x in rows)
    assert any(":" in x.evidence for x in rows)


def test_toxicity_reads_no_held_out_label(spark):
    docs, labels = toxic_table(spark, 200)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({x.doc_id: x.score for x in toxicity.toxicity_report(docs, y).collect()} for y in (labels, flipped))
    assert a == b


def test_toxicity_of_nulls_and_without_labels(spark):
    docs, labels = toxic_table(spark, 120)
    more = docs.union(spark.createDataFrame([(9000, None), (9001, ""), (None, "zorkish zorkable")], DOC))
    odd = labels.union(spark.createDataFrame([(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"))
    got = toxicity.toxicity_report(more, odd).collect()
    assert len(got) == 123 and all(x.score is not None for x in got)
    assert toxicity.accepted(more, odd).columns == more.columns
    assert {x.score for x in toxicity.toxicity_report(docs, labels.where("false")).collect()} == {0.0}
    assert toxicity.toxicity_report(docs.where("false"), labels).count() == 0


def test_block_max_neighbours_are_exact():
    r = random.Random(9)
    rows = []
    for _ in range(500):
        t = r.sample(range(30), r.randrange(0, 6))
        rows.append((np.array(t, np.int64), np.array([r.randrange(1, 4) for _ in t], float)))
    scale = np.array([1 + r.random() for _ in range(30)])
    index = toxicity.Index({}, scale, rows, np.array([i % 3 == 0 for i in range(500)], float), np.ones(500), [str(i) for i in range(500)])

    def dense(t, n):
        v = np.zeros(30)
        v[t] = (1 + np.log(n)) * scale[t]
        return v / max(np.linalg.norm(v), 1e-12)

    every = np.array([dense(*x) for x in rows])
    for i, q in enumerate(rows[:120]):
        for without in (-1, i):
            cosine = np.round(every @ dense(*q), 12)
            want = sorted((-c, j) for j, c in enumerate(cosine) if c > 0 and j != without)[: toxicity.NEIGHBOURS]
            got = index.nearest(q, without=without)
            assert np.allclose([s for s, _ in got], [-c for c, _ in want]) and len(got) == len(want)
            assert [j for _, j in got] == [j for _, j in want] or len({round(s, 9) for s, _ in got}) < len(got)


def test_scores_equal_brute_force_from_texts_to_votes(spark):
    """Every step anew, without index, blocks or shared code: terms, counts, weights, cosines, votes, calibration."""
    import math

    docs, labels = toxic_table(spark, 150)
    docs = docs.union(spark.createDataFrame([(9000, None), (9001, "nothing-known 123"), (9002, docs.first().text)], DOC))
    y = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [(r.doc_id, [w for w in "".join(c if c.isalpha() else " " for c in (r.text or "").lower()).split()]) for r in docs.collect()]
    by = {}
    for i, w in rows:
        if i in y and zlib.crc32(str(i).encode()) % 5:
            by.setdefault(" ".join(w), []).append(i)
    sample = [(t.split(), max(y[i] for i in ids), len(ids)) for t, ids in by.items()]
    n1, n0 = sum(x[1] for x in sample), sum(1 - x[1] for x in sample)
    terms = {w for x in sample for w in x[0]}
    part = lambda seen, n, p: seen * math.log(seen / (n * p)) if seen else 0.0
    scale = {}
    for t in terms:
        a, b = (sum(t in x[0] for x in sample if x[1] == v) for v in (1, 0))
        p = (a + b) / (n1 + n0)
        g = max(0, 2 * (part(a, n1, p) + part(n1 - a, n1, 1 - p) + part(b, n0, p) + part(n0 - b, n0, 1 - p)))
        scale[t] = (math.log((1 + len(rows)) / (1 + sum(t in w for _, w in rows))) + 1) * (1 + g) / (30 + g)

    def vector(words):
        v = {t: (1 + math.log(words.count(t))) * scale[t] for t in set(words) if t in scale}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = [vector(x[0]) for x in sample]
    prior = sum(x[1] * x[2] for x in sample) / sum(x[2] for x in sample)
    smooth = 0.05 * sum(x[2] for x in sample) / len(sample)

    def votes(words, without=None):
        v = vector(words)
        near = sorted(((round(sum(x * u.get(t, 0) for t, x in v.items()), 12), j) for j, u in enumerate(vectors) if j != without), reverse=True)[:15]
        near = [(c, j) for c, j in near if c > 0]
        if near:
            return (sum(c * sample[j][2] * sample[j][1] for c, j in near) + smooth * prior) / (sum(c * sample[j][2] for c, j in near) + smooth)

    raw = sorted((votes(x[0], j), j) for j, x in enumerate(sample))
    pools = []
    for x, j in raw:
        pools.append([x, x, sample[j][1] * sample[j][2], sample[j][2]])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    xs, ys = [x for p in pools for x in p[:2]], [(p[2] + prior) / (p[3] + 1) for p in pools for _ in (0, 1)]
    got = {r.doc_id: r.score for r in toxicity.toxicity_report(docs, labels).collect()}
    for i, w in rows:
        v = votes(w)
        assert abs(got[i] - (np.interp(v, xs, ys) if v is not None else prior)) < 1e-6, i


def test_toxicity_takes_string_ids_equal_texts_and_long_ones(spark):
    docs, labels = toxic_table(spark, 120)
    long = docs.first().text + " vlurp" + " word" * 50_000
    more = docs.union(docs).union(spark.createDataFrame([(7000, long)], DOC)).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    said = labels.select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"), "toxic")
    got = toxicity.toxicity_report(more, said).collect()
    assert len(got) == 241 and len({(r.doc_id, r.score) for r in got}) == 121


TEXTS = ["Hello world's 12th test", "", None, "ÀÉ ß ñandú", "日本語 text", "a<|endoftext|>b", "\x07bell nbsp", "Σίσυφος İstanbul", "x²¾ é '’s 've !'ll", "word " * 9000]


def test_token_ids_equal_the_tokenizer_s(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    t, w = Tokenizer.from_file(path), packing.WordIds(path)
    r = random.Random(10)
    texts = [x or "" for x in TEXTS] + ["".join(r.choice("ab C1'é!\n\t.²st<|") for _ in range(60)) for _ in range(400)]
    for x in texts * 2:
        assert np.frombuffer(w.of(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_letters_whose_small_ones_lie_beyond_the_latin_blocks_and_words_asked_of_the_model():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    t, w = Tokenizer.from_file(path), packing.WordIds(path)
    r = random.Random(12)
    latin = [chr(i) for i in range(0x250)]
    texts = ["ƐVE Ɛ & e n 1", "one ƆƐɅ two", "& e n 1 one two eve", *latin, *("".join(r.choice(latin[0x21:]) for _ in range(30)) for _ in range(300))]
    for x in texts * 2:
        assert np.frombuffer(w.of(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x
    w.tokenizer = t = CountedEncode(w.tokenizer)
    assert len(w.of("zqxjk vbwét words never seen before")) > 0 and t.calls == 0  # the model alone is asked for new words


class CountedEncode:
    def __init__(self, tokenizer):
        self.model, self.tokenizer, self.calls = tokenizer.model, tokenizer, 0

    def encode(self, *a, **k):
        self.calls += 1
        return self.tokenizer.encode(*a, **k)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizers_are_used_whole(name):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path(name)
    w, t = packing.WordIds(path), Tokenizer.from_file(path)
    assert not w.by_words and packing.WordIds(packing.tokenizer_path()).by_words
    for x in ["Hello World's 12", "a  b\n"]:
        assert np.frombuffer(w.of(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_packing(spark, noisy):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    t = Tokenizer.from_file(path)
    d = noisy(spark.createDataFrame([*enumerate(TEXTS), (None, "null id"), (0, TEXTS[0])], DOC))
    got = packing.pack_documents(d, path).collect()
    want = Counter()
    for i, x in [*enumerate(TEXTS), (None, "null id"), (0, TEXTS[0])]:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((i, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096)))
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    by = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for b in by.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.pack_documents(d.where("false"), path).count() == 0


def plain_best_two_fit(lengths, room):
    """The rule itself, trying all that is left: fill with the longest that fit, then give the smallest for the fullest two."""
    left, bins = sorted(lengths), []
    while left:
        inside, gap = [], room
        while fits := [n for n in left if n <= gap]:
            left.remove(fits[-1])
            inside.append(fits[-1])
            gap -= fits[-1]
        least = min(inside)
        pairs = [(a + b, -a, b) for i, a in enumerate(left) for b in left[i + 1 :] if least < a + b <= gap + least]
        if gap and pairs:
            total, a, b = max(pairs)
            assert total == b - a
            for n in (-a, b):
                left.remove(n)
            inside.remove(least)
            inside += [-a, b]
            left = sorted([*left, least])
        bins.append(sorted(inside))
    return bins


def test_best_two_fit_gives_the_bins_of_the_plain_rule():
    r = np.random.default_rng(4)
    for trial in range(40):
        room = int(r.integers(5, 120))
        lengths = r.integers(1, room + 1, int(r.integers(0, 120))) if trial % 2 else np.minimum(room, 1 + r.geometric(4 / room, 90))
        bins, offsets = packing.best_two_fit(lengths, room)
        filled = [sorted(lengths[bins == k].tolist()) for k in range(int(bins.max()) + 1 if len(bins) else 0)]
        assert filled == plain_best_two_fit(lengths.tolist(), room)
        for k in range(len(filled)):
            at = np.argsort(offsets[bins == k])
            assert offsets[bins == k][at].tolist() == np.cumsum([0, *lengths[bins == k][at]])[:-1].tolist()


def test_best_two_fit_fills_better_than_greedy_alone():
    r = np.random.default_rng(11)
    for lengths in (r.integers(1, 4097, 3000), np.array([60, 50, 40, 35, 30, 25]), np.full(10, 4096)):
        room = 4096 if lengths.max() > 100 else 100
        b, o = packing.best_two_fit(lengths, room)
        fill = np.bincount(b, lengths)
        assert fill.max() <= room and len(fill) >= -(-lengths.sum() // room)
        assert len(fill) <= 1.03 * lengths.sum() / room + (lengths > room / 2).sum()
    b, _ = packing.best_two_fit(np.array([60, 50, 40, 35, 30, 25]), 100)
    assert b.max() + 1 == 3


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    docs, labels = toxic_table(spark, 120)
    text = "\n".join(f"line {i} of a passage that repeats word{i} other{i}" for i in range(8))
    rows = docs.collect() + [(500, text), (501, text + "\nand one more line that is different at its end"), (502, "clean " + " ".join(f"w{i}" for i in range(60)))]
    bench = " ".join(f"bench{i}" for i in range(30))
    rows += [(503, bench)]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, x in {"documents": d, "labels": labels, "benchmark": spark.createDataFrame([(1, bench)], "item_id long, text string")}.items():
        x.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {x.doc_id for x in out}
    assert {500, 501, 502} <= ids and 503 not in ids
    assert len([i for i in ids if i < 120 and i % 6 == 0]) <= 2
    assert len([i for i in ids if i < 120 and i % 6]) >= 98
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
