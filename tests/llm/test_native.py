"""Chat formatting, secrets, licences, decontamination and line dedup."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from corpusloom.llm import chat, contamination, licences, line_dedup, secrets
from corpusloom.llm.common import doc_key

DOC = "doc_id long, text string, source string"


def test_chats_keep_maximal_conversations(spark, noisy):
    t = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes <|im_end|>"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "no"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 0, None, None), (None, 0, "user", "hi"), (None, 0, "user", "alone"), (None, 0, "user", "alone")]
    got = {r.chat: (r.conv_id, r.n_turns, r.n_copies) for r in chat.format_chats(noisy(spark.createDataFrame(t, "conv_id long, turn long, role string, text string"))).collect()}
    o, c = chat.OPEN, chat.CLOSE
    assert got == {
        f"{o}user\nhi{c}\n{o}assistant\nyes < |im_end|>{c}\n": (1, 2, 1), f"{o}user\nhi{c}\n{o}assistant\nno{c}\n": (3, 2, 2), f"{o}\n{c}\n": (5, 1, 1), f"{o}user\nalone{c}\n": (None, 1, 2)
    }
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chats_of_long_texts_ties_and_look_alikes(spark):
    long = "x" * 300_000
    t = [(1, 0, "u", long), (2, 0, "u", long), (2, 1, "a", "y"), (3, 0, "u", "a"), (3, 0, "u", "a"), (4, 0, "u", "a"), (5, 0, "u=1:", "b"), (6, 0, "u", "=1:b"), (7, None, "u", "q"), (8, 3, "u", "q"), (9, 0, None, "z"), (10, 0, "", "z")]
    got = sorted((r.conv_id, r.n_turns, r.n_copies) for r in chat.format_chats(spark.createDataFrame(t, "conv_id long, turn long, role string, text string")).collect())
    assert got == [(2, 2, 1), (3, 2, 1), (5, 1, 1), (6, 1, 1), (7, 1, 2), (9, 1, 1), (10, 1, 1)]
    named = spark.createDataFrame([("b", 0, "u", "a"), ("a", 0, "u", "a")], "conv_id string, turn long, role string, text string")
    assert [(r.conv_id, r.n_copies) for r in chat.format_chats(named).collect()] == [("a", 2)]


def test_licences_of_nothing_and_of_very_long_texts(spark):
    known = spark.createDataFrame([("MIT", licences.NOTICES["MIT"])], "license_id string, text string")
    assert licences.scan(spark.createDataFrame([], DOC), known).count() == 0
    long = "prose of many words\n" * 20_000 + licences.NOTICES["MIT"]
    r = licences.scan(spark.createDataFrame([(1, long, "s")], DOC), known).first()
    assert (r.license_id, r.line_licenses, r.n_license_lines) == (None, "MIT", 1)
    assert licences.scan(spark.createDataFrame([(1, "x", "s")], DOC), known.where("false")).first().line_licenses == ""


PY = [
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def base_spans(text):
    found = sorted((m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(PY) for m in p.finditer(text or "") if ok(m))
    return [f"{n}:{s}:{e}" for s, _, n, e in found]


def test_base_spans_are_those_of_the_patterns(spark, noisy):
    r = random.Random(1)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", '"', "'", " ", "=", ":", "abc", "abcdefg", "AKIA", "ABCDEFGHIJKLMNOP12", "0123456789abcdef01234567", "é", "\n", "日本", "😀", "-", "token: secret= x"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(300)] + [None, "", "secret: token: abcdefgh", "token=short token=longenough"]
    d = noisy(spark.createDataFrame([(i, t, f"s{i % 5}") for i, t in enumerate(texts)], DOC))
    got = {x.doc_id: x for x in secrets.secret_report(d).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("owned")] == want
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))


def test_ownership_tells_copied_examples_from_owned_values(spark):
    own, copied = "Zx9Qw8Er7Ty6Ui5Op4As3", "Ex4mpl3Ex4mpl3Ex4mpl3"
    rows = [(1, f"key {own} here", "a")] + [(10 + i, f"see {copied}", f"s{i}") for i in range(4)] + [(99, None, None), (99, None, None)]
    got = {x.doc_id: x for x in secrets.secret_report(spark.createDataFrame(rows, DOC)).collect()}
    assert got[1].spans == f"owned:4:{4 + len(own)}" and got[1].n_live == 1
    assert got[10].spans == ""
    assert got[99].n_live == 0
    assert secrets.secret_report(spark.createDataFrame([], DOC)).count() == 0


def test_licences_match_whole_texts_and_lines(spark, noisy):
    known = spark.createDataFrame([("X", "Permission is granted to use this LICENCE.\nCopyright 2020 A"), ("MIT", licences.NOTICES["MIT"]), ("none", None)], "license_id string, text string")
    rows = [(1, "Copyright (c) 2024 B\n  permission is GRANTED, to use: this license", "s"), (2, "prose\nReleased under the   mit licence\nmore", "s"), (3, None, "s"), (4, "", "s"), (5, "!!!", "s"), (2, "prose\nReleased under the   mit licence\nmore", "s")]
    got = licences.scan(noisy(spark.createDataFrame(rows, DOC)), known).orderBy("doc_id").collect()
    assert [(r.doc_id, r.license_id, r.line_licenses, r.n_license_lines) for r in got] == [(1, "X", "X", 1), (2, None, "MIT", 1), (2, None, "MIT", 1), (3, None, "", 0), (4, None, "", 0), (5, None, "", 0)]
    assert [r.digest for r in got if r.doc_id in (3, 4, 5)] == [None] * 3


def py_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def py_contamination(docs, items, width):
    near = min(contamination.NEAR, width - 1)
    wins = {}
    for i, t in items:
        w = py_words(t)
        for s in range(max(1, len(w) - width + 1)) if w else ():
            wins.setdefault(tuple(w[s : s + width]), set()).add(str(i) if i is not None else "")
    counts = {}
    for _, t in docs:
        for x in py_words(t):
            counts[x] = counts.get(x, 0) + 1
    pairs = {}
    for x, ids in wins.items():
        if len(x) > 1 and all(t in counts for t in x):
            rare = sorted((counts[t], t, at) for at, t in enumerate(x))
            pairs.setdefault((rare[0][1], rare[1][1]), set()).update(ids)
    out = {}
    for d, t in docs:
        w, hit, ids, close = py_words(t), set(), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s : s + n])) in wins:
                    hit |= set(range(s, s + n))
                    ids |= wins[x]
        for p in range(len(w)):
            for q in range(max(0, p - near), min(len(w), p + near + 1)):
                if p != q:
                    close |= pairs.get((w[p], w[q]), set())
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), len(close))
    return out


def test_contamination_equals_brute_force(spark, noisy, monkeypatch):
    r = random.Random(2)
    words = ["a", "B", "c", "É", "x1", "der", "Zu", "the"]
    say = lambda n: " ".join(r.choice(words) + r.choice(["", ",", "."]) for _ in range(n))
    items = [(i, say(r.randrange(1, 12))) for i in range(12)] + [(None, "the the"), (3, "zu der"), (50, None), (51, "!!"), (52, "rare1 a rare2"), (53, "never said")]
    docs = [(i, say(r.randrange(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, items[0][1] + " extra " * 300), (103, "rare2 b rare1"), (104, "rare1 a b c der zu rare2")]
    want = py_contamination(docs, items, 5)
    assert want[103][5]
    d, b = spark.createDataFrame([(i, t, "s") for i, t in docs], DOC), spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, 0):  # broadcast or not
        monkeypatch.setattr("corpusloom.llm.common.BROADCAST_BYTES", limit)
        got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated, x.n_near) for x in contamination.contamination_report(noisy(d), noisy(b), 5).collect()}
        assert got == want
    rows = contamination.clean_documents(noisy(d), b, 5)
    assert rows.columns == noisy(d).columns
    assert {x.doc_id for x in rows.collect()} == {i for i, v in want.items() if not v[4]}
    assert contamination.contamination_report(d, b.where("false"), 5).where("n_hit > 0").count() == 0
    assert contamination.contamination_report(d.where("false"), b, 5).count() == 0


def test_contamination_of_repeated_rows_and_very_long_texts(spark):
    bench = " ".join(f"w{i}" for i in range(20))
    long = "filler " * 200_000 + bench + " filler" * 10
    d = spark.createDataFrame([(1, bench, "s"), (1, bench, "s"), (2, long, "s")], DOC)
    got = contamination.contamination_report(d, spark.createDataFrame([(7, bench)], "item_id long, text string")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r.contaminated, r.n_near) for r in got] == [(1, 20, 20, True, 1), (1, 20, 20, True, 1), (2, 200_030, 20, False, 1)]


def test_terms_beyond_the_bound_of_a_broadcast_may_be_in_every_document(spark, monkeypatch):
    r = random.Random(8)
    say = lambda n: " ".join(r.choice(["the", "The", "of", f"w{r.randrange(40)}"]) for _ in range(n))
    items = [(1, "the of the of the"), (2, "the the the"), (3, say(9)), (4, say(30)), (5, "the w1 of W2 the")]
    docs = [(i, say(r.randrange(80))) for i in range(70)] + [(100, "the " * 5000), (101, f"x {items[3][1]} y"), (102, None)]
    docs += [docs[3]]
    d, b = spark.createDataFrame([(i, t, "s") for i, t in docs], DOC), spark.createDataFrame(items, "item_id long, text string")
    w = contamination.item_windows(b, 5)
    read = lambda x: {tuple(y) for y in x.collect()}
    counts = contamination.term_counts(d, w)
    terms = contamination.anchors(contamination.rare_windows(w, counts))
    want = read(counts), read(contamination.build_index(d, terms, 5).select("term", "doc", "pos", "near"))
    monkeypatch.setattr("corpusloom.llm.common.BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert (read(contamination.term_counts(d, w)), read(contamination.build_index(d, terms, 5).select("term", "doc", "pos", "near"))) == want
        got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated, x.n_near) for x in contamination.contamination_report(d, b, 5).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == py_contamination(list(dict.fromkeys(docs)), items, 5)


def test_postings_are_intersected_and_near_ones_found(spark):
    d = spark.createDataFrame([(1, "rare one two other rare", "s"), (2, "rare a b c d e f g h other", "s"), (3, "other x rare", "s"), (4, "other rare", "s")], DOC)
    b = spark.createDataFrame([(1, "other rare")], "item_id long, text string")
    w = contamination.item_windows(b, 13)
    rare = contamination.rare_windows(w, contamination.term_counts(d, w))
    index = contamination.build_index(d, contamination.anchors(rare), 13)
    ids = {r.doc: r.doc_id for r in d.select(doc_key(F.col("doc_id"), F.col("text")).alias("doc"), "doc_id").collect()}
    assert index.count() == 9
    assert {(ids[r.doc], r.start) for r in contamination.intersected(index, rare).collect()} == {(1, 3), (4, 0)}
    assert {ids[r.doc] for r in contamination.proximity_matches(index, rare, 13, 3).collect()} == {1, 3, 4}


def py_line_dedup(docs, m):
    docs = sorted({(i, t or "") for i, t in docs}, key=lambda x: (x[0] is not None, x[0] or 0))
    seen, gone = set(), {}
    for i, t in docs:
        lines = t.split("\n")
        for s in range(len(lines) - m + 1):
            w = tuple(lines[s : s + m])
            if w in seen:
                gone.setdefault((i, t), set()).update(range(s, s + m))
            seen.add(w)
    return {k: "\n".join(x for j, x in enumerate(k[1].split("\n")) if j not in gone.get(k, ())) for k in docs}


def test_line_dedup_equals_brute_force(spark, noisy):
    r = random.Random(3)
    docs = [(i, "\n".join(r.choice("abcd") for _ in range(r.randrange(14)))) for i in range(80)] + [(200, None), (201, ""), (202, "z\n" * 50), (None, "a\nb\nc\nd\ne")]
    docs += [docs[5]]
    d = noisy(spark.createDataFrame([(i, t, "s") for i, t in docs], DOC))
    for m in (2, 3):
        want = py_line_dedup(docs, m)
        got = line_dedup.drop_repeated_runs(d, m).select("row.doc_id", "row.text", "kept", "row.lines").collect()
        assert len(got) == len(docs)
        for x in got:
            assert x.kept == want[(x.doc_id, x.text or "")]
            assert x.lines == "own lines"
    assert line_dedup.without_repeated_runs(d).columns == d.columns
    kept = line_dedup.without_repeated_runs(d).where(F.length("text") == 0).count()
    assert kept == sum((t or "") == "" and t is not None for _, t in docs)
