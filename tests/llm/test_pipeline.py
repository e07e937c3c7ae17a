"""The pipeline's stages, each on what the one before kept, against brute force."""

import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from corpusloom.llm import packing, toxicity

from test_learned import linked, shingles
from test_line_runs import py_kept
from test_native import py_contamination

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9)))
    bench = [" ".join(word() for _ in range(30)) for _ in range(3)]
    passage = "\n".join(" ".join(word() for _ in range(12)) for _ in range(4))
    long_line = " ".join(word() for _ in range(60))
    docs = []
    for i in range(150):
        w = [word() for _ in range(60)]
        if i % 7 == 0:
            for _ in range(4):
                w[r.randrange(60)] = r.choice(["zorkish", "vlurp", "quabble"])
        text = "\n".join(" ".join(w[k : k + 12]) for k in range(0, 60, 12))
        if i % 11 == 3:
            text = passage + "\n" + text
        if i % 13 == 4:
            text += "\n" + long_line
        if i % 17 == 5:
            text += "\n" + bench[i % 3]
        if i % 19 == 6:
            text = " ".join([*docs[-1][1].split(), word()]) if docs[-1][1] else text
        docs.append((i, text))
    docs += [(500, docs[9][1]), (501, docs[9][1]), (501, docs[9][1]), (600, None), (601, ""), (602, passage), (603, bench[0]), (None, "a row without id " + bench[1][:20])]
    labels = [(i, 1, int(i % 7 == 0)) for i in range(0, 150)]
    return docs, labels, [(k, t) for k, t in enumerate(bench)]


def test_each_stage_equals_brute_force(spark, tmp_path):
    docs, labels, bench = corpus()
    d = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in docs], COLUMNS)
    tables = {"documents": d, "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame(bench, "item_id long, text string")}
    for name, x in tables.items():
        x.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    at, seen = d, {}
    for n, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, at, str(tmp_path)).write.parquet(str(tmp_path / f"out{n}"))
        at = spark.read.parquet(str(tmp_path / f"out{n}"))
        seen[name] = [tuple(r) for r in at.select(*(["doc_id", "text"] if n < 4 else at.columns)).collect()]
        assert n == 4 or at.columns == d.columns
    assert list(stage) == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]

    # toxicity: scores are held against brute force in test_learned; here its decision, and that it is the right one
    score = {(r.doc_id, r.text): r.score for r in toxicity.scored(d, tables["labels"]).select("row.doc_id", "row.text", "score").collect()}
    assert Counter(seen["toxicity"]) == Counter(x for x in docs if score[x] < 0.5)
    held = [i for i in range(150) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((i in {x[0] for x in seen["toxicity"]}) == (i % 7 > 0) for i in held) >= len(held) - 1

    want = py_kept(seen["toxicity"], 3, 50)
    kept = [(i, want[(i, t or "")] if want[(i, t or "")] != (t or "") else t) for i, t in seen["toxicity"]]
    assert Counter(seen["line dedup"]) == Counter((i, t) for (i, t), (_, old) in zip(kept, seen["toxicity"], strict=True) if t or t == old)

    rows = sorted(set(seen["line dedup"]), key=lambda x: (x[0] is None, x[0] or 0))
    sets = [shingles(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = linked(len(rows), pairs)
    assert Counter(seen["n-gram Jaccard join"]) == Counter(rows[i] for i in range(len(rows)) if root[i] == i)

    hit = py_contamination(seen["n-gram Jaccard join"], bench, 13)
    assert Counter(seen["benchmark decontamination"]) == Counter(x for x in seen["n-gram Jaccard join"] if not hit[x[0]][4])
    assert any(hit[i][4] for i, _ in seen["n-gram Jaccard join"])

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in seen["benchmark decontamination"]}
    got = [dict(zip(at.columns, r, strict=True)) for r in seen["best-fit packing"]]
    assert {r["doc_id"]: r["length"] for r in got} == ids
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096 and len(fill) <= -(-sum(ids.values()) // 4096) + 1
    for s in fill:
        spans = sorted((r["offset"], r["length"]) for r in got if r["sequence_id"] == s)
        assert [o for o, _ in spans] == np.cumsum([0, *[n for _, n in spans]])[:-1].tolist()
