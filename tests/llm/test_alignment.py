"""Alignment of two tokenizers against a plain version that encodes each row whole."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from corpusloom.llm import alignment

LETTERS = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {chr(b): b for b in LETTERS} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in LETTERS)}


def brute(rows):
    a_tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    a_tok.encode_special_tokens = True
    b_tok = SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    out, counts = [], Counter()
    for doc_id, text in rows:
        want = b" " + (text or "").encode()
        ids_a, ids_b = a_tok.encode(" " + text, add_special_tokens=False).ids if text else [], b_tok.encode(text) if text else []
        bytes_a = [bytes(BYTES[c] for c in a_tok.id_to_token(i)) for i in ids_a]
        bytes_b = []
        for i in ids_b:
            p = b_tok.id_to_piece(i)
            bytes_b.append(bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode())
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            out.append((doc_id, 0, 0, [], ""))
            continue
        end_a, end_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links = [(ids_a[end_a.index(e)], ids_b[end_b.index(e)]) for e in sorted(set(end_a) & set(end_b))]
        groups, i, j = [], 0, 0
        for e in sorted(set(end_a) & set(end_b)):
            x, y = end_a.index(e) + 1, end_b.index(e) + 1
            groups.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
            i, j = x, y
        counts.update(links)
        out.append((doc_id, len(ids_a), len(ids_b), links, ";".join(groups)))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    done = [(d, a, b, len(li), len(li), sum(counts[x] == best[x[1]] for x in li), sum(counts[x] for x in li), hashlib.sha256(g.encode()).hexdigest() if g else "") for d, a, b, li, g in out]
    return sorted(done, key=str), counts, best


TEXTS = [
    "The cat sat.", "The cat sat.", "the  cat\n\nsat  down ", "", None, " ", "\n", "naïve café – “quoted”", "日本語 text, 12345 and 3.14", "a▁b", "<|endoftext|> and <s>x</s> <0x41>",
    "tab\tand\r\nline break\u0085 x", "😀 emoji 👩‍👩‍👧", "x" * 5000, " " * 3000 + "end", "null\x00byte", "don't we'll I'M", "ﬁ ligature Ⅷ ² ½", "The cat sat on the mat. " * 400,
]


def test_alignment_against_brute_force(spark, noisy):
    given = [(k, t) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, "The cat sat."), (3, "other text")]
    given += [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    docs = noisy(spark.createDataFrame(given, "doc_id long, text string")).withColumns({c: F.lit("own") for c in ("pair", "links", "n_a", "groups_sha256", "count_sum")})
    got = sorted(map(tuple, alignment.alignment_report(docs.repartition(5)).collect()), key=str)
    want, counts, best = brute(given)
    assert got == want
    table = {(r.a, r.b): (r.n, r.best) for r in alignment.translations(docs, alignment.Tokenizers.public()).collect()}
    assert table == {k: (n, n == best[k[1]]) for k, n in counts.items()}


def test_without_the_faster_engine_the_same(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    t = alignment.Tokenizers.public()
    slow = alignment.alignment_report(docs, alignment.Tokenizers(t.a, t.b))
    assert sorted(slow.collect()) == sorted(alignment.alignment_report(docs, t).collect())


def test_groups_are_whole_and_tables_may_be_empty(spark):
    t = alignment.Tokenizers.public()
    a, b = t.load()
    pairs = alignment.Pairs(a.bytes_of, b.bytes_of, b.is_byte)
    docs = spark.createDataFrame([(1, "Two words")], "doc_id long, text string")
    row = alignment.aligned(docs, t, pairs, with_groups=True).first()
    ids = [g.split("|") for g in row.groups.split(";")]
    assert b"".join(a.bytes_of[int(i)] for g in ids for i in g[0].split(",")) == b" Two words" == b"".join(b.bytes_of[int(i)] for g in ids for i in g[1].split(","))
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256
    assert alignment.alignment_report(docs.where("false")).collect() == []
    assert alignment.translations(docs.where("false"), t).collect() == []


def test_tokens_of_equal_bytes_are_refused():
    with pytest.raises(ValueError):
        alignment.Pairs([b"a"], [b"a", b"a"], np.array([False, False]))
