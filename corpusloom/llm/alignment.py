"""Cross-tokenizer alignment: each distinct text is tokenised twice and aligned once, for the whole corpus.

Tokenizer A is a byte-level BPE that reads a space and the text, B a BPE of pieces with byte fallback that puts the
space there itself. Texts are shuffled by their full contents into distinct ones with their numbers of rows. Of each,
the byte offsets where both an A and a B token end cut the tokens into groups; no token is empty, so each of these
offsets is one link: the A token and the B token that end there. A pair's count is how many links of the corpus, over
all rows, hold it. Measures then join the rows again by the text's SHA-256.

A linked pair's tokens end at one byte, so that the shorter one's bytes end the longer one's. The two vocabularies
therefore fix the list of all pairs that can ever be linked (`Pairs`), a few hundred thousand, whatever the corpus
is; links are stored as numbers in it, and counts by pair are an array of that length in every task.

A text has no tokens, so zeros and '', where it is null or empty or its tokens' bytes differ from space and text (with
B: where it holds U+2581). Equal texts get equal results, and repeated rows count each. Ties for a B token's highest
count all count as best. Very long texts are read whole. Null ids stay null. Columns other than the id and the text,
whatever their names, are neither read nor kept. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import small_batches, written

#: So many characters of texts are aligned at once.
LOT = 1 << 20
SPACE = "▁"


class ByteBpe:
    """Tokenizer A by its file; by the same vocabulary as ranks, if given, where that is known to split texts alike."""

    #: Characters on whose kind two versions of Unicode, or two engines, may differ; and runs that a backtracking engine can't take.
    other = re.compile("[\x00-\x08\x0b-\x1f\x7f-\xa0\u0250-\u200f\u2028-\u202f\u205f-\U0010ffff]")
    blanks = re.compile(r"\s{2000}")

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        byte_of = {c: b for b, c in _byte_letters().items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for piece, at in vocab.items():
            self.bytes_of[at] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else b""
        self.fast = None
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as f:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            if all(self.bytes_of[at] == b for b, at in known.items()):
                self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not self.other.search(text) and not self.blanks.search(text):
            return np.array(self.fast.encode_ordinary(text), np.int32)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class PieceBpe:
    """Tokenizer B by its file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes_of = [self._bytes(i) for i in range(len(self.model))]
        self.is_byte = np.array([self.model.is_byte(i) for i in range(len(self.model))])

    def _bytes(self, i: int) -> bytes:
        if self.model.is_control(i) or self.model.is_unknown(i):
            return b""
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace(SPACE, " ").encode()

    def ids(self, text: str) -> np.ndarray | None:
        """The ids of space and text; none if their bytes differ from these."""
        ids = self.model.encode(text)
        if b"".join([self.bytes_of[i] for i in ids]) != b" " + text.encode():
            return None
        return np.array(ids, np.int32)


class Pairs:
    """All pairs of an A and a B token of which one's bytes end the other's, numbered in order of (A id, B id).

    Of two linked tokens the longer one and the other's length tell the pair, but that B has single bytes twice, as
    pieces and as bytes; a byte's length is taken as 0. So a pair's number is looked up by these.
    """

    def __init__(self, a: list[bytes], b: list[bytes], is_byte: np.ndarray):
        in_a, in_b = ({}, {})
        for known, of in ((in_a, a), (in_b, b)):
            for i, x in enumerate(of):
                if x:
                    known.setdefault(x, []).append(i)
        found = {(i << 32) | j for x, at in in_a.items() for k in range(len(x)) for j in in_b.get(x[k:], ()) for i in at}
        found |= {(i << 32) | j for x, at in in_b.items() for k in range(len(x)) for i in in_a.get(x[k:], ()) for j in at}
        codes = np.array(sorted(found), np.int64)
        self.a_ids, self.b_ids = codes >> 32, codes & 0xFFFFFFFF
        self.size_a, self.size_b = (np.array([len(x) for x in of], np.int64) for of in (a, b))
        self.said_b = np.where(is_byte, 0, self.size_b)
        self.of_a, self.of_b = (np.concatenate([[0], np.cumsum(size + 1)[:-1]]) for size in (self.size_a, self.size_b))
        self.by_a, self.by_b = (np.zeros(int((size + 1).sum()), np.int32) for size in (self.size_a, self.size_b))
        every = np.arange(len(codes), dtype=np.int32)
        short = self.size_b[self.b_ids] <= self.size_a[self.a_ids]
        self.by_a[(self.of_a[self.a_ids] + self.said_b[self.b_ids])[short]] = every[short]
        self.by_b[(self.of_b[self.b_ids] + self.size_a[self.a_ids])[~short]] = every[~short]
        if not (self.numbers(self.a_ids, self.b_ids) == every).all():
            raise ValueError("two tokens of one tokenizer stand for the same bytes")

    def __len__(self) -> int:
        return len(self.a_ids)

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size_a = self.size_a[a]
        short = self.size_b[b] <= size_a
        out = np.empty(len(a), np.int32)
        out[short] = self.by_a[self.of_a[a[short]] + self.said_b[b[short]]]
        out[~short] = self.by_b[self.of_b[b[~short]] + size_a[~short]]
        return out


class Decimals:
    """Ids in decimal with a letter behind each, for many at once."""

    def __init__(self, most: int):
        said = np.array([str(i) for i in range(most)], f"S{len(str(most)) + 1}")
        self.table = said.view(np.uint8).reshape(most, -1).copy()
        self.size = np.char.str_len(said).astype(np.int64)

    def joined(self, ids: np.ndarray, letters: np.ndarray) -> bytes:
        rows = self.table[ids]
        rows[np.arange(len(ids)), self.size[ids]] = letters
        return rows[rows > 0].tobytes()


def cut(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The A and the B token (by number) that end each group of one text, or of several, one behind the other."""
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    ends = np.zeros(int(end_a[-1]) + 1, bool)
    ends[end_a] = True
    last_b = np.flatnonzero(ends[end_b])
    ends[:] = False
    ends[end_b[last_b]] = True
    return np.flatnonzero(ends[end_a]), last_b


def groups_text(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, said: Decimals) -> bytes:
    """`a1,a2|b1;a3|b2,b3;`."""
    n = len(a) + len(b)
    # an A token stands behind the B tokens of earlier groups, a B token behind the A tokens of its own group, too
    size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    at_a = np.arange(len(a)) + np.repeat(np.cumsum(size_b) - size_b, size_a)
    at_b = np.arange(len(b)) + np.repeat(last_a + 1, size_b)
    ids, letters = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    letters[at_a[last_a]], letters[at_b[last_b]] = ord("|"), ord(";")
    return said.joined(ids, letters)


@dataclass
class Tokenizers:
    """Paths of the two tokenizers' files on the executors; ranks and pattern: A's vocabulary for a faster engine, if any."""

    a: str
    b: str
    ranks: str | None = None
    pattern: str | None = None

    @staticmethod
    def public() -> Tokenizers:
        import public_tokenizers as public

        return Tokenizers(str(public.path("byte_bpe_50k.json")), str(public.path("piece_bpe_32k.model")), str(public.path("byte_bpe_50k.tiktoken")), public.PATTERN)

    def load(self) -> tuple[ByteBpe, PieceBpe]:
        return ByteBpe(self.a, self.ranks, self.pattern), PieceBpe(self.b)


def aligned(docs: DataFrame, tokenizers: Tokenizers, pairs: Pairs, text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """Once for each distinct text (null: empty): key (its SHA-256), n (rows), n_a, n_b, n_groups, groups_sha256, links
    (numbers of pairs, 32 bits each) and, with_groups, the groups themselves. Texts without tokens have zeros."""
    texts = small_batches(docs).groupBy(F.coalesce(docs[text_col], F.lit("")).alias("text")).agg(F.count("*").alias("n")).select(F.unhex(F.sha2("text", 256)).alias("key"), "n", "text")
    schema = "key binary, n long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary" + ", groups string" * with_groups

    def measured(texts: list[str], tok_a: ByteBpe, tok_b: PieceBpe, said: Decimals) -> list[tuple]:
        out: list[tuple] = [(0, 0, 0, "", b"", "")] * len(texts)
        at, a, b = [], [], []
        for k, t in enumerate(texts):
            if t and (ids := tok_b.ids(t)) is not None:
                at.append(k)
                b.append(ids)
                a.append(tok_a.ids(" " + t))
        if not at:
            return out
        n_a, n_b = (np.array([len(x) for x in each]) for each in (a, b))
        all_a, all_b = np.concatenate(a), np.concatenate(b)
        last_a, last_b = cut(all_a, all_b, pairs.size_a, pairs.size_b)
        # texts end where groups end
        ends = np.searchsorted(last_a, np.cumsum(n_a) - 1) + 1
        links = pairs.numbers(all_a[last_a], all_b[last_b])
        groups = groups_text(all_a, all_b, last_a, last_b, said)
        chars = np.concatenate([[0], np.cumsum(said.size[all_a] + 1)])[np.cumsum(n_a)] + np.concatenate([[0], np.cumsum(said.size[all_b] + 1)])[np.cumsum(n_b)]
        g = c = 0
        for k, i, j, end, char in zip(at, n_a.tolist(), n_b.tolist(), ends.tolist(), chars.tolist(), strict=True):
            own = groups[c : char - 1]
            out[k] = (i, j, end - g, hashlib.sha256(own).hexdigest(), links[g:end].tobytes(), own.decode() if with_groups else "")
            g, c = end, char
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok_a, tok_b = tokenizers.load()
        said = Decimals(max(len(tok_a.bytes_of), len(tok_b.bytes_of)))
        for batch in batches:
            rows, lot, held = [], [], 0
            for text in batch["text"]:
                lot.append(text.as_py())
                held += len(lot[-1])
                if held >= LOT:
                    rows += measured(lot, tok_a, tok_b, said)
                    lot, held = [], 0
            rows += measured(lot, tok_a, tok_b, said)
            n_a, n_b, n, digest, links, groups = zip(*rows, strict=True) if rows else ((),) * 6
            cols = [pa.array(x, pa.int64()) for x in (n_a, n_b, n)] + [pa.array(digest, pa.string()), pa.array(links, pa.binary())] + [pa.array(groups, pa.string())] * with_groups
            yield pa.RecordBatch.from_arrays([batch["key"], batch["n"], *cols], names=["key", "n", "n_a", "n_b", "n_groups", "groups_sha256", "links", *["groups"] * with_groups])

    return texts.mapInArrow(work, schema)


def counts(found: DataFrame, pairs: Pairs) -> DataFrame:
    """pair (its number), n: how many links of all rows hold it. At most a row for each possible pair."""
    length = len(pairs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, np.int64)
        for batch in batches:
            each = [np.frombuffer(x.as_buffer(), "<i4") for x in batch["links"]]
            n = np.repeat(batch["n"].to_numpy(), [len(x) for x in each])
            at, which = np.unique(np.concatenate([*each, np.zeros(0, np.int32)]), return_inverse=True)
            np.add.at(total, at, np.bincount(which, n, len(at)).astype(np.int64))  # sums below 2 ** 53 are exact
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    return found.select("n", "links").mapInArrow(work, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def translations(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """a, b (ids), n (links of all rows that hold the pair), best (whether no other A token is linked with b more often)."""
    a, b = tokenizers.load()
    pairs = Pairs(a.bytes_of, b.bytes_of, b.is_byte)
    spark = docs.sparkSession
    look = spark.createDataFrame(pa.table({"pair": np.arange(len(pairs), dtype=np.int32), "a": pairs.a_ids.astype(np.int32), "b": pairs.b_ids.astype(np.int32)}))
    n = counts(written(aligned(docs, tokenizers, pairs), "aligned"), pairs).join(F.broadcast(look), "pair")  # the vocabularies bound it
    best = n.groupBy("b").agg(F.max("n").alias("most"))
    return n.join(best, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_report(docs: DataFrame, tokenizers: Tokenizers | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    tokenizers = tokenizers or Tokenizers.public()
    a, b = tokenizers.load()
    pairs = Pairs(a.bytes_of, b.bytes_of, b.is_byte)
    found = written(aligned(docs, tokenizers, pairs, text_col), "aligned", compression="zstd")
    got = counts(found, pairs).toArrow()  # a row for each possible pair at most, which the vocabularies bound
    count = np.zeros(len(pairs), np.int64)
    count[got["pair"].to_numpy()] = got["n"].to_numpy()
    most = np.zeros(len(b.bytes_of), np.int64)
    np.maximum.at(most, pairs.b_ids, count)
    best = count == most[pairs.b_ids]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(int(best[at].sum()), int(count[at].sum())) for at in (np.frombuffer(x.as_buffer(), "<i4") for x in batch["links"])]
            n, total = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("key", "n_a", "n_b", "n_groups", "groups_sha256")), pa.array(n, pa.int64()), pa.array(total, pa.int64())], names=["key", "n_a", "n_b", "n_groups", "groups_sha256", "n_best", "count_sum"])

    measures = found.select("key", "n_a", "n_b", "n_groups", "groups_sha256", "links").mapInArrow(work, "key binary, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long")
    # written, so that the join is split at a text of very many rows; sorted and merged at any size
    measures = written(measures, "measures", compression="zstd").hint("merge")
    rows = docs.select(docs[id_col].alias("doc_id"), F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)).alias("key"))
    return rows.join(measures, "key").select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")

