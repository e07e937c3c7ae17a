"""Best-fit packing: best-two-fit over shards of token lengths.

Documents are tokenised where they are read, cut only if longer than a sequence, and only (id, piece, start, length,
checksum) go on. These small rows are dealt evenly, whatever their contents, into shards of about `shard_rows`. A
shard fills one sequence after the other greedily, the longest piece that fits first; then it takes out the smallest
piece where two unpacked pieces fill the wider gap more tightly. A shard leaves at most one sequence ill-filled, so a
corpus needs at most one sequence a shard more than if packed as one.

Nulls: a null text is empty, and an empty text is the closing token alone; null ids stay null. Repeated rows are
packed each. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import written

SEQUENCE, CLOSING, SHARD_ROWS = 4096, 1, 4096
#: Words whose ids a Python worker remembers.
REMEMBERED = 600_000


def _ranges(kinds: str) -> str:
    """The letters below U+0250 of the given general categories, as the inside of a character class."""
    return "".join(f"\\u{i:04x}" for i in range(0x250) if unicodedata.category(chr(i))[0] in kinds)


#: Letters below U+0250 whose small ones aren't.
_AWAY = "".join(chr(i) for i in range(0x250) if max(chr(i).lower()) >= "\u0250")
#: What stands for a byte in the words of a byte-level model: its own character if that can be seen, else one from U+0100 on.
_SEEN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _SEEN)}


class WordIds:
    """Ids of texts by a tokenizer that splits texts into words and treats each word alone, the words' ids being remembered.

    Its way of splitting is followed for texts of plain Latin letters; any other text goes through the tokenizer whole.
    So does every text if the file says that it splits otherwise.
    """

    #: What the file must say for that: its normal form and its words.
    NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}

    #: Beside other scripts: controls, which differ between engines, and what may start a special token.
    other = re.compile(f"[\x00-\x08\x0e-\x1f\x7f-\xa0{_AWAY}ɐ-\U0010ffff]|<\\|")
    word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_ranges('L')}]+|[{_ranges('N')}]|[^\\s{_ranges('LN')}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        first, *rest = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
        rest_fine = len(rest) == 1 and rest[0].get("type") == "ByteLevel" and not rest[0].get("add_prefix_space") and not rest[0].get("use_regex")
        self.by_words = said.get("normalizer") == self.NORMAL and first == self.SPLIT and rest_fine

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encodes words one by one; normal forms and splitting are behind them, so that only the tokenizer's model is left to ask."""
        tokenize = self.tokenizer.model.tokenize
        for w in words:
            ids = [t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES))]
            self.known[w] = struct.pack(f"<{len(ids)}I", *ids)

    def of(self, text: str) -> bytes:
        """The text's ids as little-endian 32-bit integers."""
        if not self.by_words or self.other.search(text):
            return self._encode(text)
        words = self.word.findall(text.lower())
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            self._learn(list(set(words).difference(known)))
            return b"".join([known[w] for w in words])


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece. tokenizer: the path of its file on the executors."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds(tokenizer)
        end = np.array([CLOSING], "<u4").tobytes()
        for batch in batches:
            rows = []
            for at, text in enumerate(batch.column(1)):
                packed = memoryview(ids.of(text.as_py() or "") + end)
                n = len(packed) // 4
                rows += [(at, k, s, min(sequence, n - s), zlib.crc32(packed[4 * s : 4 * (s + sequence)])) for k, s in enumerate(range(0, n, sequence))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(work, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def best_two_fit(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1 to sequence)."""
    order = np.argsort(lengths, kind="stable")
    stacks: dict[int, list[int]] = {}
    for at in order[::-1]:
        stacks.setdefault(int(lengths[at]), []).append(int(at))
    there = sorted(stacks)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def take(n: int) -> int:
        at = stacks[n].pop()
        if not stacks[n]:
            del stacks[n], there[bisect_right(there, n) - 1]
        return at

    def put_back(n: int, at: int) -> None:
        if n not in stacks:
            stacks[n] = []
            there.insert(bisect_right(there, n), n)
        stacks[n].append(at)

    def best_pair(room: int, least: int) -> tuple[int, int] | None:
        """The two unpacked lengths of the largest sum in (least, room]."""
        best, found = least, None
        low, high = 0, bisect_right(there, room) - 1
        while low <= high and best < room:
            a, b = there[low], there[high]
            if a + b > room:
                high -= 1
                continue
            if a + b > best and (low < high or len(stacks[a]) > 1):
                best, found = a + b, (a, b)
            low += 1
        return found

    current = 0
    while there:
        inside: list[tuple[int, int]] = []
        gap = sequence
        while there and (k := bisect_right(there, gap)):
            n = there[k - 1]
            inside.append((n, take(n)))
            gap -= n
        if gap and len(there) and len(inside):
            least, at = inside[-1]  # the last one is the smallest
            if pair := best_pair(gap + least, least):
                inside.pop()
                inside += [(n, take(n)) for n in pair]
                put_back(least, at)
        place = 0
        for n, at in inside:
            bins[at], offsets[at] = current, place
            place += n
        current += 1
    return bins, offsets


def pack(cut: DataFrame, sequence: int = SEQUENCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows with a `length` of 1 to sequence: all their columns, sequence_id and offset."""
    cut = written(cut, "pieces")
    shards = max(1, -(-cut.count() // shard_rows))
    # a row's number in the written files, not its contents, decides its shard: no value can fill one
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))

    def work(rows: pa.Table) -> pa.Table:
        b, o = best_two_fit(rows["length"].to_numpy(), sequence)
        shard = rows["shard"].to_numpy().astype(np.int64)
        return rows.drop_columns(["shard"]).append_column("sequence_id", pa.array((shard << 32) + b)).append_column("offset", pa.array(o))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return dealt.groupBy("shard").applyInArrow(work, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    return pack(pieces(docs, tokenizer, sequence), sequence)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file lies, by the module that ships it."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
