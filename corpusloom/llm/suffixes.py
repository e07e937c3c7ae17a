"""Suffix-array dedup: each byte that a string of `length` bytes covers goes if that string also starts elsewhere.

Sorting every suffix of a corpus would move many times its bytes, so the sort is sparse. Each window (a string of
`length` bytes) has an anchor, the place of its least 64-byte hash, the last of equal ones; equal windows have
equal anchors at equal offsets. Neighbouring windows with one anchor form a stretch of at most 337 bytes.

1. Stretches are made where a document is read: rows of 40 bytes, about one for each 70 bytes of text, with a hash of
   the anchor and a keyed digest of the stretch. A stretch whose anchor occurs once ends here; if all stretches of an
   anchor are equal, all their windows repeat.
2. Where stretches of an anchor differ, each different one brings its bytes once. A task sorts what follows the
   anchors, and what precedes them, as suffixes: a vectorised mergesort in which two suffixes are compared by their
   common extension, found by binary search over prefix hashes. Neighbours' extensions are then verified byte by
   byte. A window repeats if two stretches agree in as many bytes before and behind the anchor as it has there.
3. An anchor with more than `most` different stretches (say, the end of a passage in very many documents) is too much
   for one sort, so its group is split by more context. Each window reaches far behind the anchor or far before it:
   a stretch is cut into the windows that reach back to at least the middle of the range and the others, which reach
   as far ahead, and either part goes to the group of those with the same bytes there. The parts are stretches like
   the first ones and take the same path, again and again until all groups are small or all alike; each round halves
   the range, so eight of them reach single windows. Groups of any size are resolved by this one way.

Bytes are compared where stretches differ. Equal stretches are told by a 64-bit digest under a key drawn for each run
(BLAKE2), beside the equal hash of their anchor: texts can't be made to collide, and chance ones are one in 2**64.

Nulls: a null text has no bytes; null ids stay null. Rows that repeat id and text are separate occurrences, and share
their result. Texts shorter than `length` lose nothing. An empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import small_batches, written

#: MOST: stretches that a task sorts at once, some 3 MB; no group is larger.
LENGTH, ANCHOR, MOST = 200, 64, 8192
_LOW = np.uint64(0xFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Polynomial hashes, modulo 2**64, of any slices of bytes: a slice's running sum divided by its place's power."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.value = _mixed(np.arange(1, 257, dtype=np.uint64))
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.powers = self.back = np.ones(1, np.uint64)

    def running(self, data: np.ndarray) -> np.ndarray:
        if len(self.powers) < len(data) + 1:
            size = 1 << (len(data) + 1).bit_length()
            self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, self.base, np.uint64))])
            self.back = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, self.inverse, np.uint64))])
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.powers[: len(data)], out=out[1:])
        return out

    def of(self, running: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (running[stop] - running[start]) * self.back[start]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours: minima from blocks' starts and to blocks' ends."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, 0xFFFFFFFFFFFFFFFF, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def digests(data: bytes, start: np.ndarray, stop: np.ndarray, off: np.ndarray, key: bytes) -> np.ndarray:
    """A keyed 64-bit digest of each slice and the anchor's offset in it."""
    view = memoryview(data)
    salts = [bytes([i]) * 16 for i in range(256)]
    return np.frombuffer(b"".join([blake2b(view[a:b], digest_size=8, key=key, salt=salts[o]).digest() for a, b, o in zip(start.tolist(), stop.tolist(), off.tolist(), strict=True)]), np.int64)


def stretches(data: np.ndarray, ends: np.ndarray, h: Hashes, length: int, anchor: int, secret: bytes = b"") -> tuple[np.ndarray, ...]:
    """first window, number of windows, anchor's offset in it, anchor hash and stretch digest, for texts that end at `ends`."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    r = h.running(data)
    at = np.arange(n - anchor + 1)
    k = _mixed((r[anchor:] - r[: n - anchor + 1]) * h.back[: n - anchor + 1])
    key = (k & ~_LOW) | (_LOW - at.astype(np.uint64))
    place = (_LOW - (_least(key, length - anchor + 1) & _LOW)).astype(np.int64)
    whole = np.zeros(n + 1, np.int64)  # windows that would cross a text's end are left out
    for e, b in zip(ends, np.concatenate([[0], ends[:-1]]), strict=True):
        whole[max(b, e - length + 1) : e] = 1
    s = np.flatnonzero(whole[: n - length + 1] == 0)
    if not len(s):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    p = place[s]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)])
    i = np.flatnonzero(new)
    a, p = s[i], p[i]
    count = np.diff(np.concatenate([i, [len(s)]]))
    off = p - a
    return a, count, off, k[p].view(np.int64), digests(data.tobytes(), a, a + count - 1 + length, off, secret)


def _buffers(texts: list[bytes], most: int, overlap: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text's number, offset, bytes) of about `most` bytes; longer texts come in overlapping parts."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for o in range(0, max(1, len(t) - overlap), most):
            part = t[o : o + most + overlap]
            held.append((i, o, part))
            size += len(part)
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def stretch_rows(d: DataFrame, length: int, anchor: int, secret: bytes = b"") -> DataFrame:
    """k1, k2, at (first byte << 16 | windows << 8 | anchor's offset), kh, sh of each stretch of d (k1, k2, bytes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hashes()
        for batch in batches:
            k1, k2 = batch["k1"].to_numpy(), batch["k2"].to_numpy()
            for parts in _buffers(batch["bytes"].to_pylist(), 1 << 19, length - 1):
                ends = np.cumsum([len(b) for _, _, b in parts])
                begins = np.concatenate([[0], ends[:-1]])
                a, count, off, kh, sh = stretches(np.frombuffer(b"".join(b for _, _, b in parts), np.uint8), ends, h, length, anchor, secret)
                if len(a):
                    part = np.searchsorted(ends, a, side="right")
                    doc = np.array([i for i, _, _ in parts])[part]
                    first = a - begins[part] + np.array([o for _, o, _ in parts])[part]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[doc], k2[doc], first << 16 | count << 8 | off, kh, sh)], names=["k1", "k2", "at", "kh", "sh"])

    return d.mapInArrow(work, "k1 long, k2 long, at long, kh long, sh long")


def sort_suffixes(text: np.ndarray, reach: np.ndarray, base: Hashes) -> np.ndarray:
    """The order of the rows of `text` (bytes, `reach` of them valid in each) as strings, by a mergesort of all runs at once."""
    n, width = text.shape
    running = np.zeros((n, width + 1), np.uint64)
    np.cumsum(base.value[text] * base.powers[:width], axis=1, out=running[:, 1:])

    def less(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before y, equal ones as `ties` says: the common extension is the last length of equal hashes."""
        most = np.minimum(reach[x], reach[y])
        low, high = np.zeros(len(x), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = running[x, mid] == running[y, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        inside = low < most
        at = np.minimum(low, width - 1)
        by_byte = text[x, at] < text[y, at]
        return np.where(inside, by_byte, np.where(reach[x] == reach[y], ties, reach[x] < reach[y]))

    order, run = np.arange(n), 1
    while run < n:
        i = np.arange(n)
        start = i // (2 * run) * (2 * run)
        middle, stop = np.minimum(start + run, n), np.minimum(start + 2 * run, n)
        left = i < middle
        low, high = np.where(left, middle, start), np.where(left, stop, middle)
        origin = low.copy()
        while (low < high).any():  # each one's place among the other run's
            open_ = low < high
            mid = np.minimum((low + high) >> 1, n - 1)
            before = less(order[mid], order[i], ~left) & open_
            low, high = np.where(before, mid + 1, low), np.where(open_ & ~before, mid, high)
        place = np.where(left, i + (low - origin), i - run + (low - origin))
        merged = np.empty(n, np.int64)
        merged[place] = order
        order, run = merged, 2 * run
    return order


def _classes(rows: list[np.ndarray], base: Hashes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows as suffixes, and each one's verified common extension with the one before."""
    reach = np.array([len(r) for r in rows])
    text = np.zeros((len(rows), length), np.uint8)
    for i, r in enumerate(rows):
        text[i, : len(r)] = r
    order = sort_suffixes(text, reach, base)
    a, b = order[:-1], order[1:]
    same = np.cumprod(text[a] == text[b], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    return order, np.concatenate([[0], np.minimum(same, np.minimum(reach[a], reach[b]))])


def repeated_in(bodies: list[bytes], count: np.ndarray, off: np.ndarray, group: np.ndarray, length: int, base: Hashes) -> np.ndarray:
    """For each stretch and window (up to 255), whether an equal window stands in another place of the same group."""
    base.running(np.zeros(length, np.uint8))
    data = [np.frombuffer(b, np.uint8) for b in bodies]
    behind = [d[o : o + length] for d, o in zip(data, off, strict=True)]
    before = [d[:o][::-1] for d, o in zip(data, off, strict=True)]
    (order_b, ext_b), (order_a, ext_a) = _classes(behind, base, length), _classes(before, base, length)
    out = np.zeros((len(data), int(count.max())), bool)
    for o in range(int(off.max()) + 1):  # bytes before the anchor
        first = off - o  # the window's number in each stretch
        has = (first >= 0) & (first < count)
        if has.sum() < 2:
            continue
        right, left = np.empty(len(data), np.int64), np.empty(len(data), np.int64)
        right[order_b] = np.cumsum(ext_b < length - o)
        left[order_a] = np.cumsum(ext_a < o) if o else 0
        at = np.flatnonzero(has)
        key = (group[at] * (len(data) + 1) + right[at]) * (len(data) + 1) + left[at]
        _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        again = n[inverse] > 1
        out[at[again], first[at[again]]] = True
    return out


def halves(body: bytes, first: int, count: int, off: int, p: int, q: int, kh: int, length: int, anchor: int, key: bytes) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """first, count, off, p, q, group, digest of the two parts of a stretch whose group shares p bytes before the anchor and q behind it."""
    a, b = off - count + 1, off  # fewest and most bytes that a window has before the anchor
    middle = (p + length - anchor - q + 1) // 2
    for lo, hi, np_, nq in ((max(a, middle), b, middle, q), (a, min(b, middle - 1), p, length - anchor - middle + 1)):
        if lo <= hi:
            part = body[off - hi : off - lo + length]
            shared = body[off - np_ : off + anchor + nq]
            group = blake2b(shared, digest_size=8, key=key, salt=(kh & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little") + bytes([np_, nq]))
            mark = blake2b(part, digest_size=8, key=key, salt=bytes([hi]) * 16)
            yield first + off - hi, hi - lo + 1, hi, np_, nq, *(int.from_bytes(x.digest(), "little", signed=True) for x in (group, mark))


_STRETCH = "k1 long, k2 long, at long, kh long, sh long, p int, q int, n long"


def _bodies(joined: DataFrame, length: int, anchor: int, key: bytes) -> DataFrame:
    """Of each wanted stretch (k1, k2, at, kh, n, p, q, hot): its bytes or, if hot, the rows of its two parts with null body."""
    kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64(), pa.binary()]
    names = ["k1", "k2", "at", "kh", "sh", "p", "q", "n", "body"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows: list[tuple] = []
            for data, wanted in zip(batch["bytes"].to_pylist(), batch["wanted"].to_pylist(), strict=True):
                last, before = (wanted[0]["k1"], wanted[0]["k2"]), last
                if last == before:  # a repeated row: the sort of the join put it behind its like
                    continue
                for x in wanted:
                    first, count, off = x["at"] >> 16, x["at"] >> 8 & 0xFF, x["at"] & 0xFF
                    body = data[first : first + count - 1 + length]
                    if x["hot"]:
                        rows += [(x["k1"], x["k2"], f << 16 | c << 8 | o, kh, sh, p, q, x["n"], None) for f, c, o, p, q, kh, sh in halves(body, first, count, off, x["p"], x["q"], x["kh"], length, anchor, key)]
                    else:
                        rows.append((x["k1"], x["k2"], x["at"], x["kh"], 0, x["p"], x["q"], x["n"], body))
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return joined.mapInArrow(work, f"{_STRETCH}, body binary")


def _sorted_groups(bodies: DataFrame, length: int) -> DataFrame:
    """k1, k2, start, stop: bytes that repeated windows cover, of stretches that occur once. Rows come sorted by kh."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = Hashes()
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            at, kh = t["at"].to_numpy(), t["kh"].to_numpy()
            first, count, off = at >> 16, at >> 8 & 0xFF, at & 0xFF
            group = np.cumsum(np.concatenate([[0], (kh[1:] != kh[:-1]).astype(np.int64)]))
            hit = repeated_in(t["body"].to_pylist(), count, off, group, length, base) & (t["n"].to_numpy() == 1)[:, None]
            edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, a = np.nonzero(edge == 1)
            b = np.nonzero(edge == -1)[1]
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(t["k1"].to_numpy()[row]), pa.array(t["k2"].to_numpy()[row]), pa.array(first[row] + a), pa.array(first[row] + b - 1 + length)], names=["k1", "k2", "start", "stop"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < MOST:
                continue
            t = pa.Table.from_batches(held)
            kh = t["kh"].to_numpy()
            cut = int(np.searchsorted(kh, kh[-1]))  # the last group may go on
            for a in range(0, cut, MOST):
                # groups are never parted: a slice ends where a group does
                lo = int(np.searchsorted(kh, kh[a])) if a else 0
                hi = int(np.searchsorted(kh, kh[a + MOST])) if a + MOST < cut else cut
                if hi > lo:
                    yield from done(t.slice(lo, hi - lo))
            held = t.slice(cut).to_batches()
        if held and sum(map(len, held)):
            yield from done(pa.Table.from_batches(held))

    return bodies.mapInArrow(work, "k1 long, k2 long, start long, stop long")


def repeated_spans(d: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, most: int = MOST) -> DataFrame:
    """k1, k2, start, stop: byte ranges of the documents of d (k1, k2, doc_id, bytes) that repeated windows cover."""
    if not 1 <= anchor <= length < anchor + 200:
        raise ValueError("a stretch's windows are counted in eight bits")
    key = os.urandom(16)
    first = F.shiftright("at", 16)
    span = lambda x: x.select("k1", "k2", first.alias("start"), (first + F.shiftright("at", 8).bitwiseAND(F.lit(255)) - 1 + length).alias("stop"))
    zero = F.lit(0)
    rows = stretch_rows(small_batches(d).select("k1", "k2", "bytes"), length, anchor, key).select("*", zero.alias("p"), zero.alias("q"), F.lit(1).cast("long").alias("n"))
    found = []
    while True:
        # n: how often a stretch occurs. Where it is above one, an earlier round has found that all its windows repeat
        groups = rows.groupBy("kh").agg(F.sum("n").alias("all"), F.min("sh").alias("lo"), F.max("sh").alias("hi")).where("all > 1").select("kh", (F.col("lo") == F.col("hi")).alias("pure"))
        # what is joined was written: then Spark splits a join at a key of very many rows, which it can't behind an aggregate
        shared = written(rows.join(written(groups, "groups"), "kh"), "stretches")
        mixed = shared.where("NOT pure")
        kinds = mixed.groupBy("kh", "sh").agg(F.sum("n").alias("n"), F.min(F.struct("k1", "k2", "at", "p", "q")).alias("first"))
        kinds = written(kinds.select("kh", "sh", "n", "first.*"), "kinds")
        copied = mixed.where("n = 1").join(kinds.where("n > 1").select("kh", "sh"), ["kh", "sh"], "left_semi")
        several = written(kinds.groupBy("kh").agg((F.count("*") > most).alias("hot")), "sizes")
        wanted = kinds.join(several, "kh").groupBy("k1", "k2").agg(F.collect_list(F.struct("k1", "k2", "at", "kh", "n", "p", "q", "hot")).alias("wanted"))
        # texts are shuffled once: the caller's join has the same exchange
        bodies = _bodies(d.join(wanted, ["k1", "k2"]).select("bytes", "wanted"), length, anchor, key)
        few = bodies.where("body IS NOT NULL").select("k1", "k2", "at", "kh", "n", "body")
        found += [span(shared.where("pure AND n = 1")), span(copied), _sorted_groups(few.repartition("kh").sortWithinPartitions("kh"), length)]
        if not several.where("hot").take(1):
            break
        rows = written(bodies.where("body IS NULL").drop("body"), "parts")
    return reduce(DataFrame.union, found)


def dedup_bytes(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, spans (removed runs: first byte and byte behind), kept (the remaining bytes)."""
    text = F.coalesce(docs[text_col], F.lit(""))
    said = [docs[id_col].isNull(), docs[id_col], text]
    d = docs.select(F.xxhash64(F.lit(29), *said).alias("k1"), F.xxhash64(F.lit(31), *said).alias("k2"), docs[id_col].alias("doc_id"), text.cast("binary").alias("bytes"))
    id_type = d.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(d, length, most=most).groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, found in zip(batch["bytes"].to_pylist(), batch["spans"], strict=True):
                runs: list[list[int]] = []
                if found.is_valid:
                    x = found.values.flatten()
                    start, stop = x[0].to_numpy(), np.maximum.accumulate(x[1].to_numpy())
                    opens = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1]]))
                    runs = [[int(a), int(b)] for a, b in zip(start[opens], stop[np.concatenate([opens[1:], [len(start)]]) - 1], strict=True)]
                kept = b"".join(data[a:b] for a, b in zip([0, *[r[1] for r in runs]], [*[r[0] for r in runs], len(data)], strict=True)) if runs else data
                out.append((len(data), len(data) - len(kept), [{"start": a, "stop": b} for a, b in runs], kept))
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    joined = d.join(spans, ["k1", "k2"], "left").select("doc_id", "bytes", "spans")
    return joined.mapInArrow(work, f"doc_id {id_type}, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept binary")


def dedup_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return dedup_bytes(docs, length).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
