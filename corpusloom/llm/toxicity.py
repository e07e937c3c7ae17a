"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine, over a block-max inverted index.

Terms are runs of letters, lower-cased. The space has an axis for every term of the examples, none left out. A term
weighs 1 + ln(occurrences in the text), times its inverse document frequency, counted over all documents, times how
far its labels are from chance: (1 + G) / (EVEN + G), where G is the log-likelihood ratio of its counts in toxic and
clean examples. That factor stretches axes and drops none: in plain TF-IDF the few words that make a text toxic
drown among hundreds of rarer ones (see the README for what that costs).

Examples are distinct labelled texts outside the held-out fifth, at most `most` of each label and so many that they
hold EXAMPLE_CHARS characters of each label (the last one may exceed it), taken in the order of a hash of the text.
These bounds, the only ones, keep the index small enough to go with every task at any size of the corpus.

The index keeps for each term a list of (example, weight), parted into blocks of examples, and the largest weight in
each part. For a text, a block's bound is the sum of its terms' weights times those maxima. The most promising blocks
are read first; the others only if their bound reaches the k-th best cosine, so the neighbours are exact. Texts are
looked up several at once: the parts of long lists lie in a table for each block, which is multiplied with the weights
of all texts that open the block; those of the other lists are read one by one. Weights in lists are of single
precision. Whatever may be among the k best within the error of that gets its cosine summed anew in double precision
over the example's own terms, so that no cosine depends on which texts are looked up together. Votes are weighted by
cosine and by how many labelled rows an example stands for, smoothed with the share of toxic rows, and calibrated by
isotonic regression on the examples, each scored without itself.

Null or empty texts, and those that share no term with an example, get one score: the share of toxic rows among
examples without terms, smoothed with that of all rows. Without examples every score is 0. Null ids are held out.
Label rows with null id or label are ignored, and of several labels for an id the largest counts, as for equal
texts. Equally near examples rank by hash. Repeated rows are scored each. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import small_batches, written

EXAMPLES, EXAMPLE_CHARS, NEIGHBOURS, BLOCK = 2000, 8 << 20, 15, 64
#: A term whose log-likelihood ratio is so much has about half the stretch of one that tells all.
EVEN = 30.0
#: Blocks that are read before bounds are compared.
FIRST_BLOCKS = 4
#: A list that holds one in so many of the examples is long.
LONG = 16
#: Texts that are looked up at once are so many at most, and their lists hold so many entries (a single text's may hold more).
TEXTS, ENTRIES = 128, 4 << 20
_WORD = re.compile(r"[^\W\d_]+")
#: The characters below U+10000, in UTF-16, with a space for each that is no letter.
_LETTERS = np.full(1 << 16, ord(" "), "<u2")
for _m in _WORD.finditer("".join(map(chr, range(1 << 16)))):
    _LETTERS[_m.start() : _m.end()] = np.arange(_m.start(), _m.end())


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    packed = text.encode("utf-16-le", "surrogatepass")
    if len(packed) > 2 * len(text):  # a character beyond
        return _WORD.findall(text)
    return _LETTERS[np.frombuffer(packed, "<u2")].tobytes().decode("utf-16-le").split()


def _spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The numbers of all the ranges (none of them empty), one after the other."""
    if not len(lens):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    out = np.ones(int(ends[-1]), np.int64)
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - starts[:-1] - lens[:-1] + 1
    return np.cumsum(out, out=out)


def stretch(x: np.ndarray, y: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """(1 + G) / (EVEN + G) of terms that stand in x of n1 toxic and y of n0 clean examples."""

    def part(seen: np.ndarray, of: np.ndarray, n: int, rate: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(n * rate, 1e-300)), 0.0)

    rate = (x + y) / max(1, n1 + n0)
    g = 2 * (part(x, n1, n1, rate) + part(n1 - x, n1, n1, 1 - rate) + part(y, n0, n0, rate) + part(n0 - y, n0, n0, 1 - rate))
    return (1 + np.maximum(g, 0)) / (EVEN + np.maximum(g, 0))


@dataclass
class Index:
    """Examples as unit vectors, in posting lists by term that are parted into blocks with their largest weights."""

    number: dict[str, int]
    scale: np.ndarray
    rows: list[tuple[np.ndarray, np.ndarray]]  # terms and occurrences of each example
    labels: np.ndarray
    stands_for: np.ndarray
    ids: list[str]
    prior: float = 0.0
    curve: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(1), np.zeros(1)))
    none: float = 0.0

    def __post_init__(self) -> None:
        n, terms = len(self.rows), len(self.scale)
        size = np.array([len(t) for t, _ in self.rows], np.int64)
        who = np.repeat(np.arange(n), size)
        term = np.concatenate([t for t, _ in self.rows]) if n else np.zeros(0, np.int64)
        # alike examples share blocks: by label, then by which of the commonest terms they hold
        common = np.argsort(-np.bincount(term, minlength=terms), kind="stable")[:24]
        holds = np.zeros((n, len(common) + 1), bool)
        for k, t in enumerate(common):
            holds[who[term == t], k + 1] = True
        holds[:, 0] = self.labels > 0
        order = np.lexsort(holds.T[::-1]) if n else np.zeros(0, np.int64)
        self.place = np.empty(n, np.int64)  # of an example in the index
        self.place[order] = np.arange(n)
        self.order = order
        weight = np.concatenate([self.vector(t, c) for t, c in self.rows]) if n else np.zeros(0)
        # the examples' own terms, one example after the other
        self.own_size, self.own_term, self.own_weight = size, term.astype(np.int32), weight
        self.own_start = np.cumsum(size) - size
        # the lists are sent to every task: narrow numbers, the largest weights rounded up
        at = self.place[who]
        by = np.lexsort((at, term))
        term, self.example, weight = term[by], at[by].astype(np.int32), weight[by]
        self.weight = weight.astype(np.float32)
        block = self.example // BLOCK
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.start, self.size = new.astype(np.int32), np.diff(np.concatenate([new, [len(term)]])).astype(np.int32)
        self.block = block[new]
        self.most = np.nextafter((np.maximum.reduceat(weight, new) if len(new) else np.zeros(0)).astype(np.float32), np.float32(np.inf))
        self.first = np.searchsorted(term[new], np.arange(terms + 1)).astype(np.int32)
        self.blocks = -(-n // BLOCK)
        self.held = np.bincount(term, minlength=terms).astype(np.int32)  # entries of each list
        long = np.flatnonzero(self.held >= max(1, n) / LONG)
        self.long = np.full(terms, -1, np.int32)  # a long list's number
        self.long[long] = np.arange(len(long))

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the long lists: weights by block, list and place in the block, and the largest ones by list and block."""
        long = np.flatnonzero(self.long >= 0)
        parts = _spread(self.first[long], self.first[long + 1] - self.first[long])
        i, number = _spread(self.start[parts], self.size[parts]), np.repeat(np.arange(len(long)), self.held[long])
        weights, most = np.zeros((self.blocks, len(long), BLOCK), np.float32), np.zeros((len(long), self.blocks))
        weights[self.example[i] // BLOCK, number, self.example[i] % BLOCK] = self.weight[i]
        most[np.repeat(np.arange(len(long)), self.first[long + 1] - self.first[long]), self.block[parts]] = self.most[parts]
        return weights, most

    def vector(self, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The weights of a text's terms at length one."""
        w = (1 + np.log(times)) * self.scale[terms]
        return w / math.sqrt(float(w @ w)) if len(w) else w

    def row(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The terms among a text's words, each once, and how often they occur."""
        found = np.array([t for t in map(self.number.get, words) if t is not None], np.int64)
        found.sort()
        new = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else found
        return found[new], np.diff(np.append(new, len(found)))

    def nearest(self, row: tuple[np.ndarray, np.ndarray], k: int = NEIGHBOURS, without: int = -1) -> list[tuple[float, int]]:
        """Cosine and example of the k nearest with any term in common; equal ones in the order of the examples."""
        return self.nearest_of([row], k, [without])[0]

    def nearest_of(self, rows: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """`nearest` of each of the texts."""
        return list(self.nearest_each(((t, self.vector(t, times), x) for (t, times), x in zip(rows, without or [-1] * len(rows), strict=True)), k))

    def nearest_each(self, texts: Iterable[tuple[np.ndarray, np.ndarray, int]], k: int = NEIGHBOURS) -> Iterator[list[tuple[float, int]]]:
        """`nearest` of texts that are given by their terms, those terms' weights and the example that is left out; no more of them are held than are looked up at once."""
        group, entries = [], 0
        for text in texts:
            if not self.blocks:
                yield []
                continue
            more = int(self.held[text[0]].sum())
            if len(group) == TEXTS or (entries + more > ENTRIES and group):
                yield from self._together(group, k)
                group, entries = [], 0
            group.append(text)
            entries += more
        if group:
            yield from self._together(group, k)

    def example_vector(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """An example's terms and their weights."""
        own = slice(self.own_start[i], self.own_start[i] + self.own_size[i])
        return self.own_term[own], self.own_weight[own]

    def _together(self, group: list[tuple[np.ndarray, np.ndarray, int]], k: int) -> list[list[tuple[float, int]]]:
        n, blocks = len(group), self.blocks
        tables, tables_most = self.tables
        text = np.repeat(np.arange(n), [len(v) for _, v, _ in group])
        term, w = np.concatenate([t for t, _, _ in group]), np.concatenate([v for _, v, _ in group])
        number = self.long[term]
        long = number >= 0
        wide = np.zeros((n, len(tables_most)))
        wide[text[long], number[long]] = w[long]
        text, term, w = text[~long], term[~long], w[~long]
        begin = self.first[term]
        count = self.first[term + 1] - begin  # at least one: each term stands in an example
        parts = _spread(begin, count)
        w, text, block = np.repeat(w, count), np.repeat(text, count), self.block[parts]
        bound = wide @ tables_most
        wide = wide.astype(np.float32)
        error = 1e-9 + (wide.shape[1] + 4) * 2.0**-23  # two scores' errors at most
        bound += np.bincount(text * blocks + block, weights=w * self.most[parts], minlength=n * blocks).reshape(n, blocks)
        score = np.zeros((n, blocks * BLOCK))
        left_out = [(i, self.place[x]) for i, (_, _, x) in enumerate(group) if x >= 0]

        def read(which: np.ndarray) -> None:
            p = np.flatnonzero(which[text, block])
            size = self.size[parts[p]]
            i = _spread(self.start[parts[p]], size)
            x = np.repeat(w[p], size)
            x *= self.weight[i]
            score.reshape(-1)[:] += np.bincount(np.repeat(text[p] * (blocks * BLOCK), size) + self.example[i], weights=x, minlength=score.size)
            for b in np.flatnonzero(which.any(axis=0)):
                at = np.flatnonzero(which[:, b])
                score[at, b * BLOCK : (b + 1) * BLOCK] += wide[at] @ tables[b]
            for i, x in left_out:
                score[i, x] = 0

        first = np.argsort(-bound, axis=1)[:, :FIRST_BLOCKS]
        open_ = np.zeros((n, blocks), bool)
        np.put_along_axis(open_, first, True, axis=1)
        read(open_)
        seen = np.take_along_axis(score.reshape(n, blocks, BLOCK), first[:, :, None], axis=1).reshape(n, -1)
        least = np.partition(seen, -k, axis=1)[:, -k].reshape(n, 1) if seen.shape[1] >= k else np.zeros((n, 1))
        read(~open_ & (bound > 0) & (bound >= least - error))
        near = (score > 0) & (score >= least - error)
        full, out = np.zeros(len(self.scale)), []
        for (terms, vector, _), scores, found in zip(group, score, near, strict=True):
            at = np.flatnonzero(found)
            if len(at) > k:
                at = at[scores[at] >= np.partition(scores[at], -k)[-k] - error]
            at = self.order[at]
            size = self.own_size[at]
            i = _spread(self.own_start[at], size)
            full[terms] = vector
            cosine = np.add.reduceat(full[self.own_term[i]] * self.own_weight[i], np.cumsum(size) - size) if len(at) else np.zeros(0)
            full[terms] = 0
            best = sorted(zip((-cosine.round(12)).tolist(), at.tolist(), strict=True))[:k]
            out.append([(-s, i) for s, i in best])
        return out

    def votes(self, near: list[tuple[float, int]]) -> float:
        at = [i for _, i in near]
        w = np.array([s for s, _ in near]) * self.stands_for[at]
        smooth = 0.05 * float(self.stands_for.mean())
        return float((w * self.labels[at]).sum() + smooth * self.prior) / float(w.sum() + smooth)

    def calibrate(self, raw: dict[int, float]) -> None:
        """Fits the curve from votes (by example, made without it) to shares, and the share of texts without neighbours."""
        rate = lambda at: float((self.labels * self.stands_for)[at].sum() + self.prior) / float(self.stands_for[at].sum() + 1)
        self.none = rate([i for i in range(len(self.rows)) if i not in raw])
        pools: list[list[float]] = []  # of equal or falling shares: votes' low end and high end, toxic weight, weight
        for x, i in sorted((x, i) for i, x in raw.items()):
            w = float(self.stands_for[i])
            pools.append([x, x, float(self.labels[i]) * w, w])
            while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
                _, hi, a, b = pools.pop()
                pools[-1][1], pools[-1][2], pools[-1][3] = hi, pools[-1][2] + a, pools[-1][3] + b
        if pools:
            xs = [x for p in pools for x in p[:2]]
            ys = [(p[2] + self.prior) / (p[3] + 1) for p in pools for _ in (0, 1)]
            self.curve = (np.array(xs), np.array(ys))

    def score(self, near: list[tuple[float, int]]) -> float:
        return float(np.interp(self.votes(near), *self.curve)) if near else self.none

    @classmethod
    def of(cls, parts: dict) -> Index:
        """An index that was taken apart by `vars`, so that it could be sent as plain numbers and texts."""
        index = cls.__new__(cls)
        vars(index).update(parts)
        return index


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")), F.lit(0)) % 5 == 0


def examples(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """id (a string), at, text, toxic, rows of the examples, and how many labelled rows there are of each label.

    rows: the labelled rows with that text. Ids and hashes decide, and only the chosen texts are moved.
    """
    said = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    text = F.coalesce(docs[text_col], F.lit(""))
    d = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("at"), F.xxhash64(text, F.lit(1)).alias("at2"), F.length(text).alias("n")).where(~held_out(F.col("doc_id")))
    by = d.join(said, "doc_id").groupBy("at", "at2").agg(F.min(F.col("doc_id")).cast("string").alias("id"), F.max("toxic").cast("int").alias("toxic"), F.count("*").alias("rows"), F.first("n").alias("n"))
    by = written(by, "labelled")
    n = {int(r[0]): int(r[1]) for r in by.groupBy("toxic").agg(F.sum("rows")).collect()}
    chosen = []
    for y in (0, 1):
        held = 0
        for r in by.where(F.col("toxic") == y).orderBy("at", "at2").limit(most).collect():
            if held >= EXAMPLE_CHARS:
                break
            held += r["n"]
            chosen.append((r["at"], r["at2"], r["id"], r["toxic"], r["rows"]))
    spark = docs.sparkSession
    look = spark.createDataFrame(chosen, "at long, at2 long, id string, toxic int, rows long")  # at most 2 * most short rows
    whole = docs.select(F.xxhash64(text).alias("at"), F.xxhash64(text, F.lit(1)).alias("at2"), text.alias("text"))
    return whole.join(F.broadcast(look), ["at", "at2"]).groupBy("at", "at2", "id", "toxic", "rows").agg(F.first("text").alias("text")), n


def _counted(docs: DataFrame, number: dict[str, int], text_col: str) -> dict[int, int]:
    """Texts of the whole corpus that hold each term; at -1, all texts."""
    sent = docs.sparkSession.sparkContext.broadcast(number)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        n, texts = np.zeros(len(number), np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                texts += 1
                found = [t for w in set(words_of(text)) if (t := number.get(w)) is not None]
                n[found] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(n[at], texts))], names=["term", "n"])

    counts = docs.select(docs[text_col]).mapInArrow(work, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # a row for each term of the examples
    sent.destroy()
    return dict(zip(found["term"].to_pylist(), found["n"].to_pylist(), strict=True))


def fit(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The calibrated index."""
    return _sent(docs, labels, most, id_col, text_col)[0]


def _sent(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str) -> tuple[Index, Broadcast]:
    """The calibrated index, and its parts before it was calibrated, which go to each Python worker once and not with every task."""
    chosen, n = examples(small_batches(docs), labels, most, id_col, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(words_of(t)) for t in batch["text"].to_pylist()]
            cols = [pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch["at"], batch["at2"], batch["id"], batch["toxic"], batch["rows"], *cols], names=["at", "at2", "id", "toxic", "rows", "words", "times"])

    # bounded by `most` and EXAMPLE_CHARS; the words become numbers column by column
    sample = chosen.mapInArrow(work, "at long, at2 long, id string, toxic int, rows long, words array<string>, times array<int>").toArrow().sort_by([("at", "ascending"), ("at2", "ascending")]).combine_chunks()
    words = sample["words"].combine_chunks().flatten().dictionary_encode() if len(sample) else pa.array([], pa.string()).dictionary_encode()
    number = {w: i for i, w in enumerate(words.dictionary.to_pylist())}
    y = sample["toxic"].to_numpy().astype(float)
    size = np.array([len(x) for x in sample["words"]], np.int64)
    flat, times = words.indices.to_numpy(), (sample["times"].combine_chunks().flatten().to_numpy() if len(sample) else np.zeros(0)).astype(np.int32)
    cuts = np.cumsum(size)[:-1]
    rows = list(zip(np.split(flat.astype(np.int32), cuts), np.split(times, cuts), strict=True)) if len(sample) else []
    label = np.repeat(y, size)
    seen = [np.bincount(flat[label == v], minlength=len(number)).astype(float) for v in (0, 1)]
    ids, copies = sample["id"].to_pylist(), sample["rows"].to_numpy()
    df = _counted(docs, number, text_col)
    idf = np.log((1 + df.get(-1, 0)) / (1 + np.array([df.get(i, 0) for i in range(len(number))], float))) + 1
    scale = idf * stretch(seen[1], seen[0], int((y == 1).sum()), int((y == 0).sum()))
    each = [n.get(v, 0) / max(1, copies[y == v].sum()) for v in (0, 1)]  # labelled rows for one of the sample
    prior = n.get(1, 0) / max(1, n.get(1, 0) + n.get(0, 0))
    index = Index(number, scale, rows, y, copies * np.where(y == 1, each[1], each[0]), ids, prior)
    index.rows = [()] * len(rows)  # only the lists are needed from here on
    sent = docs.sparkSession.sparkContext.broadcast(dict(vars(index)))

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.of(sent.value)
        for batch in batches:
            which = batch.column(0).to_pylist()
            found = index.nearest_each((*index.example_vector(i), i) for i in which)
            got = [(i, index.votes(near)) for i, near in zip(which, found, strict=True) if near]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.int64()), pa.array([v for _, v in got], pa.float64())], names=["i", "votes"])

    if rows:
        raw = docs.sparkSession.range(len(rows), numPartitions=max(1, len(rows) // 100)).mapInArrow(without, "i long, votes double").collect()
        index.calibrate({r["i"]: r["votes"] for r in raw})
    return index, sent


def scored(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`row` (all columns of docs), score, evidence (the three nearest examples, as id:cosine) and neighbours (how many) per row."""
    index, sent = _sent(docs, labels, most, id_col, text_col)  # bounded by `most` and EXAMPLE_CHARS
    shares = {"curve": index.curve, "none": index.none}
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.of(sent.value | shares)

        def vector(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
            terms, times = index.row(words_of(text))
            return terms, index.vector(terms, times), -1

        for batch in batches:
            out = []
            for near in index.nearest_each(vector(text.as_py()) for text in batch.column(0).field(at)):
                out.append((index.score(near), ",".join(f"{index.ids[i]}:{c:.4f}" for c, i in near[:3]), len(near)))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], names=["row", "score", "evidence", "neighbours"])

    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return d.mapInArrow(work, f"row {d.schema['row'].dataType.simpleString()}, score double, evidence string, neighbours int")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, evidence, neighbours."""
    s = scored(docs.select("doc_id", "text"), labels)
    return s.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "neighbours")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with all their columns."""
    return scored(docs, labels).where("score < 0.5").select("row.*")
