"""N-gram Jaccard join: a MinHash LSH forest finds candidates, sets of word shingles decide.

1. Each text becomes the set of its five-word shingles, as 64-bit hashes (a text of fewer words is one shingle).
   Texts with equal sets are one class, which goes on as one row with a count.
2. A forest of tries holds the classes' MinHash labels, sorted by tree and prefix. Matched prefixes start at full
   depth and are shortened step by step. At each depth, classes that meet are compared by their whole signatures, each
   pair once: where it meets deepest, in the first of these trees. From the pairs found so far and how alike they are,
   the share that the forest still misses at this depth is estimated; shortening ends when it is within the target,
   or at the depth at which even pairs of exactly the threshold meet with the target probability. So a corpus of close
   copies ends early, and one with pairs near the threshold goes all the way. Pairs whose signatures agree in about as
   many places as the threshold asks (less four deviations) join their classes into regions; a region's size follows
   from its members, no pair is listed.
3. In each region, every class brings its shingles once for each tile, and exact similarities decide its links.
   Links are counted in the tile; a spanning set of them gives the final classes.

Words are runs of ASCII letters, digits and `_`, or of any code points from U+0080, in lower case. A null or empty
text, or one without words, has no shingles and links with nothing. Rows with null id take part; the least id that
is not null names a class. Rows that repeat id and text are members each. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import keyed, small_batches, written
from corpusloom.llm.components import components
from corpusloom.llm.tiles import links, tiled

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
TREES, DEPTH = 25, 8
#: Rows of a chunk when signatures, and when shingle sets are compared.
SIDE, EXACT_SIDE = 1024, 1024
#: Bytes of shingle sets in a chunk, besides its largest set.
CHUNK_BYTES = 16 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def met(similarity: np.ndarray | float, depth: int, trees: int = TREES) -> np.ndarray | float:
    """The probability that a pair shares a prefix of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def least_depth(threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> int:
    """The deepest prefix at which a pair of the threshold's similarity meets in some tree with the given probability."""
    while depth > 1 and met(threshold, depth) < recall:
        depth -= 1
    return depth


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes, many texts at a time: word hashes are differences of a polynomial's running sums."""

    def __init__(self, words: int = WORDS):
        self.words = words
        inside = np.zeros(256, bool)
        inside[[*range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F, *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
        self.inside = inside
        self.value = _mixed(np.arange(1, 257, dtype=np.uint64))
        self.powers = np.ones(1, np.uint64)
        self.back = np.ones(1, np.uint64)
        self.inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))

    def _up_to(self, n: int) -> None:
        if len(self.powers) < n:
            size = 1 << n.bit_length()
            self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, _BASE, np.uint64))])
            self.back = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, self.inverse, np.uint64))])

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted, distinct shingle hashes of each text."""
        packed = [t.lower().encode("utf-8", "surrogatepass") + b"\n" for t in texts]
        data = np.frombuffer(b"".join(packed), np.uint8)
        if not len(data):
            return []
        self._up_to(len(data) + 1)
        word = self.inside[data]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        edge = np.concatenate([[0], edge]) if word[0] else edge
        start, stop = edge[::2], edge[1::2]  # each text ends outside a word
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[data] * self.powers[: len(data)])])
        hashed = _mixed((running[stop] - running[start]) * self.back[start])
        first = np.searchsorted(start, np.cumsum([0, *map(len, packed)]))
        out = []
        k = self.words
        for a, b in zip(first, first[1:], strict=False):
            w = hashed[a:b]
            n = max(1, len(w) - k + 1) if len(w) else 0
            mixed = np.zeros(n, np.uint64)
            for i in range(min(k, len(w))):
                mixed = mixed * _BASE + w[i : i + n]
            out.append(np.unique(_mixed(mixed)))
        return out


class MinHash:
    """Signatures of `size` 32-bit values."""

    def __init__(self, size: int, seed: int = 5):
        r = np.random.default_rng(seed)
        self.a = (r.integers(0, 1 << 32, size, np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        self.x = r.integers(0, 1 << 32, size, np.uint64).astype(np.uint32)[:, None]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(low), 512):  # small enough for a core's cache
            least = np.minimum(least, ((low[None, i : i + 512] ^ self.x) * self.a).min(axis=1))
        return least


def _batches(texts: list[str], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of about `most` characters."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, id, cls (16 bytes that stand for the shingle set; null without shingles), n_shingles, sig (bytes)."""
    k = keyed(docs, id_col, text_col)
    id_type = k.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, minhash = Shingler(), MinHash(TREES * DEPTH)
        for batch in batches:
            texts = batch["text"].to_pylist()
            cls, n, sig = [], [], []
            for a, b in _batches(texts):
                for s in shingler.sets(texts[a:b]):
                    n.append(len(s))
                    if len(s):
                        cls.append(np.array([s.sum(), _mixed(s ^ _BASE).sum()], np.uint64).tobytes())
                        sig.append(minhash.of(s).astype(np.uint16).tobytes())
                    else:
                        cls.append(None)
                        sig.append(None)
            yield pa.RecordBatch.from_arrays([batch["doc"], batch["id"], pa.array(cls, pa.binary()), pa.array(n, pa.int32()), pa.array(sig, pa.binary())], names=["doc", "id", "cls", "n_shingles", "sig"])

    return k.select("doc", "id", "text").mapInArrow(work, f"doc binary, id {id_type}, cls binary, n_shingles int, sig binary")


def _tries(reps: DataFrame, least: int) -> DataFrame:
    """node, tree and the hashes of its label's prefixes of depth `least` to DEPTH (columns p<depth>), of each class in each tree."""
    names = [f"p{d}" for d in range(least, DEPTH + 1)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = len(batch)
            sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint16).reshape(m, TREES, DEPTH)
            h, cols = np.zeros((m, TREES), np.uint64), []
            for i in range(DEPTH):
                h = _mixed(h * _BASE + sig[:, :, i].astype(np.uint64) + np.uint64(1))
                if i + 1 >= least:
                    cols.append(pa.array(h.reshape(-1).view(np.int64)))
            take = pa.array(np.repeat(np.arange(m), TREES))
            yield pa.RecordBatch.from_arrays([batch["node"].take(take), pa.array(np.tile(np.arange(TREES, dtype=np.int32), m)), *cols], names=["node", "tree", *names])

    rows = reps.select("node", "sig").mapInArrow(work, "node binary, tree int, " + ", ".join(f"{n} long" for n in names))
    return rows.repartition("tree", names[0]).sortWithinPartitions("tree", *names)


def _alike(least: int, depth: int, depths: list[int], threshold: float):
    """Pairs whose signatures agree in `least` places, that meet at `depth` and no deeper, and here first.

    With each pair, if it is as alike as the threshold by its signatures: one, and for each of `depths` how many pairs
    like it the forest misses at that depth for one that it finds.
    """
    size = TREES * DEPTH

    def compare(a: pd.DataFrame, b: pd.DataFrame | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of = lambda x: np.frombuffer(b"".join(x["sig"]), np.uint16).reshape(len(x), -1)
        u, v = of(a), of(a if b is None else b)
        first, second, agree = [], [], []
        step = max(1, 8_000_000 // (v.size or 1))
        for i in range(0, len(u), step):
            n = (u[i : i + step, None, :] == v[None, :, :]).sum(axis=2)
            x, y = np.nonzero(n >= least)
            first.append(x + i)
            second.append(y)
            agree.append(n[x, y])
        i, j, n = np.concatenate(first), np.concatenate(second), np.concatenate(agree)
        if b is None:
            keep = i < j
            i, j, n = i[keep], j[keep], n[keep]
        new = np.zeros(len(i), bool)
        for at in range(0, len(i), 100_000):
            part = slice(at, at + 100_000)
            deep = np.cumprod((u[i[part]] == v[j[part]]).reshape(-1, TREES, DEPTH), axis=2, dtype=np.uint8).sum(axis=2)
            new[part] = (deep.max(axis=1) == depth) & ((deep >= depth).argmax(axis=1) == a["tree"].iloc[0])
        i, j, s = i[new], j[new], n[new] / size
        counts = np.stack([np.ones(len(s)), *[(1 - met(s, d)) / met(s, d) for d in depths]], axis=1) * (s >= threshold)[:, None]
        return i, j, counts

    return compare


def _forest(reps: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, int]:
    """node and root of each class in each tile in which it has an alike one, and the depth at which shortening ended."""
    floor, size = least_depth(threshold, recall), TREES * DEPTH
    least = math.floor(size * threshold - 4 * math.sqrt(size * threshold * (1 - threshold)))
    tries = written(_tries(reps, floor), "tries")
    depths = list(range(DEPTH, floor - 1, -1))
    sums = ("seen", *[f"missed{d}" for d in depths])
    edges, total = None, dict.fromkeys(sums, 0.0)
    for depth in depths:
        rows = tries.select("node", "tree", F.col(f"p{depth}").alias("prefix"))
        tile = tiled(rows, ["tree", "prefix"], "node", SIDE).join(reps.select("node", "sig", F.lit(1).alias("one")), "node")
        now = written(links(tile, ["tree", "prefix"], "node", "one", _alike(least, depth, depths, threshold), "binary", sums), "met")
        edges = now if edges is None else edges.unionByName(now)
        got = now.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums]).first()
        total = {c: total[c] + got[c] for c in sums}
        if total["seen"] and total[f"missed{depth}"] <= (1 - recall) * (total["seen"] + total[f"missed{depth}"]):
            break
    return edges.select("node", "root"), depth


def _similar(threshold: float):
    """Pairs of shingle sets at or above the threshold: shared shingles are counted column by column, in slices."""

    def compare(a: pd.DataFrame, b: pd.DataFrame | None) -> tuple[np.ndarray, np.ndarray]:
        both = a if b is None else pd.concat([a, b])
        sets = [np.frombuffer(x, np.uint64) for x in both["shingles"]]
        size = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        col = np.cumsum(np.concatenate([[0], (flat[1:] != flat[:-1]).astype(np.int64)]))
        shared = np.bincount(col) > 1
        keep = shared[col]
        col, owner = np.cumsum(shared)[col[keep]] - 1, owner[keep]
        n = len(sets) if b is None else len(a)
        common = np.zeros((n, len(sets) - (0 if b is None else n)), np.float32)
        width = 2048
        for c in range(0, int(col[-1]) + 1 if len(col) else 0, width):
            lo, hi = np.searchsorted(col, [c, c + width])
            m = np.zeros((len(sets), width), np.float32)
            m[owner[lo:hi], col[lo:hi] - c] = 1
            common += m[:n] @ (m if b is None else m[n:]).T
        total = size[:n, None] + (size if b is None else size[n:])[None, :]
        i, j = np.nonzero(common >= threshold * (total - common) - 1e-9)
        return (i[i < j], j[i < j]) if b is None else (i, j)

    return compare


def _shingled(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """wanted's rows (doc and others) with shingles (bytes, sorted)."""
    rows = keyed(docs, id_col, text_col).select("doc", "text").join(wanted.hint("merge"), "doc").dropDuplicates(["doc"])
    others = [f for f in wanted.schema if f.name != "doc"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            texts = batch["text"].to_pylist()
            out = [s.tobytes() for a, b in _batches(texts) for s in shingler.sets(texts[a:b])]
            yield pa.RecordBatch.from_arrays([*[batch[f.name] for f in others], pa.array(out, pa.binary())], names=[*[f.name for f in others], "shingles"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others)
    return rows.select(*[f.name for f in others], "text").mapInArrow(work, f"{kinds}, shingles binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc (see common.doc_key), id, cls, n_shingles, n_links, n_copies, group (16 bytes; null without shingles), group_id (its least id)."""
    sigs = written(signatures(small_batches(docs), id_col, text_col), "signatures")
    reps = sigs.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc").alias("doc"), F.count("*").alias("n"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    reps = written(reps.withColumnRenamed("cls", "node"), "classes")
    edges, _ = _forest(reps, threshold, recall)
    regions = components(edges.select(F.col("node").alias("u"), F.col("root").alias("v")), "regions")
    wanted = written(regions.join(reps.select("node", "doc", "n", "n_shingles"), "node").withColumnRenamed("component", "region"), "wanted")
    # joins are sorted and merged at any size: the same plan on little and on much.
    # Tiles are cut by small rows and by the bytes that sets will take; then each set goes once to each tile that it is in
    dealt = tiled(wanted.select("node", "n", "region", "n_shingles"), ["region"], "node", EXACT_SIDE, F.col("n_shingles") * 8, CHUNK_BYTES)
    exact = dealt.hint("merge").join(_shingled(docs, wanted.select("doc", "node"), id_col, text_col), "node")
    found = written(links(exact, ["region"], "node", "n", _similar(threshold), "binary"), "found")
    near = found.groupBy("node").agg(F.sum("n_links").alias("near"))
    groups = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), "groups")
    per = reps.select("node", "n").join(near, "node", "left").join(groups, "node", "left")
    per = per.select(F.col("node").alias("cls"), (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_links"), (F.col("n") - 1).alias("n_copies"), F.coalesce("component", "node").alias("group"))
    out = written(sigs.select("doc", "id", "cls", "n_shingles").join(per, "cls", "left"), "grouped")
    least_id = written(out.where("group IS NOT NULL").groupBy("group").agg(F.min("id").alias("group_id")), "least")  # a join can be split only behind what was written
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.join(least_id.hint("merge"), "group", "left").select("doc", "id", "cls", F.col("n_shingles").cast("long").alias("n_shingles"), zero("n_links"), zero("n_copies"), "group", F.coalesce("group_id", "id").alias("group_id"))


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, class_id (the least doc_id that links reach), n_links, n_copies, n_shingles, kept."""
    d = near_duplicates(docs)
    return d.select(F.col("id").alias("doc_id"), F.col("group_id").alias("class_id"), "n_links", "n_copies", "n_shingles", F.col("id").eqNullSafe(F.col("group_id")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each group the one with the least (id, doc), and all rows without shingles."""
    d = near_duplicates(docs, id_col, text_col)
    first = d.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc")).alias("first")).select("first.doc")
    keep = first.union(d.where("group IS NULL").select("doc"))
    # rows that repeat id and text are one document: one of them stays
    rows = keyed(docs, id_col, text_col, keep=True).join(keep.distinct(), "doc", "left_semi")
    once = rows.groupBy("doc").agg(F.first("row").alias("row"))
    return once.select("row.*")
