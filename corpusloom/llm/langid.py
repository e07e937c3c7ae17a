"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

A text's UTF-8 bytes are cut into segments of SEGMENT bytes, the last one shorter, so that every byte of every text is
read once. In each segment one recurrent layer runs forwards and one backwards, both from zero. A unit's gates are
clipped lines (update z, reset r) and its candidate is a hyperbolic tangent:

    z, r = clip(W[byte] + U h, 0, 1);  n = tanh(Wn[byte] + r * (Un h));  h = n + z * (h - n)

A softmax on both states labels each position, and the mean of the positions' probabilities is the document's. The
network is trained by backpropagation through time on a sample: for each language at most `most` distinct texts, in
the order of a hash, and of each at most SPREAD segments, evenly spread over all of it. These are the only bounds, and
they hold the sample to most * SPREAD * SEGMENT bytes a language at any size of the corpus. It is learned on the
driver from those; every row of the corpus is labelled in Arrow batches, where it is read, without a shuffle.

A null text, or one without a letter, is `und` with score 0; so is all if there is no labelled row to learn from. Null
ids are held out. Equal texts get equal results, and repeated rows are labelled each. Of equal probabilities the
first language in order of its name counts. Very long texts are read whole. Other columns of the input, whatever
their names, are neither read nor kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import small_batches, written

SEGMENT, UNITS, BATCH = 128, 8, 1024
#: The bound on labelled rows: distinct texts a language, and segments a text.
TEXTS, SPREAD = 400, 16
STEPS, LEARNED_AT_ONCE, RATE = 360, 192, 0.02
NONE = "und"


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")), F.lit(2)) % 4 == 2


@dataclass
class Network:
    """Weights by direction: bytes to gates (2, 3H, 256), states to gates (2, 3H, H), states to languages (2, C, H), and a constant (C)."""

    languages: list[str]
    w: np.ndarray
    u: np.ndarray
    v: np.ndarray
    c: np.ndarray

    @staticmethod
    def new(languages: list[str], units: int, rng: np.random.Generator) -> Network:
        w = rng.normal(0, 0.3, (2, 3 * units, 256))
        w[:, : 2 * units] += 0.5  # gates start half open
        u = rng.normal(0, 0.5 / np.sqrt(units), (2, 3 * units, units))
        return Network(languages, *(x.astype(np.float32) for x in (w, u, rng.normal(0, 0.3, (2, len(languages), units)), np.zeros(len(languages)))))

    def states(self, x: np.ndarray, size: np.ndarray | None = None, trace: list | None = None) -> np.ndarray:
        """The states (2, L, H, B) at each position of x (L, B). size: of segments shorter than L; trace: gets what backpropagation needs."""
        steps, batch = x.shape
        units = self.u.shape[2]
        out = np.empty((2, steps, units, batch), np.float32)
        g, r, n = (np.empty((k * units, batch), np.float32) for k in (3, 3, 1))
        for d in (0, 1):
            h = np.zeros((units, batch), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                np.take(self.w[d], x[t], axis=1, out=g, mode="clip")
                np.matmul(self.u[d], h, out=r)
                z = g[: 2 * units]
                z += r[: 2 * units]
                np.clip(z, 0, 1, out=z)
                np.multiply(z[units:], r[2 * units :], out=n)
                n += g[2 * units :]
                np.tanh(n, out=n)
                if trace is not None:
                    trace.append((d, t, h.copy(), z.copy(), r[2 * units :].copy(), n.copy()))
                h -= n
                h *= z[:units]
                h += n
                if size is not None and d:
                    h *= t < size  # what stands behind a segment's end is not read
                out[d, t] = h
        return out

    def chances(self, states: np.ndarray) -> np.ndarray:
        """The probabilities (L, C, B) of the languages at each position."""
        p = np.matmul(self.v[0], states[0])
        p += np.matmul(self.v[1], states[1])
        p += self.c[:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean cross-entropy of the positions of x (L, B) with the languages y (B), and its gradients by w, u, v, c."""
        steps, batch = x.shape
        units = self.u.shape[2]
        trace: list = []
        states = self.states(x, trace=trace)
        p = self.chances(states)
        each = np.arange(batch)
        loss = float(-np.log(np.maximum(p[:, y, each], 1e-9)).mean())
        p[:, y, each] -= 1
        p /= steps * batch
        dv = np.stack([np.einsum("tcb,thb->ch", p, s, optimize=True) for s in states])
        back = [np.matmul(v.T, p) for v in self.v]
        du = np.zeros_like(self.u)
        dg = np.empty((2, steps, 3 * units, batch), np.float32)
        dh = np.zeros((units, batch), np.float32)
        last = None
        for d, t, h, z, rec, n in reversed(trace):
            if d != last:
                dh, last = np.zeros((units, batch), np.float32), d
            dh = dh + back[d][t]
            dn = dh * (1 - z[:units]) * (1 - n * n)
            a = dg[d, t]
            a[:units] = dh * (h - n)
            a[units : 2 * units] = dn * rec
            a[: 2 * units] *= (z > 0) & (z < 1)
            a[2 * units :] = dn
            to_rec = a.copy()
            to_rec[2 * units :] *= z[units:]
            du[d] += to_rec @ h.T
            dh = dh * z[:units] + self.u[d].T @ to_rec
        at = x.reshape(-1)
        dw = np.stack([[np.bincount(at, row, 256) for row in dg[d].transpose(1, 0, 2).reshape(3 * units, -1)] for d in (0, 1)])
        return loss, [dw.astype(np.float32), du, dv.astype(np.float32), p.sum(axis=(0, 2))]

    def pooled(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The mean probabilities (texts, C) of the positions of texts that lie in data (bytes); zeros where a text is empty."""
        count = -(-sizes // SEGMENT)
        of = np.repeat(np.arange(len(sizes)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        begin, size = starts[of] + nth * SEGMENT, np.minimum(SEGMENT, sizes[of] - nth * SEGMENT)
        total = np.zeros((len(sizes), len(self.languages)))
        order = np.argsort(-size, kind="stable")  # short ones together, each lot as long as its longest
        for k in range(0, len(order), BATCH):
            at = order[k : k + BATCH]
            most, short = int(size[at[0]]), bool(size[at[-1]] < size[at[0]])
            place = begin[at] + np.arange(most)[:, None]
            x = data[np.minimum(place, len(data) - 1)].astype(np.intp)
            p = self.chances(self.states(x, size[at] if short else None))
            if short:
                p *= (np.arange(most)[:, None] < size[at])[:, None, :]
            np.add.at(total, of[at], p.sum(axis=0, dtype=np.float64).T)
        return total / np.maximum(sizes, 1)[:, None]


def trained(languages: list[str], segments: list[list[bytes]], steps: int = STEPS, units: int = UNITS, seed: int = 5) -> Network:
    """A network that has learned from each language's segments: as many of each a step, of random places and lengths."""
    rng = np.random.default_rng(seed)
    net = Network.new(languages, units, rng)
    long = [[np.frombuffer(s, np.uint8) for s in each if len(s) >= 8] or [np.frombuffer(s, np.uint8) for s in each] for each in segments]
    mean, square = ([np.zeros_like(x) for x in (net.w, net.u, net.v, net.c)] for _ in (0, 1))
    per = max(1, LEARNED_AT_ONCE // len(languages))
    y = np.repeat(np.arange(len(languages)), per)
    for step in range(1, steps + 1):
        size = int(rng.choice([16, 32, 64]))
        x = np.empty((size, len(y)), np.intp)
        for b, k in enumerate(y):
            s = long[k][rng.integers(len(long[k]))]
            at = rng.integers(max(1, len(s) - size + 1))
            x[:, b] = np.resize(s[at : at + size], size)  # a shorter one is repeated
        _, grads = net.gradients(x, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, weights in enumerate((net.w, net.u, net.v, net.c)):
            g = grads[k] * min(1.0, 1 / max(norm, 1e-12))
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            weights -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
    return net


def sample(docs: DataFrame, most: int = TEXTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[bytes]]:
    """By language, segments of at most `most` distinct labelled texts with letters that are not held out."""
    text, lang = docs[text_col], docs[lang_col].cast("string")
    fine = docs.where(lang.isNotNull() & ~held_out(docs[id_col]) & text.rlike(r"\p{L}")).select(lang.alias("lang"), F.xxhash64(text).alias("at"), F.xxhash64(text, F.lit(1)).alias("at2"), text.alias("text"))
    by = Window.partitionBy("lang").orderBy("at", "at2")
    different = written(fine.select("lang", "at", "at2").distinct(), "different")
    # of a language with many texts only the lowest hashes, about four times as many as are wanted, meet in one task
    least = F.lit(-(2.0**63)) + F.least(4 * most / F.col("n"), F.lit(1.0)) * 2.0**64
    sizes = different.groupBy("lang").agg(F.count("*").alias("n")).select("lang", least.alias("below"))
    low = different.join(F.broadcast(sizes), "lang").where(F.col("at").cast("double") <= F.col("below")).drop("below")  # a row for each language
    # so many rows in all are sent to every task
    chosen = written(low.withColumn("k", F.row_number().over(by)).where(F.col("k") <= most).drop("k"), "chosen")
    whole = fine.join(F.broadcast(chosen), ["lang", "at", "at2"]).groupBy("lang", "at", "at2").agg(F.first("text").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch["text"]:
                b = text.as_py().encode()
                n = -(-len(b) // SEGMENT)
                found.append([b[k * SEGMENT : (k + 1) * SEGMENT] for k in np.unique(np.linspace(0, n - 1, min(n, SPREAD)).astype(int)).tolist()])
            yield pa.RecordBatch.from_arrays([batch["lang"], batch["at"], batch["at2"], pa.array(found, pa.list_(pa.binary()))], names=["lang", "at", "at2", "parts"])

    rows = whole.mapInArrow(work, "lang string, at long, at2 long, parts array<binary>").collect()
    out: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["at"], r["at2"])):
        out.setdefault(r["lang"], []).extend(map(bytes, r["parts"]))
    return out


def fit(docs: DataFrame, most: int = TEXTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", steps: int = STEPS) -> Network | None:
    """The network that has learned the languages of docs; none if no row can be learned from."""
    found = sample(small_batches(docs), most, id_col, text_col, lang_col)
    return trained(list(found), list(found.values()), steps) if found else None


def labelled(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of each row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch["text"]
            if pa.types.is_large_string(text.type) or text.null_count:
                text = pa.array(text.to_pylist(), pa.large_string()).fill_null("")
            _, offsets, values = text.buffers()
            o = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(text.type) else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            has = batch["letters"].to_numpy(zero_copy_only=False)
            data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(1, np.uint8)
            lang, score = np.full(len(text), NONE, object), np.zeros(len(text))
            if net is not None and has.any():
                p = net.pooled(data, o[:-1][has], np.diff(o)[has])
                best = p.argmax(axis=1)
                lang[has], score[has] = np.array(net.languages, object)[best], np.clip(p[np.arange(len(p)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(lang, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    text = F.coalesce(docs[text_col], F.lit(""))
    d = small_batches(docs).select(docs[id_col].alias("id"), text.alias("text"), text.rlike(r"\p{L}").alias("letters"))
    return d.mapInArrow(work, f"id {id_type}, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    found = labelled(docs, fit(docs))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
