"""Models that a caller injects: embedders of texts and rerankers of (query, text) pairs.

A model is given by a function that loads it. It is sent to the tasks as it is, called there, and what it returns is kept
for as long as the Python worker lives, so that a worker loads a model once and not once a task, a batch or a row.
Rows go to it in Arrow batches, of which each becomes one call or several of `batch` texts.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import rounded
from corpusloom.operators.maintained import Model

Embed = Callable[[list[str]], Sequence[Sequence[float]]]
Predict = Callable[[list[tuple[str, str]]], Sequence[float]]


def _loaded(name: str, load: Callable):
    """The model of that name in this Python worker."""
    models = sys.__dict__.setdefault("_corpusloom_models", {})
    if name not in models:
        models[name] = load()
    return models[name]


@dataclass(frozen=True)
class Embedder:
    """name (one model, one name), dim, load: to a function from texts to their vectors, texts a call."""

    name: str
    dim: int
    load: Callable[[], Embed]
    batch: int = 64

    def embed(self, texts: DataFrame, key: str = "id") -> DataFrame:
        """key, vec of texts (key, text); a null text is an empty one. A vector of another length than dim is an error."""
        name, dim, load, size = self.name, self.dim, self.load, self.batch
        kind = texts.schema[key].dataType.simpleString()

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = _loaded(name, load)
            for b in batches:
                said = b["text"].to_pylist()
                vectors = [[float(x) for x in v] for k in range(0, len(said), size) for v in model(said[k : k + size])]
                if len(vectors) != len(said) or any(len(v) != dim for v in vectors):
                    raise ValueError(f"{name} gave {len(vectors)} vectors of {sorted({len(v) for v in vectors})} for {len(said)} texts of {dim}")
                yield pa.RecordBatch.from_arrays([b[key], pa.array(vectors, pa.list_(pa.float64()))], names=[key, "vec"])

        return texts.select(key, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, f"{key} {kind}, vec array<double>")

    @property
    def model(self) -> Model:
        """For an index that is kept in step."""
        return Model(self.name, self.dim, lambda texts, postings: self.embed(texts))


@dataclass(frozen=True)
class Reranker:
    """name, load: to a function from (query, text) pairs to scores, pairs a call."""

    name: str
    load: Callable[[], Predict]
    batch: int = 64

    def score(self, pairs: DataFrame) -> DataFrame:
        """pairs (query, text, ...) with `rerank`, their score; null where the model can't be loaded or says nothing finite."""
        name, load, size = self.name, self.load, self.batch
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                model = _loaded(name, load)
            except Exception as error:  # a search goes on in the order that it has
                print(f"reranker {name} is not available: {error}", file=sys.stderr)
                model = None
            for b in batches:
                scores: list[float | None] = [None] * len(b)
                if model is not None:
                    both = list(zip(b["query"].to_pylist(), b["text"].to_pylist(), strict=True))
                    scores = [x if x == x and abs(x) != float("inf") else None for k in range(0, len(both), size) for x in map(float, model(both[k : k + size]))]
                yield b.append_column("rerank", pa.array(scores, pa.float64()))

        return pairs.mapInArrow(work, f"{kinds}, rerank double")


def reranked(pool: DataFrame, queries: DataFrame, reranker: Reranker, k: int) -> DataFrame:
    """The k best of a pool (qid, rank, text, ...) for queries (qid, text), by the model's scores; equal ones, and pools without scores, stay in order of rank.

    Columns rerank (null where a query has one hit, which isn't scored, or the model is missing) and rank, the new one.
    """
    n = F.count("*").over(Window.partitionBy("qid"))
    p = pool.withColumn("of", n).join(queries.select("qid", F.col("text").alias("query")), "qid")
    scored = reranker.score(p.where("of > 1"))
    alone = p.where("of = 1").withColumn("rerank", F.lit(None).cast("double"))
    every = scored.unionByName(alone)
    order = Window.partitionBy("qid").orderBy(F.desc_nulls_last("rerank"), "rank")
    return every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).withColumn("rank", F.col("place")).drop("of", "query", "place")


def rerank_relevance(score: Column) -> Column:
    """A score as per cent with one digit, held between 0 and 100; null stays."""
    return F.when(score.isNotNull(), rounded(F.least(F.greatest(score * 100, F.lit(0.0)), F.lit(100.0)), 1))
