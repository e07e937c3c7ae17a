"""Comparing all rows of a group with each other in bounded pieces.

A group of n rows is dealt into c = ceil(n / side) chunks, or more if they would hold too many bytes, and each pair of
chunks is a tile that one task compares with at most about 2 * side rows, and twice the bytes, in memory. What leaves a tile is a row for each of its members with a link: how
many links it has there and a member that it is connected with. Pairs are counted where they are found and never
become rows, so that a group's output grows with its size and not with its square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import written

Compare = Callable[[pd.DataFrame, pd.DataFrame | None], tuple[np.ndarray, ...]]


def tiled(rows: DataFrame, keys: list[str], by: str, side: int, weight: Column | None = None, most: int = 1) -> DataFrame:
    """rows of groups with two members at least, once for each tile, with ti and tj (the tile) and chunk (its own).

    weight: what a row will bring to its tile, of which a chunk holds about `most` besides its largest row.
    """
    heavy = F.lit(0.0) if weight is None else F.sum(weight) / most
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("group_size"), heavy.alias("heavy")).where("group_size > 1")
    # written, so that the join is split at a group of very many rows; sorted and merged at any size
    sizes = written(sizes.select(*keys, F.greatest(F.ceil(F.col("group_size") / side), F.ceil("heavy")).cast("int").alias("chunks")), "sizes").hint("merge")
    own = rows.join(sizes, keys).withColumn("chunk", F.pmod(F.xxhash64(by, F.lit(7)), F.col("chunks")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return other.withColumn("ti", F.least("chunk", "other")).withColumn("tj", F.greatest("chunk", "other")).drop("chunks", "other")


def runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The runs of equal keys of a sorted stream, each whole."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        new = np.zeros(len(frame), bool)
        for k in keys:
            v = frame[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new), len(frame)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = frame.iloc[a:b]
            if held and any(held[-1][k].iloc[-1] != part[k].iloc[0] for k in keys):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least connected index of each of n, given links a-b: minima handed along the links until they rest."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(dealt: DataFrame, keys: list[str], node: str, weight: str, compare: Compare, schema: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """node, n_links (the partners' weights summed) and root of each member of each tile that has a link there, and sums.

    compare(a, None) gives the linked pairs i < j of one chunk; compare(a, b) those of a's i and b's j. schema: the
    node's SQL type. With sums, compare also gives a row of so many numbers for each pair; columns of these names hold
    the sums over the pairs in which the member is the first one.
    """
    tile = [*keys, "ti", "tj"]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[pd.DataFrame] = []
        for group in runs(frames, tile):
            if group["ti"].iloc[0] == group["tj"].iloc[0]:
                if len(group) < 2:
                    continue
                i, j, *more = compare(group, None)
                members = group
            else:
                first = (group["chunk"] == group["ti"]).to_numpy()
                a, b = group[first], group[~first]
                if not len(a) or not len(b):
                    continue
                i, j, *more = compare(a, b)
                members, j = pd.concat([a, b]), j + len(a)
            if not len(i):
                continue
            w = members[weight].to_numpy(np.int64)
            n = np.zeros(len(members), np.int64)
            np.add.at(n, i, w[j])
            np.add.at(n, j, w[i])
            nodes = members[node].to_numpy()
            order = np.argsort(nodes, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            root = nodes[order][union_find(len(members), rank[i], rank[j])[rank]]
            has = n > 0
            extra = {c: np.bincount(i, more[0][:, k], len(members))[has] for k, c in enumerate(sums)}
            out.append(pd.DataFrame({"node": nodes[has], "n_links": n[has], "root": root[has]} | extra))
            if len(out) >= 200:
                yield pd.concat(out)
                out = []
        if out:
            yield pd.concat(out)

    return dealt.repartition(*tile).sortWithinPartitions(*tile).mapInPandas(work, f"node {schema}, n_links long, root {schema}" + "".join(f", {c} double" for c in sums))
