"""Graphs over rows: connected components, folded by tasks first, and greedy selection, in rounds of joins and aggregates.

Each round's state is written to the shared folder, so that no round depends on an executor that may be lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigfield.runtime import cut, ship


SHARE = 100_000  # links that one task folds at once


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of nodes 0 to n - 1 with links a to b, each one's least node that it is connected with."""
    low = np.arange(n)
    while True:
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            return low
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low != low[low]).any():
            low = low[low]


def by_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of rows that are sorted by keys, moved so that no group of equal keys is parted."""
    rest = None
    for t in batches:
        t = t if rest is None else pd.concat([rest, t], ignore_index=True)
        new = np.flatnonzero((t[keys] != t[keys].shift()).any(axis=1).to_numpy())
        if len(new):
            if new[-1]:
                yield t.iloc[: new[-1]]
            rest = t.iloc[new[-1] :]
    if rest is not None and len(rest):
        yield rest


def _stars(links: DataFrame, by: list[str]) -> DataFrame:
    """Links (by, _share, a, b) folded share by share: each node (by, id) with ``low``, the least one that its share connects it with."""
    keys = [*by, "_share"]
    dealt = links.select(*keys, "a", "b").repartition(*keys).sortWithinPartitions(*keys)
    plain = lambda v: tuple(v) if isinstance(v, np.ndarray) else v

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in by_groups(batches, keys):
            group = (t[keys] != t[keys].shift()).any(axis=1).cumsum().to_numpy()
            ends = [(g, plain(v)) for c in "ab" for g, v in zip(group, t[c])]
            order = {v: k for k, v in enumerate(sorted(set(ends)))}
            at = np.array([order[v] for v in ends])
            low = least_linked(len(order), at[: len(t)], at[len(t) :])
            names = list(order)
            head = t.iloc[np.searchsorted(group, [g for g, _ in names])]
            yield pd.DataFrame({**{c: head[c].to_numpy() for c in by}, "id": pd.Series([v for _, v in names]), "low": pd.Series([names[k][1] for k in low])})

    kinds = {f.name: f.dataType.simpleString() for f in links.schema}
    return dealt.mapInPandas(fold, ", ".join([*(f"{c} {kinds[c]}" for c in by), f"id {kinds['a']}", f"low {kinds['a']}"]))


def components(nodes: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """Each node's component as its least ``id``: rows of (by, id, label).

    ``links`` are rows of (by, a, b), in one direction or both. Tasks fold the links of many groups at once. A group of more
    than SHARE links is cut into shares; what these leave, one link a node and share, is settled in rounds: labels fall to the
    least among a node's neighbours, then to that label's own, until none moves."""
    ship(nodes.sparkSession)
    links = cut(links.select(*by, "a", "b").distinct(), "links")
    sizes = links.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("_n")).where("_n > 1")
    if not sizes.limit(1).count():
        low = _stars(links.withColumn("_share", F.lit(0)), by)
        return nodes.select(*by, "id").join(low.hint("merge"), [*by, "id"], "left").select(*by, "id", F.coalesce("low", "id").alias("label"))
    shared = links.join(sizes, by, "left").withColumn("_share", F.pmod(F.xxhash64("a"), F.coalesce("_n", F.lit(1))).cast("int"))
    stars = _stars(shared.drop("_n"), by)
    both = cut(stars.select(*by, F.col("id").alias("a"), F.col("low").alias("b")).unionByName(stars.select(*by, F.col("low").alias("a"), F.col("id").alias("b"))).distinct(), "links")
    labels = cut(nodes.select(*by, "id", F.col("id").alias("label")), "labels")
    while True:
        near = both.join(labels.select(*by, F.col("id").alias("b"), F.col("label").alias("low")).hint("merge"), [*by, "b"]).groupBy(*by, F.col("a").alias("id")).agg(F.min("low").alias("low"))
        fallen = labels.join(near.hint("merge"), [*by, "id"], "left").withColumn("to", F.least("label", "low"))
        jump = fallen.select(*by, F.col("id").alias("to"), F.col("to").alias("top"))
        now = fallen.join(jump.hint("merge"), [*by, "to"], "left").select(*by, "id", F.least("to", "top").alias("now"), "label")
        now = cut(now.select(*by, "id", F.col("now").alias("label"), (F.col("now") != F.col("label")).alias("moved")), "labels")
        labels = now.drop("moved")
        if not now.where("moved").limit(1).count():
            return labels


def greedy(rows: DataFrame, by: list[str], within: dict[str, float], order: list[Column], conflict: Callable[[Callable, Callable], Column]) -> DataFrame:
    """What a greedy pass would keep that takes rows in ``order`` (unique within ``by``) and skips each one that
    conflicts with a row it has kept.

    ``within`` gives columns and sizes: rows can only conflict if they differ by less than the size in every one of
    them. ``conflict(a, b)`` is the test, from two functions that give a row's columns by name.

    The rows lie in cells of these sizes. In each round the first row of a cell is kept if it comes before all
    undecided rows of its own and the neighbouring cells; those that conflict with it go. So the first undecided
    row of all is always decided, no pairs are made but those of rows with the few kept ones around them, and
    a crowded cell costs one aggregate."""
    cells = [f"_{c}" for c in within]
    keys = [*by, *cells]
    steps = F.array(*(F.struct(*(F.lit(d).alias(c) for d, c in zip(move, cells))) for move in product((-1, 0, 1), repeat=len(cells))))
    around = lambda t: t.withColumn("_step", F.explode(steps)).withColumns({c: F.col(c) + F.col(f"_step.{c}") for c in cells}).drop("_step")
    names = rows.columns
    undecided = rows.withColumns({f"_{c}": F.floor(F.col(c) / size).cast("long") for c, size in within.items()})
    undecided = cut(undecided.withColumn("_order", F.struct(*(x.alias(f"o{k}") for k, x in enumerate(order)))), "undecided")
    kept = []
    while undecided.limit(1).count():
        firsts = undecided.groupBy(*keys).agg(F.min("_order").alias("_order"))
        least = around(firsts).groupBy(*keys).agg(F.min("_order").alias("_least"))
        won = cut(undecided.join(least.hint("merge"), keys).where(F.col("_order") == F.col("_least")).drop("_least"), "kept")
        kept.append(won.select(*names))
        a, b = undecided.alias("a"), around(won).alias("b")
        of = lambda side: lambda c: F.col(f"{side}.{c}")
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by] + [F.col(f"a.{c}") == F.col(f"b.{c}") for c in cells]
        gone = (F.col("a._order") == F.col("b._order")) | conflict(of("a"), of("b"))
        undecided = cut(a.join(b.hint("merge"), [*same, gone], "left_anti"), "undecided")
    out = kept[0] if kept else rows.where("false")
    for k in kept[1:]:
        out = out.unionByName(k)
    return out
