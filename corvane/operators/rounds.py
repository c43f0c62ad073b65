"""Rounds over a graph in which each node looks at its neighbours, where every task can hold a number for each node.

Links are written once, a row of neighbours and weights for each node; a round
reads them without a shuffle and sends a few numbers for each node. ``HELD``
bounds what is sent; graphs of more nodes are left to joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.sources.scratch import release, stage

#: Up to this many nodes the numbers of all go to each task: 16 MB for each number of 4 bytes.
HELD = 4 << 20

#: The links of some nodes: places of the nodes, entries of each, and of all entries whose they are, the neighbour's place and the weight.
Links = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def numbers(ids: DataFrame) -> np.ndarray | None:
    """The distinct values of the only column, in order; None where there are more than ``HELD``."""
    some = ids.toDF("x").select(F.col("x").cast("long")).where("x is not null").distinct()
    return None if some.count() > HELD else np.sort(some.toArrow().column(0).to_numpy().astype(np.int64))


def _places(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values are in ``ids``, and whether they are."""
    at = np.minimum(np.searchsorted(ids, values), max(len(ids) - 1, 0))
    return at.astype(np.int32), ids[at] == values if len(ids) else np.zeros(len(values), bool)


@dataclass
class Rounds:
    """``ids`` in order, and (place, indexid, near, weight): the links of each node that has any; nodes and neighbours are places in ``ids``."""

    ids: np.ndarray
    table: DataFrame

    @classmethod
    def of(cls, links: DataFrame, ids: np.ndarray) -> Rounds:
        """Of links (src, dst, weight) in both directions; those from or to other nodes are left out."""
        sent = links.sparkSession.sparkContext.broadcast(ids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                (src, a), (dst, c) = (_places(sent.value, b.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x[a & c]) for x in (src, b.column(0).to_numpy(), dst, b.column(2).to_numpy())], ["place", "indexid", "dst", "weight"])

        rows = links.where("src is not null and dst is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
        placed = rows.mapInArrow(run, "place int, indexid long, dst int, weight double")
        packed = placed.groupBy("place", "indexid").agg(F.sort_array(F.collect_list(F.struct("dst", "weight"))).alias("x"))
        return cls(ids, stage(packed.select("place", "indexid", F.col("x.dst").alias("near"), F.col("x.weight").alias("weight")), "near"))

    def map(self, f: Callable[..., dict[str, np.ndarray]], schema: str, *held: object, flag: object = None) -> DataFrame:
        """Rows that ``f`` makes of links, a flag of each node (a column) and ``held``, which all tasks get."""
        sent = self.table.sparkSession.sparkContext.broadcast(held)
        names = [x.split()[0] for x in schema.split(",")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                place, near, weight, flags = (b.column(i) for i in range(4))
                sizes = near.value_lengths().to_numpy().astype(np.int64)
                links = place.to_numpy(), np.repeat(np.arange(len(sizes)), sizes), near.flatten().to_numpy(), weight.flatten().to_numpy()
                out = f(links, flags.to_numpy(zero_copy_only=False), *sent.value)
                yield pa.RecordBatch.from_arrays([pa.array(out[x]) for x in names], names)

        out = self.table.select("place", "near", "weight", F.lit(True) if flag is None else flag).mapInArrow(run, schema)
        out._sent = sent
        return out

    def ask(self, f: Callable[..., dict[str, np.ndarray]], schema: str, *held: object, flag: object = None) -> dict[str, np.ndarray]:
        """``map``, gathered: ``place`` and a few numbers of each node with links."""
        rows = self.map(f, schema, *held, flag=flag)
        found = rows.toArrow()
        rows._sent.destroy()
        return {x: found.column(x).to_numpy() for x in StructType.fromDDL(schema).names}

    def labelled(self, nodes: DataFrame, labels: np.ndarray) -> DataFrame:
        """(indexid, label) of nodes (indexid); ``labels`` are places, and nodes that aren't in ``ids`` have their own number."""
        sent = nodes.sparkSession.sparkContext.broadcast((self.ids, labels))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, labels = sent.value
            for b in batches:
                own = b.column(0).fill_null(0).to_numpy()
                at, have = _places(ids, own)
                label = np.where(have, ids[labels[at]], own) if len(ids) else own
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label, mask=b.column(0).is_null().to_numpy(zero_copy_only=False))], ["indexid", "label"])

        return nodes.select(F.col("indexid").cast("long")).mapInArrow(run, "indexid long, label long")

    def release(self) -> None:
        release(self.table)


def _by_label(whose: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of weights by node and label, in this order: nodes, labels, sums."""
    key = whose.astype(np.int64) << 32 | label
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[starts] >> 32, (key[starts] & 0xFFFFFFFF).astype(np.int32), np.add.reduceat(weight[order], starts) if len(starts) else np.zeros(0)


def _first_best(whose: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Of each of ``n`` nodes, where the first of its greatest values is; every node has one."""
    value = np.where(np.isnan(value), -np.inf, value)
    most = np.full(n, -np.inf)
    np.maximum.at(most, whose, value)
    at = np.flatnonzero(value == most[whose])[::-1]
    out = np.zeros(n, np.int64)
    out[whose[at]] = at
    return out


def degrees(links: Links, _: np.ndarray) -> dict[str, np.ndarray]:
    place, whose, _, weight = links
    return {"place": place, "degree": np.bincount(whose, weight, len(place)).astype(float)}


def vote(links: Links, _: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """The label of most weight (to nine digits) around each node, then the least one."""
    place, whose, near, weight = links
    who, label, w = _by_label(whose, labels[near], weight)
    return {"place": place, "label": label[_first_best(who, np.round(w, 9), len(place))]}


def move(links: Links, may: np.ndarray, labels: np.ndarray, degree: np.ndarray, mass: np.ndarray, total: float, resolution: float) -> dict[str, np.ndarray]:
    """The community of the greatest gain in modularity around each node, then its own, then the least one; the weight that stays inside its own; and its flag."""
    place, whose, near, weight = links
    loop = near == place[whose]
    who, label, w = _by_label(whose, labels[near], np.where(loop, 0.0, weight))
    mine, d = labels[place], degree[place]
    own = label == mine[who]
    gain = np.round(w - resolution * (mass[label] - np.where(own, d[who], 0.0)) * d[who] / total, 9)
    stay = np.round(-resolution * (mass[mine] - d) * d / total, 9)  # of nodes without a neighbour in their community
    stay[who[own]] = gain[own]
    best = _first_best(who, gain, len(place))
    wish = np.where(gain[best] > stay, label[best], mine).astype(np.int32)
    inside = np.bincount(whose[loop], weight[loop], len(place)).astype(float)  # of nothing it is integers
    inside[who[own]] += w[own]
    return {"place": place, "wish": wish, "inside": inside, "may": may}


def contract(links: Links, _: np.ndarray, names: np.ndarray) -> dict[str, np.ndarray]:
    """Links between communities (``names`` of each node), summed up as far as these nodes go."""
    place, whose, near, weight = links
    communities, at = np.unique(names[place], return_inverse=True)
    ends, to = np.unique(names[near], return_inverse=True)
    who, label, w = _by_label(at[whose], to, weight)
    return {"src": communities[who], "dst": ends[label], "weight": w}
