"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has several points on a ring; a key belongs to the first point
clockwise from its hash. A shard takes rows only up to its capacity; what
overflows continues clockwise to the next shard with room. The rows of an arc
are interchangeable, so the ring is walked over the counts of its arcs (as
many as there are virtual nodes, whatever the input), and the walk's result,
ranges of ranks within an arc, is joined to the rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Positions on the ring; a virtual node stands at one of them.
CELLS = 1 << 17


@dataclass(frozen=True)
class Ring:
    """Shards 0 .. shards-1 with ``points`` virtual nodes each.

    ``slack`` is the share by which a shard may exceed the mean load; 0 makes
    the loads equal, at most one row apart. Many points keep the arcs' loads
    near the mean already, so little overflows and little moves when the number
    of shards changes.
    """

    shards: int = 40
    points: int = 512
    slack: float = 0.0

    def arcs(self) -> list[tuple[int, int]]:
        """(cell, shard) of each virtual node, clockwise; nodes in one cell stay in shard order."""
        at = [(xxhash.xxh64_intdigest(f"{s}/{k}") % CELLS, s) for s in range(self.shards) for k in range(self.points)]
        return sorted(dict(reversed(sorted(at))).items())

    def capacities(self, rows: int) -> list[int]:
        if self.slack:
            return [int(rows * (1 + self.slack) / self.shards) + 1] * self.shards
        return [rows // self.shards + (s < rows % self.shards) for s in range(self.shards)]

    def walk(self, counts: list[int]) -> list[tuple[int, int, int, int, int]]:
        """Ranges (arc, first rank, end rank, shard, first slot) for the rows of each arc."""
        arcs = self.arcs()
        room, slots, ranges, over = self.capacities(sum(counts)), [0] * self.shards, [], []

        def give(arc, first, n, shard):
            room[shard] -= n
            ranges.append((arc, first, first + n, shard, slots[shard]))
            slots[shard] += n

        for arc, (_, shard) in enumerate(arcs):
            own = min(counts[arc], room[shard])
            if own:
                give(arc, 0, own, shard)
            if own < counts[arc]:
                over.append((arc, own))
        for arc, first in over:
            at = arc
            while first < counts[arc]:
                at = (at + 1) % len(arcs)
                if n := min(counts[arc] - first, room[arcs[at][1]]):
                    give(arc, first, n, arcs[at][1])
                    first += n
        return ranges


def assign(rows: DataFrame, key: Column, ring: Ring, order: list[str] | None = None) -> DataFrame:
    """``rows`` with shard and slot (0, 1, 2 ... within each shard).

    ``rows`` should be narrow; it is written once. Rows with a null key are
    spread by the columns ``order`` (all of them unless given), by which the
    rows of an arc are ranked too.
    """
    order = order or rows.columns
    spread = F.pmod(F.when(key.isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(*order)), F.lit(CELLS))
    placed = common.cut(rows.withColumn("_cell", spread.cast("int")), "ring-rows")
    arcs = ring.arcs()
    stops = [cell for cell, _ in arcs]
    spark = rows.sparkSession
    at = np.searchsorted(stops, np.arange(CELLS)) % len(arcs)
    owner = spark.createDataFrame(pa.table({"_cell": np.arange(CELLS, dtype=np.int32), "_arc": at.astype(np.int32)}))
    on_arc = placed.join(F.broadcast(owner), "_cell").drop("_cell")
    counts = {r["_arc"]: r["count"] for r in on_arc.groupBy("_arc").count().collect()}  # at most one row per virtual node
    ranges = ring.walk([counts.get(a, 0) for a in range(len(arcs))])
    kinds = {"_on": np.int32, "_first": np.int64, "_end": np.int64, "shard": np.int32, "_slot": np.int64}
    columns = zip(*ranges) if ranges else [()] * len(kinds)
    plan = spark.createDataFrame(pa.table({name: np.array(c, kind) for (name, kind), c in zip(kinds.items(), columns)}))
    ranked = common.numbered(on_arc, ["_arc"], order, "_rank")
    here = (F.col("_arc") == F.col("_on")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))
    joined = ranked.join(F.broadcast(plan), here)
    return joined.select(*rows.columns, "shard", (F.col("_slot") + F.col("_rank") - F.col("_first")).alias("slot"))


def shard_documents(docs: DataFrame, ring: Ring = Ring()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, next_shard for every row.

    The law is ``rows``: with no slack the counts of any two shards differ by
    one at most. ``next_shard`` is where the row goes on a ring of one shard
    more, under the same law: its own shard again for nearly all rows. A null
    text counts as empty; repeated rows each get a slot of their own; an empty
    table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    key = F.col("doc_id")
    now = assign(rows, key, ring).withColumnsRenamed({"shard": "_shard", "slot": "_slot_"})
    grown = assign(now, key, replace(ring, shards=ring.shards + 1), rows.columns)
    return grown.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot_").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("shard").alias("next_shard"),
    )


def query(spark, sf_dir) -> DataFrame:
    return shard_documents(common.table(spark, sf_dir, "documents"))
