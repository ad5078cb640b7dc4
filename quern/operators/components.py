"""Connected components of an edge table, without any of it on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.plans import scratch

ROUNDS = 60
FOREST_EDGES = 100_000  # that one task joins before the rounds begin


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step. edges: u > v. Large: every larger neighbour of u gets an edge to the least of u and its
    neighbours. Small: u and its smaller neighbours get one."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges.select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    linked = both.join(least, both["u"] == least["w"])
    if larger:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _forests(links: DataFrame, parts: int) -> DataFrame:
    """The edges in `parts` tasks, each of which leaves an edge from every node to the least one that it is joined to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(parent.setdefault(u, u)), find(parent.setdefault(v, v))
                if a != b:
                    parent[max(a, b)] = min(a, b)
        rows = [(x, r) for x in parent if (r := find(x)) != x]
        kinds = batch.schema if parent else None
        for at in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[at : at + 50_000]], kinds.field(k).type) for k in (0, 1)], names=["u", "v"])

    return links.repartition(parts).mapInArrow(work, T.StructType(links.schema.fields))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns id, root: every node of an edge and the least node of its component.

    Tasks of FOREST_EDGES edges each join what they hold. With more than one such task, alternating large and small
    star steps join their forests, which takes about log n rounds; a hub's edges are summed before they are shuffled
    and its join is one that Spark can split. Each round is cut in the shared folder. Loops and repeated edges do no
    harm; edges with a null end are dropped; no edges give no rows.
    """
    links = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links, seen = scratch.cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "edges"), None
    parts = max(1, math.ceil(links.count() / FOREST_EDGES))
    links = scratch.cut(_forests(links, parts), "forests")
    for _ in range(ROUNDS if parts > 1 else 0):
        links = scratch.cut(_star(_star(links, True), False), "edges")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        if parts > 1:
            raise RuntimeError("components didn't converge")
    return links.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
