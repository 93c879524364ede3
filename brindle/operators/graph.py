"""Connected components by alternating stars over locally contracted edges.

Every task first joins the edges that it holds with a union-find of bounded size, which leaves one edge per vertex and
chunk. Once no more than one chunk is left, at once for a small graph, a single union-find of the same bounded size finishes
it. While it is more, each round hangs the neighbours of every vertex onto its smallest neighbour, first the larger ones
(large star), then the smaller ones (small star); the graph ends as one star per component. A round is two
min-aggregations, combined before the shuffle, and two joins, which adaptive execution can split for a vertex of very many
edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import Staged, ship

#: Edges that one union-find holds.
CHUNK = 500_000


def _stars(pairs: dict, schema: pa.Schema) -> pa.RecordBatch:
    def root(x):
        while (p := pairs[x]) != x:
            pairs[x] = x = pairs[p]
        return x

    rows = [(x, r) for x in pairs if (r := root(x)) != x]
    return pa.record_batch([pa.array([x for x, _ in rows], schema.field(0).type), pa.array([r for _, r in rows], schema.field(1).type)], schema=schema)


def _contract(e: DataFrame, chunk: int) -> DataFrame:
    """Edges (u, v) to stars (u, smaller v) of the components that each chunk of a partition sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        schema, held = None, 0
        for b in batches:
            schema = pa.schema([("u", b.schema.field(0).type), ("v", b.schema.field(1).type)])
            for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parent.setdefault(a, a)
                parent.setdefault(c, c)
                while parent[a] != a:
                    parent[a] = a = parent[parent[a]]
                while parent[c] != c:
                    parent[c] = c = parent[parent[c]]
                if a < c:
                    parent[c] = a
                else:
                    parent[a] = c
            held += b.num_rows
            if held >= chunk:
                yield _stars(parent, schema)
                parent, held = {}, 0
        if parent:
            yield _stars(parent, schema)

    return e.select("u", "v").mapInArrow(run, e.select("u", "v").schema)


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(low.select("u", F.col("m").alias("v"))).filter("u <> v")


def connected_components(edges: DataFrame, staged: Staged | None = None, max_rounds: int = 100, chunk: int = CHUNK) -> DataFrame:
    """edges(u, v) to (v, component): one row per vertex with an edge; component is the smallest id that it can reach.

    Self loops and nulls are ignored; an empty input gives an empty result. Ids may be of any one orderable type. chunk: edges
    that one task holds at once; a graph that no round makes smaller than that ends when every component is a star.
    """
    ship(edges.sparkSession)
    staged = staged or Staged(edges.sparkSession)
    e, n = staged.counted(_contract(edges.select("u", "v").filter("u <> v"), chunk))
    for _ in range(max_rounds):
        if n <= chunk:
            last = staged.write(_contract(e.coalesce(1), chunk + 1))
            break
        last, n = staged.counted(_contract(_small_star(_large_star(e)).distinct(), chunk))
        if n > chunk and _settled(last):
            break
        staged.drop(e)
        e = last
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if last is not e:
        staged.drop(e)
    roots = last.select(F.col("v")).distinct().select("v", F.col("v").alias("component"))
    return last.select(F.col("u").alias("v"), F.col("v").alias("component")).union(roots)


def _settled(e: DataFrame) -> bool:
    """Whether every vertex has one parent at most and no parent has one."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.filter("up > 1 or (up > 0 and down > 0)").isEmpty()
