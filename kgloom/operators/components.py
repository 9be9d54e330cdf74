"""Connected components of an edge table of any size.

Contraction rounds: each node picks, among itself and its neighbours, the node of least rank (a hash that changes
with the round, so that no order of names makes long chains), edges move to the picked nodes, loops and repeats go.
The number of edges falls by a constant factor a round. Rounds are cut by reliable checkpoints. Nodes keep their own
type; hubs cost nothing extra, as picks are pre-aggregated and joins have one row per node on their right side.

Once at most ``small`` edges are left, one task joins them: a bounded remainder is not worth rounds of shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def _joined(edges: DataFrame) -> DataFrame:
    """(u, p): each node of a few edges with one node of its component, found in one task."""
    kind = edges.schema["u"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, number, parent, types = [], {}, [], None

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for batch in batches:
            types = batch.schema.field(0).type
            for pair in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ends = []
                for value in pair:
                    key = tuple(value.values()) if isinstance(value, dict) else value
                    if key not in number:
                        number[key] = len(values)
                        values.append(value)
                        parent.append(number[key])
                    ends.append(find(number[key]))
                parent[max(ends)] = min(ends)
        if values:
            roots = [values[find(i)] for i in range(len(values))]
            yield pa.RecordBatch.from_arrays([pa.array(values, types), pa.array(roots, types)], names=["u", "p"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, StructType([StructField("u", kind), StructField("p", kind)]))


def connected_components(edges: DataFrame, left: str, right: str, checkpoint, small: int = 100_000) -> DataFrame:
    """(node, root) for every node of the edges; root is one node of its component, the same for all its nodes.

    ``checkpoint(df)`` materialises a table. Null ends and loops are dropped (a node that has only loops is not returned).
    """
    edges = checkpoint(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u != v").distinct())
    picks: list[DataFrame] = []
    while left_over := edges.limit(small + 1).count():
        if left_over <= small:
            picks.append(checkpoint(_joined(edges)))
            break
        seed = len(picks)
        rank = lambda c, seed=seed: F.xxhash64(F.col(c), F.lit(seed))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pick = both.groupBy("u").agg(F.min(F.struct(rank("v").alias("r"), F.col("v").alias("n"))).alias("best")).select("u", F.when(F.struct(rank("u").alias("r"), F.col("u").alias("n")) < F.col("best"), F.col("u")).otherwise(F.col("best.n")).alias("p"))
        pick = checkpoint(pick)
        picks.append(pick)
        moved = edges.join(pick, "u").select(F.col("p").alias("a"), "v").join(pick.select(F.col("u").alias("v"), F.col("p").alias("b")), "v").where("a != b")
        edges = checkpoint(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    if not picks:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = picks.pop()
    while picks:
        deeper = roots.select(F.col("u").alias("p"), F.col("p").alias("r"))
        roots = picks.pop().join(deeper, "p", "left").select("u", F.coalesce("r", "p").alias("p"))
    return roots.select(F.col("u").alias("node"), F.col("p").alias("root"))
