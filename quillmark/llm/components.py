"""Connected components of a distributed edge list.

Each task first joins the links it holds, a bounded number at a time, and
passes on a star for each part it found; there are as many tasks as the number
of links asks for, not as many as a shuffle has.  Alternating large-star and
small-star steps (Kiveris et al., 2014) on tables then join the stars: each
step is a grouped minimum with map-side combine, and every iteration is
written to the shared folder, so lineage stays short and no component, link
or label is ever gathered on the driver or in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import discard, materialize

#: Links that a task joins at once.
HELD_LINKS = 100_000


def _local_stars(edges: DataFrame, held_links: int) -> DataFrame:
    """Fewer links with the same components: those of the least node of each
    component among the links that a task holds at a time."""
    kind = edges.schema["a"].dataType.simpleString()

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}
        schema, held = None, 0

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def stars() -> Iterator[pa.RecordBatch]:
            ends = [(n, r) for n in list(root) if (r := find(n)) != n]
            for low in range(0, len(ends), 10_000):
                part = ends[low : low + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in part], schema.field(i).type) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            schema, held = batch.schema, held + len(batch)
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
            if held >= held_links:
                yield from stars()
                root.clear()
                held = 0
        if root:
            yield from stars()

    return edges.mapInArrow(join, f"a {kind}, b {kind}")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (or all not larger) neighbours of each node to its least
    neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    back = both.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = both.unionByName(back) if large else both.unionByName(back).filter("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    kept = near.join(least, "u")
    if large:
        return kept.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    to = kept.select(F.col("v").alias("a"), F.col("m").alias("b"))
    return to.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, held_links: int = HELD_LINKS) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node
    of the component.  Rows with a null or two equal ends are ignored."""
    edges = edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    tasks = max(1, math.ceil(edges.count() / held_links))  # each as full as it may be: fewer stars for the steps
    edges = materialize(_local_stars(edges.coalesce(tasks), held_links), "edges")
    while True:
        # a fixpoint has one parent for each node and no parent that has one
        many = edges.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
        if not many and not edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count():
            break
        stars = materialize(_star(_star(edges, True), False), "stars")
        discard(edges)
        edges = stars
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
