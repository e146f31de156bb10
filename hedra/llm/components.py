"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedra.llm.common import stage, stage_counted

#: Edges up to which a graph is one task's work (16 bytes each); larger ones are dealt out.
FEW = 50_000


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and comp of a task's edges: roots are hooked to smaller ones, and labels jump to their roots, until no edge joins two roots."""
    ends = [(np.asarray(batch.column("a")), np.asarray(batch.column("b"))) for batch in batches]
    if not ends:
        return
    a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
    node, at = np.unique(np.append(a, b), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(node))
    while (apart := label[a] != label[b]).any():
        x, y = label[a[apart]], label[b[apart]]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[label])], names=["node", "comp"])


def components(edges: DataFrame, n: int | None = None) -> DataFrame:
    """node and comp, the smallest node reachable, of every node of `edges` (a, b).

    Labels spread to neighbours and then jump along themselves, so that rounds grow with the logarithm of the longest path; each round is
    written to the shared folder, and counts what it has changed while it writes. Every node is its own neighbour, so that a round is one join with
    the edges and one of the labels with themselves. n: the number of edges where it is known; up to FEW of them, of whole numbers and read from files (see common.stage),
    are solved by one task in one execution, without rounds.
    """
    edges = edges.where("a != b").select("a", "b")
    if n is not None and n <= FEW:
        return stage(edges.coalesce(1).mapInArrow(_solved, "node bigint, comp bigint"), "labels")
    both = edges.select(F.inline(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")]))).distinct()
    both = stage(both, "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("next"), F.max(F.when(F.col("a") == F.col("b"), F.col("comp"))).alias("was"))
        up = near.select(F.col("node").alias("up"), F.col("next").alias("top"))
        new = near.join(up, F.col("next") == F.col("up")).select("node", F.least("next", "top").alias("comp"), "was")
        new, changed = stage_counted(new, "labels", F.col("comp") != F.col("was"))
        labels = new.select("node", "comp")
        if not changed:
            return labels
