"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from .common import discard, stored


def _forest(batches):
    """The edges of one batch -> each of its nodes with the smallest node they reach, which says as much with fewer edges."""
    for batch in batches:
        nodes, ends = np.unique(np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()]), return_inverse=True)
        a, b = ends[: batch.num_rows], ends[batch.num_rows :]
        low = np.arange(len(nodes))
        while len(a):
            least = np.minimum(low[a], low[b])
            new = low.copy()
            np.minimum.at(new, low[a], least)
            np.minimum.at(new, low[b], least)
            new = new[new]
            if (new == low).all():
                break
            low = new
        while (low[low] != low).any():
            low = low[low]
        own = low != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[low[own]])], names=["src", "dst"])


def components(edges: DataFrame) -> DataFrame:
    """(src, dst) of longs -> (node, label): label is the smallest node that can be reached.

    Batches of edges are first reduced to forests.  Every round takes the least
    label among neighbours, then the label of that label, so a chain shortens
    geometrically; rounds end when no label moves.  Labels never leave the
    cluster.  An empty table of edges gives an empty result; nulls and loops are
    ignored.
    """
    links = edges.where("src is not null and dst is not null and src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    links = links.mapInArrow(_forest, "src long, dst long")
    both = stored(links.union(links.select("dst", "src")).distinct())
    labels, old = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("label")).select("node", F.least("node", "label").alias("label")), None
    moved = True
    while moved:
        near = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.src, "left").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = F.least("low", "far")
        told = Observation()
        step = step.join(jump, "low", "left").select("node", new.alias("label"), (new < F.col("label")).alias("moved"))
        labels = stored(step.observe(told, F.count_if("moved").alias("moved")).select("node", "label"))
        moved = told.get.get("moved", 0) > 0
        if old is not None:
            discard(old)
        old = labels
    discard(both)
    return labels
