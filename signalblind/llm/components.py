"""Connected components of an edge table, without ever gathering it."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalblind.operators.clusters import connected


def forest(edges: DataFrame, a="a", b="b") -> DataFrame:
    """(a, b): fewer links of whole numbers that connect the same nodes.

    Links meet by their ``a`` end, which should be the one with few links, and each task
    hangs all it can reach below its smallest node. So a node linked with many of the same
    others, as members of a large group are, keeps about one link. Null ends are ignored.
    """

    def run(batches):
        ends = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
        if not ends:
            return
        nodes, at = np.unique(np.concatenate([e[0] for e in ends] + [e[1] for e in ends]), return_inverse=True)
        one, two = np.split(at, 2)
        label = np.arange(len(nodes))
        while True:
            least = np.minimum(label[one], label[two])
            low = label.copy()
            # a root goes below the smallest root beside any of its members
            np.minimum.at(low, label[one], least)
            np.minimum.at(low, label[two], least)
            while not np.array_equal(low[low], low):
                low = low[low]
            if np.array_equal(low[label], label):
                break
            label = low[label]
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["a", "b"])

    links = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).filter("a is not null and b is not null and a <> b")
    return links.repartition("a").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, a="a", b="b") -> DataFrame:
    """(node, component) of every node of an edge, the component being its smallest node.

    Trees of links are contracted round by round; links inside a tree drop out, so most are
    read once or twice. A round is cut by a checkpoint. Null ends are ignored.
    """
    return connected(edges, a, b).withColumnRenamed("root", "component")
