"""Connected groups of a link table by pointer jumping."""

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def connected(links: DataFrame, a="a", b="b") -> DataFrame:
    """(node, root) of every node of a link; all nodes that links connect have the same root.

    Every node points at a node; in the end at its root. A round hangs each root below the
    smallest root that a link shows beside it, then lets every node point where its target
    points, so paths halve while trees merge. Links inside a tree are dropped on the way.
    A round is cut; only one count of open links reaches the driver.
    """
    open_links = cut(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b"))
    nodes = open_links.select(F.col("a").alias("node")).union(open_links.select("b")).distinct()
    at = cut(nodes.select("node", F.col("node").alias("root")))
    while not open_links.isEmpty():
        # Links now run between roots; the larger root goes below its smallest neighbour.
        hung = open_links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("to")).groupBy("x").agg(F.min("to").alias("to"))
        hung = jumped(cut(hung))
        at = cut(at.join(hung, at["root"] == hung["x"], "left").select("node", F.coalesce("to", "root").alias("root")))
        one = hung.select(F.col("x").alias("a"), F.col("to").alias("ra"))
        two = hung.select(F.col("x").alias("b"), F.col("to").alias("rb"))
        moved = open_links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        open_links = cut(moved.filter("a <> b").distinct())
    return at


def jumped(pointers: DataFrame) -> DataFrame:
    """Pointers (x, to), each to a smaller one, followed to their ends."""
    while True:
        further = pointers.select(F.col("x").alias("to"), F.col("to").alias("end"))
        new = cut(pointers.join(further, "to", "left").select("x", F.coalesce("end", "to").alias("to"), F.col("end").isNotNull().alias("_moved")))
        pointers = new.drop("_moved")
        if new.filter("_moved").isEmpty():
            return pointers
