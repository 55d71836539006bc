"""Hash trees over rows: a digest of any number of rows, proofs of single ones, and where two tables differ.

Rows are named by a SHA-256. A leaf holds the rows that share the first digits of it, as many
digits as leave about 16 different rows to a leaf; a node above has 16 children, one per
further digit. So no cell grows with the data, and the digest depends on the rows alone.
"""

import hashlib

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def _depth(distinct):
    return (F.length(F.hex(distinct - 1)) - 1).cast("int")


def _joined(rows, part):
    """Digest of an array's parts in their order."""
    return F.sha2(F.concat_ws("", F.transform(F.array_sort(rows), part)), 256)


def leaves(df: DataFrame, row, by=()) -> DataFrame:
    """``by``, h, n, depth: every different row hash (a hex column ``row``) once, with its
    number and the depth of its group's tree. Written out once."""
    by = list(by)
    counted = cut(df.select(*by, row.alias("h")).groupBy(*by, "h").agg(F.count(F.lit(1)).alias("n")))
    if not by:
        return counted.withColumn("depth", counted.agg(_depth(F.count(F.lit(1)))).scalar())
    # One row per group; null groups are groups of their own.
    depths = counted.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(_depth(F.count(F.lit(1))).alias("depth"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return counted.join(depths, same).drop(*[f"_{c}" for c in by])


def tree(rows: DataFrame, by=()) -> DataFrame:
    """``by``, level, prefix, digest, n, leaf: all nodes of the trees over ``leaves``; the roots are level 0.

    An empty table has no nodes.
    """
    by = list(by)
    ends = cut(rows.groupBy(*by, "depth", F.expr("substring(h, 1, depth)").alias("prefix")).agg(
        _joined(F.collect_list(F.struct("h", "n")), lambda r: F.concat(r["h"], F.lit(":"), r["n"])).alias("digest"), F.sum("n").alias("n")))
    columns = [*by, "prefix", "digest", "n"]
    deepest = ends.agg(F.max("depth")).first()[0] or 0
    above, levels = None, []
    for level in range(deepest, -1, -1):
        now = ends.filter(F.col("depth") == level).select(*columns, F.lit(True).alias("leaf"))
        if above is not None:
            now = now.unionByName(above.groupBy(*by, F.substring("prefix", 1, level).alias("prefix")).agg(
                _joined(F.collect_list(F.struct("prefix", "digest")), lambda c: c["digest"]).alias("digest"), F.sum("n").alias("n"),
                F.lit(False).alias("leaf")))
        # Each level is a sixteenth of the one below.
        above = cut(now) if level else now
        levels.append(above.select(*by, F.lit(level).alias("level"), "prefix", "digest", "n", "leaf"))
    out = levels[-1]
    for other in levels[-2::-1]:
        out = out.unionByName(other)
    return out


def roots(nodes: DataFrame, by=()) -> DataFrame:
    """``by``, digest, n of every tree."""
    return nodes.filter("level = 0").select(*by, "digest", "n")


def proof(rows: DataFrame, nodes: DataFrame, h: str, where=None) -> DataFrame:
    """kind, name, value: what shows that a row is in a tree, without the other rows.

    The records of its leaf and, on every level, the digests beside its path: at most 16 a
    level and about 16 records. ``where`` picks the group.
    """
    picked, inside = (nodes, rows) if where is None else (nodes.filter(where), rows.filter(where))
    mine = F.lit(h)
    beside = picked.filter((F.col("level") > 0) & F.expr("substring(prefix, 1, level - 1)").eqNullSafe(F.substring(mine, F.lit(1), F.col("level") - 1)))
    records = inside.filter(F.substring(F.col("h"), F.lit(1), F.col("depth")) == F.substring(mine, F.lit(1), F.col("depth")))
    return beside.select(F.lit("node").alias("kind"), F.col("prefix").alias("name"), F.col("digest").alias("value")).unionByName(
        records.select(F.lit("record").alias("kind"), F.col("h").alias("name"), F.col("n").cast("string").alias("value")))


def proves(evidence, h: str, root: str) -> bool:
    """Whether collected rows of ``proof`` lead from the row ``h`` to the digest ``root``."""
    records = sorted((r.name, r.value) for r in evidence if r.kind == "record")
    nodes = {r.name: r.value for r in evidence if r.kind == "node"}
    if h not in [name for name, _ in records]:
        return False
    digest = hashlib.sha256("".join(f"{a}:{n}" for a, n in records).encode()).hexdigest()
    for level in range(max((len(p) for p in nodes), default=0), 0, -1):
        beside = {p: d for p, d in nodes.items() if len(p) == level} | {h[:level]: digest}
        digest = hashlib.sha256("".join(beside[p] for p in sorted(beside)).encode()).hexdigest()
    return digest == root


def differing(a: DataFrame, b: DataFrame, by=()) -> DataFrame:
    """``by``, prefix: the leaves in which two trees differ, found from the roots down.

    Only children of differing nodes are compared. A group whose depth changed differs
    in all its leaves.
    """
    by = list(by)
    deepest = max(a.agg(F.max("level")).first()[0] or 0, b.agg(F.max("level")).first()[0] or 0)
    open_nodes, found = None, None
    for level in range(deepest + 1):
        left, right = (t.filter(F.col("level") == level).select(*by, "prefix", F.col("digest").alias(f"{s}_digest"), F.col("leaf").alias(f"{s}_leaf"))
                       for s, t in (("a", a), ("b", b)))
        if open_nodes is not None:
            parent = F.substring("prefix", 1, level - 1)
            left, right = (t.withColumn("_up", parent).join(open_nodes, _same(t, open_nodes, by) & (F.col("_up") == F.col("_open")), "left_semi").drop("_up")
                           for t in (left, right))
        renamed = right.select(*[F.col(c).alias(f"_{c}") for c in [*by, "prefix"]], "b_digest", "b_leaf")
        match = F.lit(True)
        for c in [*by, "prefix"]:
            match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
        both = left.join(renamed, match, "full_outer").filter(~F.col("a_digest").eqNullSafe(F.col("b_digest"))).select(
            *[F.when(F.col("a_digest").isNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in [*by, "prefix"]],
            (F.coalesce("a_leaf", F.lit(False)) | F.coalesce("b_leaf", F.lit(False))).alias("leaf"))
        both = cut(both)
        ended = both.filter("leaf").select(*by, "prefix")
        found = ended if found is None else found.unionByName(ended)
        open_nodes = both.select(*[F.col(c).alias(f"_o_{c}") for c in by], F.col("prefix").alias("_open"))
    return found


def _same(t, open_nodes, by):
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return match


def changed_rows(a_rows: DataFrame, b_rows: DataFrame, a: DataFrame, b: DataFrame, by=()) -> DataFrame:
    """``by``, h, side: the rows that only one of two tables holds (or holds more often), read
    from differing leaves alone. ``a`` and ``b`` are the trees of the ``leaves`` tables."""
    by = list(by)
    where = differing(a, b, by).select(*[F.col(c).alias(f"_o_{c}") for c in by], F.col("prefix").alias("_open")).distinct()
    sides = []
    for name, mine, other in (("a", a_rows, b_rows), ("b", b_rows, a_rows)):
        near = mine.withColumn("_leaf", F.expr("substring(h, 1, depth)")).join(where, _same(mine, where, by) & (F.col("_leaf") == F.col("_open")), "left_semi")
        against = other.select(*[F.col(c).alias(f"_x_{c}") for c in by], F.col("h").alias("_x"), F.col("n").alias("_xn"))
        match = (F.col("h") == F.col("_x")) & (F.col("n") <= F.col("_xn"))
        for c in by:
            match = match & F.col(c).eqNullSafe(F.col(f"_x_{c}"))
        sides.append(near.join(against, match, "left_anti").select(*by, "h", F.lit(name).alias("side")))
    return sides[0].unionByName(sides[1])
