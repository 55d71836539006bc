"""Hash trees: digests by plain recursion, proofs of single rows, changed rows."""

import hashlib

from pyspark.sql import functions as F

from signalblind.operators import hashtree as H
from signalblind.sources import sinks


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_root(hashes):
    counts = {h: hashes.count(h) for h in hashes}
    depth = len(f"{len(counts) - 1:x}") - 1

    def node(prefix):
        below = sorted(h for h in counts if h.startswith(prefix))
        if len(prefix) == depth:
            return sha("".join(f"{h}:{counts[h]}" for h in below))
        return sha("".join(node(c) for c in sorted({h[: len(prefix) + 1] for h in below})))

    return node("")


def rows(spark, values):
    return spark.createDataFrame([(g, v) for g, v in values], "g string, v string")


def built(df, by=("g",)):
    held = H.leaves(df, F.sha2("v", 256), by)
    return held, H.tree(held, by)


def test_roots_by_plain_recursion(spark):
    values = [("big", str(i)) for i in range(5000)] + [("mid", str(i % 40)) for i in range(900)] + [("one", "x"), (None, "n"), (None, "n")]
    _, nodes = built(rows(spark, values))
    want = {g: (plain_root([sha(v) for k, v in values if k == g]), sum(k == g for k, _ in values)) for g in {k for k, _ in values}}
    assert {r.g: (r.digest, r.n) for r in H.roots(nodes, ["g"]).collect()} == want
    # no node has more than 16 children and no leaf many rows, whatever the group's size
    parents = nodes.filter("level > 0").groupBy("g", "level", F.expr("substring(prefix, 1, level - 1)")).count()
    assert parents.agg(F.max("count")).first()[0] <= 16 and nodes.filter("g = 'big' and leaf").agg(F.max("n")).first()[0] < 64
    _, again = built(rows(spark, values[::-1]).repartition(7))
    assert sorted(H.roots(again, ["g"]).collect(), key=str) == sorted(H.roots(nodes, ["g"]).collect(), key=str)


def test_proof_of_one_row(spark):
    df = rows(spark, [("a", str(i)) for i in range(3000)])
    held, nodes = built(df, ())
    root = H.roots(nodes).first().digest
    evidence = H.proof(held, nodes, sha("17")).collect()
    assert len(evidence) < 100 and H.proves(evidence, sha("17"), root)
    assert not H.proves(evidence, sha("nothing"), root) and not H.proves(evidence, sha("17"), sha("other"))
    forged = [r for r in evidence if not (r.kind == "record" and r.name != sha("17"))]
    assert not H.proves(forged, sha("17"), root)


def test_changed_rows_are_located(spark):
    one = [("big", str(i)) for i in range(3000)] + [("same", str(i)) for i in range(300)] + [("gone", "1")] + [("few", str(i)) for i in range(16)]
    two = [(g, v + "!" if g == "big" and v in ("5", "2999") else v) for g, v in one if g != "gone"] + [("new", "1"), ("few", "16"), ("same", "7")]
    (a_rows, a), (b_rows, b) = built(rows(spark, one)), built(rows(spark, two))
    found = {(r.g, r.h, r.side) for r in H.changed_rows(a_rows, b_rows, a, b, ["g"]).collect()}
    assert found == {("big", sha("5"), "a"), ("big", sha("2999"), "a"), ("gone", sha("1"), "a"), ("big", sha("5!"), "b"),
                     ("big", sha("2999!"), "b"), ("new", sha("1"), "b"), ("few", sha("16"), "b"), ("same", sha("7"), "b")}
    assert H.differing(a, b, ["g"]).filter("g = 'big'").count() == len({sha(v)[:2] for v in ("5", "2999", "5!", "2999!")})
    assert H.changed_rows(a_rows, a_rows, a, a, ["g"]).count() == 0


def test_empty_table(spark):
    held, nodes = built(rows(spark, []))
    assert nodes.count() == 0 and H.roots(nodes, ["g"]).count() == 0
    assert H.changed_rows(held, held, nodes, nodes, ["g"]).count() == 0


def test_bundle_holds_its_hashes(spark, tmp_path):
    members = spark.createDataFrame([(f"top_crops/{i}", sha(str(i))) for i in range(40)], "member string, sha256 string")
    sinks.export_bundle({"manifest": members.select("member")}, str(tmp_path / "bundle"), True, members=members)
    assert spark.read.json(str(tmp_path / "bundle/hashes")).count() == 40
    stored = spark.read.json(str(tmp_path / "bundle/hash_tree"))
    assert stored.filter("level = 0").first().digest == H.roots(sinks.bundle_tree(members)).first().digest
