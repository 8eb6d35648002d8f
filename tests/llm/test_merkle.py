import hashlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from chatterflow.llm import merkle as M


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(leaves):
    """All levels of a tree, the last one holds the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 2])) for i in range(0, len(now), 2)])
    return levels


def siblings(levels, i):
    out = []
    for now in levels[:-1]:
        other = i ^ 1
        out.append((other < i, now[other] if other < len(now) else None))
        i >>= 1
    return out


def expected(rows):
    """rows: (doc_id, key, leaf). By (key, place): leaf, path, subroot, root."""
    order = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, r[2]))
    trees = [(k, brute([r[2] for r in g])) for k, g in groupby(order, key=lambda r: r[1])]
    top = brute([t[-1][0] for _, t in trees])
    found = []
    for n, (_, levels) in enumerate(trees):
        for i, leaf in enumerate(levels[0]):
            found.append((leaf, siblings(levels, i) + siblings(top, n), levels[-1][0], top[-1][0]))
    return found


@pytest.mark.parametrize("step", [1, 2, 8])
def test_proofs_equal_brute_force(spark, step):
    sizes = {None: 1, "": 2, "a": 37, "b": 5, "ä": 1, "é": 16, "zz": 9}
    rows = [(i if i % 11 else None, k, sha(f"{k} {i % 29}")) for k, n in sizes.items() for i in range(n)]
    rows += [(3, "b", sha("same"))] * 3
    df = spark.createDataFrame(rows, "doc_id long, key string, leaf string").repartition(5)
    for c in ("tree", "at", "n", "node", "path", "root", "_block", "_part", "Left"):
        df = df.withColumn(c, F.lit("x"))
    out = M.manifest(df, step).withColumns({"folded": M.folded(F.col("leaf"), F.col("path")), "digest": M.proof_digest(F.col("path"))})
    assert {c: out.columns.count(c) for c in ("tree", "at", "n", "node", "path", "root", "_block", "_part", "Left")} == dict.fromkeys(("tree", "at", "n", "node", "path", "root", "_block", "_part", "Left"), 1)
    got = [(r.leaf, [(s.left, s.node) for s in r.path], r.subroot, r["root"]) for r in out.collect()]
    key = lambda r: (r[0], str(r[1]))
    assert sorted(got, key=key) == sorted(expected(rows), key=key)
    for r in out.collect():
        assert r.folded == r["root"] and r.digest == sha("".join(s.node or "" for s in r.path)) and r.tree == "x"


def test_no_rows_and_one_row(spark):
    kind = "doc_id long, key string, leaf string"
    assert M.manifest(spark.createDataFrame([], kind)).collect() == []
    (one,) = M.manifest(spark.createDataFrame([(None, None, sha(""))], kind)).collect()
    assert (one.path, one.subroot, one["root"]) == ([], sha(""), sha(""))


def test_leaf_fields_and_changes(spark, odd):
    got = {(r.doc_id, r.x) for r in odd.select("doc_id", M.leaf(F.col("doc_id"), F.col("text"), F.col("source")).alias("x")).collect()}
    texts = [None, "", " \t\n", "one", "word " * 30_000, "12 34 !!", "l'été été"]
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    sources = [None, "s", "s", None, "s", "s", "t"]
    assert got == {(i, sha(field(i) + field(t) + field(s))) for i, (t, s) in enumerate(zip(texts, sources, strict=True))}
    leaves = odd.select("doc_id", F.col("lang").alias("key"), M.leaf(F.col("text")).alias("leaf"))
    proofs = M.manifest(leaves, 2).withColumn("other", M.folded(F.sha2(F.concat("leaf", F.lit("!")).cast("binary"), 256), F.col("path")))
    assert all(r.other != r["root"] for r in proofs.collect()) and proofs.count() == 14
