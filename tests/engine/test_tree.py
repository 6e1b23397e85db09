import pytest

from inkwell.operators import tree


def test_nodes_parents_and_order(spark):
    paths = [["b", "x", "1"], ["a"], ["b", "x", "2"], ["b", "x", "2"], ["b", "y"], [], None, ["a", "é\"q"]]
    nodes = tree.node_rows(spark.createDataFrame([(p,) for p in paths], "path array<string>"))
    got = {tuple(r["path"]): r for r in tree.with_parents(nodes).collect()}
    assert {p: (r["level"], r["name"], r["leaves"], r["parent"], r["grandparent"]) for p, r in got.items()} == {
        ("a",): (1, "a", 2, None, None), ("b",): (1, "b", 4, None, None), ("b", "x"): (2, "x", 3, "b", None), ("b", "y"): (2, "y", 1, "b", None), ("b", "x", "1"): (3, "1", 1, "x", "b"), ("b", "x", "2"): (3, "2", 2, "x", "b"), ("a", "é\"q"): (2, "é\"q", 1, "a", None)}
    assert all(r["parent_id"] == (got[p[:-1]]["node_id"] if len(p) > 1 else None) for p, r in got.items())
    many = spark.range(500).selectExpr("id * 7919 % 500 AS v").repartition(6)
    assert sorted((r["v"], r["sort_order"]) for r in tree.ordered(many, ["v"]).collect()) == [(i, i + 1) for i in range(500)]


def test_upsert(spark, tmp_path):
    df = lambda *rows: spark.createDataFrame(list(rows), "k int, v string")
    at = str(tmp_path / "t")
    assert tree.upsert(spark, at, df((1, "a"), (2, None)), "k") == (2, 0)
    assert tree.upsert(spark, at, df((2, None), (3, "c")), "k") == (1, 1)
    assert tree.upsert(spark, at, df((3, "c")), "k") == (0, 1)
    for bad in (df((1, "x"), (9, "new")), df((2, "")), df((5, "a"), (5, "b"))):
        with pytest.raises(ValueError):
            tree.upsert(spark, at, bad, "k")
    assert sorted((r["k"], r["v"] or "") for r in spark.read.parquet(at).collect()) == [(1, "a"), (2, ""), (3, "c")]
