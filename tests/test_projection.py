"""Searches of bundles and trees, decisions: the cases that the registered queries' tables lack."""

from pyspark.sql import functions as F

from linkloom.operators import projection as P


def test_import_buckets(spark):
    rows = [("pkg", "mod"), ("pkg", "mod2"), ("pkg2", "mod"), ("a-pkg", "x"), ("other", "mod"), (None, None)]
    d = spark.createDataFrame(rows, "target_package string, source_module string")
    got = lambda p, m: [r[0] for r in d.select(P.import_bucket(p, m)).collect()]
    assert got("pkg", "mod") == [0, 1, 2, 3, None, None]
    assert got("pkg", None) == [0, 0, 1, 3, None, None]
    assert got(None, "mod") == [0, 1, 0, None, 0, None]
    assert got(None, None) == [0] * 6


def test_module_and_example_buckets(spark):
    d = spark.createDataFrame([("Lib", "x"), ("lib.a", "x"), ("a.lib", "x"), ("b", "src/lib"), ("b", "x")], "qualified_name string, path string")
    assert [r[0] for r in d.select(P.module_bucket("LIB ")).collect()] == [0, 1, 2, 3, None]
    assert [r[0] for r in d.select(P.module_bucket(" ")).collect()] == [0] * 5
    rows = [("t", ["q"], [], "", ""), ("t", [], ["q"], "", ""), ("t", ["qs"], [], "", ""), ("t", [], ["qs"], "", ""), ("t", [], [], "a/q", ""), ("t", [], [], "", "a q"), ("t", ["aq"], [], "", ""), ("t", [], ["aq"], "", ""), ("t", [], [], "", "")]
    e = spark.createDataFrame(rows, "title string, related_symbols array<string>, related_modules array<string>, path string, summary string")
    assert [r[0] for r in e.select(P.example_bucket("q")).collect()] == [3, 4, 5, 6, 7, 8, 9, 10, None]


def test_mixed_search_orders_pages_before_nodes(spark):
    pages = spark.createDataFrame([("p1", "Guide", "g.md", ["x"]), ("p2", "Other", "o.md", ["guide"])], "page_id string, title string, path string, keywords array<string>")
    nodes = spark.createDataFrame([("p1", "n1", "Guide", ["Guide"], ""), ("p2", "n2", "Part", ["The guide", "Part"], ""), ("gone", "n3", "Guide", ["Guide"], "")], "page_id string, node_id string, node_title string, structural_path array<string>, text string")
    got = [(r.score, r.kind, r.page_id, r.node_id) for r in P.mixed_search(pages, nodes, " Guide", 10).collect()]
    assert got == [(100, "page", "p1", ""), (100, "page_index_node", "p1", "n1"), (60, "page", "p2", ""), (60, "page_index_node", "p2", "n2")]
    assert P.tree_search(nodes, pages, "", 10).count() == 0


def test_decisions(spark):
    latest = spark.createDataFrame([("a", "provisional"), ("b", "promoted")], "suggestion_id string, state string")
    rows = [(1, "a", "rejected", 5), (2, "a", "promoted", 4), (3, "b", "rejected", 1), (4, "c", "promoted", 1)]
    d = spark.createDataFrame(rows, "decision_id long, suggestion_id string, target_state string, decided_at long")
    assert {r.decision_id: r.outcome for r in P.decide(latest, d).collect()} == {1: "finalized", 2: "applied", 3: "finalized", 4: "missing"}


def test_merge_records(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, name string, url string")
    over = spark.createDataFrame([(1, "", "y"), (3, "c", "")], "k int, name string, url string")
    got = {r.k: (r.name, r.url) for r in P.merge_records(base, over, "k", ["name", "url"]).select("k", "name", F.col("url")).collect()}
    assert got == {1: ("a", "y"), 2: ("b", None), 3: ("c", None)}
