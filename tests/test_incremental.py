import pytest
from pyspark.sql import functions as F

from linkloom.operators import corpora as C
from linkloom.operators import graph as G
from linkloom.operators import incremental as I
from linkloom.operators import saliency as A
from linkloom.streaming import touches as ST


def test_rewrite_keeps_null_paths(spark):
    base = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "path string, n int")
    new = spark.createDataFrame([("a", 9)], "path string, n int")
    assert sorted((r.path or "", r.n) for r in I.rewrite(base, new, new).collect()) == [("", 2), ("a", 9), ("b", 3)]


def test_mutation_plans(spark):
    repo, file = "repo_id string, revision string", "repo_id string, path string, hash string"
    current = spark.createDataFrame([("same", "v"), ("moved", "v"), ("new", "v"), ("edited", "v"), ("emptied", None)], repo)
    published = spark.createDataFrame([("same", "v"), ("moved", "u"), ("edited", "v"), ("emptied", None)], repo)
    before = spark.createDataFrame([("same", "a", "1"), ("moved", "a", None), ("edited", "a", "1"), ("edited", "b", "1"), ("emptied", "a", None)], file)
    after = spark.createDataFrame([("same", "a", "1"), ("moved", "a", None), ("new", "a", "1"), ("edited", "a", "2"), ("edited", "c", "1")], file)
    got = {r.repo_id: (r.action, r.changed) for r in I.plan_mutations(current, published, before, after).collect()}
    assert got == {"same": ("noop", 0), "moved": ("refresh_publication", 0), "new": ("replace_all", 1), "edited": ("clone_and_mutate", 3), "emptied": ("clone_and_mutate", 1)}


def test_versioned_names(spark):
    current = spark.createDataFrame([("r", "v"), ("s", "v")], "repo_id string, revision string")
    files = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2")], "repo_id string, path string, hash string")
    names = lambda f, n: {r[0]: r[1] for r in I.versioned_names(current, f, n).collect()}
    first = names(files, 1)
    assert first == names(files.orderBy("hash", ascending=False), 1) and first["r"] != first["s"]
    assert first["r"] != names(files, 2)["r"] != names(files.filter("path = 'a'"), 2)["r"]


def test_epochs(spark, tmp_path):
    e = I.Epochs(spark, str(tmp_path / "corpus"))
    with pytest.raises(LookupError):
        e.read()
    assert e.begin("f1") == "started" and e.begin("f1") == "already_indexing"
    assert e.publish(spark.range(3), "f1") == 1 and e.begin("f1") == "already_ready"
    assert e.begin("f2") == "started"
    with pytest.raises(ValueError):
        e.publish(spark.range(9), "other")
    assert e.publish(spark.range(5), "f2") == 2 and e.read().count() == 5


def test_stream_equals_batch(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    from linkloom.plans.catalog_knowledge import touches

    want = {r.node_id: (round(r.current, 6), r.activations) for r in A.fold(touches(spark, sf)).collect()}
    got = {r.node_id: (round(r.current, 6), r.activations) for r in ST.run_once(ST.touched(ST.source(spark, sf)), "update").collect()}
    assert got == want and len(got) == e.select("user_id").distinct().count()


def test_missing_payload_is_an_error(spark):
    found, stored = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "x")], "id string, hit string")
    with pytest.raises(Exception, match="no payload"):
        C.hydrate(found, stored, ["hit"]).collect()


def test_glob():
    import re

    assert re.match(C.glob_pattern("src/**/*.rs"), "src/a/b.rs") and re.match(C.glob_pattern("src/**/*.rs"), "src/b.rs")
    assert not re.match(C.glob_pattern("src/*.rs"), "src/a/b.rs")


def test_pagerank_sums_to_one(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a", 1.0), ("z", 1.0)], "id string, weight double")
    got = {r.id: r.score for r in G.ppr(edges, seeds, rounds=40, tolerance=1e-9).collect()}
    assert sum(got.values()) == pytest.approx(1.0, abs=1e-6) and got["z"] > 0 and got["a"] > got["d"]


def test_saliency_clamps(spark):
    t = spark.createDataFrame([("n", 0, 10**6), ("m", 0, 1), ("m", 86_400 * 900, 1)], "node_id string, at long, delta long")
    got = {r.node_id: r.current for r in A.fold(t).collect()}
    assert got["n"] == 10.0 and 1.0 <= got["m"] < 2.0
    later = A.decay(A.fold(t), 86_400 * 5_000).select(F.max("current")).first()[0]
    assert later == 1.0


def test_one_partition_is_the_plain_walk(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "f")], "src string, dst string")
    seed = spark.createDataFrame([("a", 2.0)], "id string, weight double")
    rows = lambda df: [(r.id, r.distance, round(r.score, 9)) for r in df.collect()]
    assert rows(G.related_partitioned(e, seed, 2, 9, rounds=4)) == rows(G.related(e, seed, 2, 9, rounds=4))
    assert G.related_partitioned(e, spark.createDataFrame([("lone", 1.0)], "id string, weight double"), 2, 9, rounds=4).count() == 0
