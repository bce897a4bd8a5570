"""Operators that grow with their input: same rows as by plain means, odd inputs included, and no step that grows faster."""

import pytest
from pyspark.sql import functions as F

from linkloom.functions import lexical as L
from linkloom.functions import similarity as M
from linkloom.operators import graph as G
from linkloom.operators import knowledge as K
from linkloom.operators import repo as R
from linkloom.operators import structure as X
from linkloom.plans import catalog, check


def test_knn(spark, monkeypatch):
    rows = [(i, [float((i * 7 + j * 3) % 11) for j in range(5)]) for i in range(40)]  # equal vectors too
    rows += [(100, None), (101, [0.0] * 5), (102, [1.0, 2.0]), (103, [1.0, None, 0.0, 0.0, 0.0]), (104, [])] + [(200 + i, [2.0, 1.0, 0.0, 5.0, 1.0]) for i in range(9)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    q = v.filter("vec_id % 4 = 0 or vec_id = 102").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    all_of = v.crossJoin(q).select("query_id", "vec_id", L.cosine(F.col("embedding"), F.col("query")).alias("score")).collect()
    want = set()
    for one in {r.query_id for r in all_of}:
        best = sorted((r for r in all_of if r.query_id == one), key=lambda r: (-r.score, r.vec_id))[:6]
        want |= {(one, r.vec_id, r.score, n) for n, r in enumerate(best, 1)}
    for most in (K.MOST_QUERIES, 3):
        monkeypatch.setattr(K, "MOST_QUERIES", most)
        assert {tuple(r) for r in K.knn(v, q, 6).collect()} == want
    assert K.knn(v, q.limit(0), 6).count() == 0 and K.knn(v.limit(0), q, 6).count() == 0
    assert "CartesianProduct" not in K.knn(v, q, 6)._jdf.queryExecution().toString()


def test_names_with_a_common_beginning_are_no_candidates(spark):
    names = spark.createDataFrame([(f"supplier{i:09}",) for i in range(0, 9_000, 7)] + [("supplier",), ("nation1",)], "name string")
    assert K._similar_candidates(names, 0.9).count() < 20_000  # of 830,000 pairs; near ones are some ten a name


def test_byte_vector_counts_by_position(spark):
    texts = ["", None, "a", "red bolt", "é" * 100, "\0\0", "x" * 128 + "yz", "ÿ"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", M.byte_vector(F.col("t"), 8).alias("v")).collect()
    for r in got:
        sums = [sum(b / 255 for b in (r.t or "").encode()[k::8]) for k in range(8)]
        norm = sum(x * x for x in sums) ** 0.5
        assert r.v == pytest.approx([x / norm if norm else 0.0 for x in sums])
    many = spark.range(60_000).select(F.concat(F.lit("a name of some length "), "id").alias("t")).select(F.aggregate(M.byte_vector(F.col("t")), F.lit(0.0), lambda s, x: s + x * x).alias("n"))
    assert many.filter("abs(n - 1) < 1e-9").count() == 60_000


def test_fusion_of_scores_above_one(spark):
    a = spark.createDataFrame([("x", 0.5), ("y", 0.2)], "id string, vector_score double")
    t = spark.createDataFrame([("x", 1.2)], "id string, topology_score double")
    got = lambda c: {r.id: (r.topology_score, r.score) for r in K.fuse(a, t, clamped=c).collect()}
    assert got(True)["x"] == pytest.approx((1.0, 0.75)) and got(False)["x"] == pytest.approx((1.2, 0.85)) and got(False)["y"] == pytest.approx((0.0, 0.1))


def test_address_by_looser_ways(spark):
    """As SQL has it: a path of the title alone gives no row, but stands before titles that hold it."""
    row = lambda i, title, path: ("n", i, title, path, {})
    frame = lambda rows: spark.createDataFrame(rows, "path string, ord int, heading_title string, heading_path string, attributes map<string,string>")
    got = lambda rows, least: {(r.ord, r.how) for r in X.address(frame(rows), "the", least).collect()}
    part, end, whole = row(0, "the sea", "the sea"), row(1, "The", "a / The"), row(2, "THE", "THE")
    assert got([part, end, whole], 3) == {(1, 3)} and got([part, whole], 3) == set() and got([part], 3) == {(0, 4)}
    assert got([part, end, whole], 0) == {(2, 2)} and got([], 3) == set()


def test_notes_meet_by_one_shuffle(spark):
    s = X.sections(spark.createDataFrame([("n", "# A\nx\n## B\ny\n### C\nz"), ("m", None)], "path string, content string"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(X.lineage(s)) and "Exchange" not in plan(X.lineage(s))
    assert "Join" not in plan(X.thin(s)) and plan(X.thin(s)).count("Exchange") == 1
    assert "MapIn" not in plan(X.semantic_issues(s))  # five kinds of issues, one parse
    assert {(r.path, r.ord, r.trace) for r in X.lineage(s).collect()} == {("n", 0, "A"), ("n", 1, "A > B"), ("n", 2, "A > B > C"), ("m", 0, "")}
    assert {(r.path, r.section_text) for r in X.thin(s).collect()} == {("n", "x\n\nB\ny\n\nC\nz"), ("m", "")}


def test_related_pages_are_counted_once(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 3)
    rows = [(f"p{i}", f"a{j}") for i in range(12) for j in range(6) if (i * j) % 4 < 2] * 2 + [("p1", None), (None, "a1"), ("lone", "b")]
    a = spark.createDataFrame(rows, "page_id string, anchor string")
    own = {(p, x) for p, x in rows if p and x}
    want = {}
    for p, x in own:
        for q, y in own:
            if x == y and p != q:
                want[p, q] = want.get((p, q), 0) + 1
    assert {(r.left, r.right): r.shared for r in R.related_pages(a).collect()} == want


def test_pagerank_reads_the_links_that_are_met(spark):
    far = [(f"x{i}", f"x{i + 1}") for i in range(300)]
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("b", "a"), *far], "src string, dst string")
    seeds = spark.createDataFrame([("a", 1.0), ("alone", 1.0)], "id string, weight double")
    step, score = {"a": "bc", "b": "ac", "c": "abd", "d": "c"}, {"a": 0.5, "alone": 0.5}
    for _ in range(5):
        new = {k: 0.15 * v + 0.85 * v * score.get("alone", 0) for k, v in {"a": 0.5, "alone": 0.5}.items()}
        for n, s in score.items():
            for m in step.get(n, ""):
                new[m] = new.get(m, 0) + 0.85 * s / len(step[n])
        score = new
    assert {r.id: r.score for r in G.ppr(e, seeds, rounds=5).collect()} == pytest.approx(score)
    assert G._sized_links(e, seeds.select("id")).count() == 2


def test_overlap_by_whole_words(spark):
    rows = [("1", "The x", "de-luxe", ["en"], "c"), ("2", "other", "a DE", None, "c"), ("3", None, "the_the", ["de"], "the de"), ("4", "thé", "", ["the"], "c")]
    d = spark.createDataFrame(rows, "id string, title string, content string, tags array<string>, category string")
    got = {r.id: r.s for r in d.select("id", K.text_overlap("the de the").alias("s")).collect()}
    assert got == pytest.approx({"1": 2 / 3, "2": 1 / 3, "3": 1 / 3 + 0.1, "4": 2 / 3})
    assert "split" not in d.select(K.text_overlap("the de"))._jdf.queryExecution().toString()


def test_gaps_with_repeated_relations(spark):
    f = spark.createDataFrame
    m, s, d = f([("m1",), ("m2",)], "module_id string"), f([("s1", "n"), ("s2", "k")], "symbol_id string, name string"), f([("d1", "t"), ("d2", "u")], "doc_id string, title string")
    r = f([("d1", "m1", "documents"), ("d1", "s1", "documents")] * 3, "source_id string, target_id string, kind string")
    got = sorted((x.gap_kind, x.entity_id) for x in R.gaps(m, s, d, r).collect())
    assert got == [("doc_without_anchor", "d2"), ("module_without_docs", "m2"), ("symbol_unverified", "s1"), ("symbol_without_docs", "s2")]


def test_pagerank_walks_all_rounds(sf):
    """The scores of `personalized_pagerank`, which equal those of its SQL, change by under 0.02 in all with one more round; after 4 rounds by far more."""
    con = check.connect(sf)
    con.execute(f"create table score as {catalog.ORACLE_SQL['personalized_pagerank']}")
    con.execute("create table step as select distinct 'p:' || l_partkey as src, 's:' || l_suppkey as dst from lineitem")
    con.execute("insert into step select dst, src from step")
    more = "select dst as id, 0.85 * sum(score / degree) as s from score join step on src = id join (select src, count(*) as degree from step group by 1) using (src) group by 1"
    seeds = "select unnest(['p:1', 's:2']) as id, 0.15 * 0.5 as s"
    change = con.execute(f"select sum(abs(n.s - score)) from score join (select id, sum(s) as s from (from ({more}) union all from ({seeds})) group by 1) n using (id)").fetchone()[0]
    assert change < 0.02


def test_pagerank_with_links_in_pieces(spark, monkeypatch):
    e = spark.createDataFrame([("a", f"n{i}") for i in range(20)] + [("n1", "n2")], "src string, dst string")
    seeds = spark.createDataFrame([("n1", 1.0)], "id string, weight double")
    got = lambda: {r.id: r.score for r in G.ppr(e, seeds, rounds=4).collect()}
    whole = got()
    monkeypatch.setattr(G, "LISTED", 3)
    assert G._listed_links(e, spark.createDataFrame([("a",)], "id string")).count() > 1
    assert got() == pytest.approx(whole) and len(whole) == 21


@pytest.mark.parametrize("sizes", [{}, {"PIECE": 3, "BLOCK": 2, "STEP": 50, "CELLS": 9, "GIVEN": 2}, {"SPARSE": 0, "CELLS": 7}, {"SPARSE": 10**9, "STEP": 1_000}])
def test_pairs_by_block(spark, monkeypatch, sizes):
    """Dense and sparse counts, small blocks, pieces and several steps all give the pairs and families by definition."""
    for name, n in sizes.items():
        monkeypatch.setattr(R, name, n)
    rows = [(f"p{i}", f"a{j}") for i in range(9) for j in range(5) if (i * j) % 4 < 2] * 2 + [("p1", None), (None, "a1"), ("lone", "b")]
    a = spark.createDataFrame(rows, "page_id string, anchor string")
    own = {(p, x) for p, x in rows if p and x}
    want = {}
    for p, x in own:
        for q, y in own:
            if x == y and p != q:
                want[p, q] = want.get((p, q), 0) + 1
    got = [tuple(r) for r in R.related_pages(a).select("left", "right", "shared").collect()]
    assert sorted(got) == sorted((*k, n) for k, n in want.items())
    kind, title = {f"p{i}": "xy"[i % 2] for i in range(8)}, {f"p{i}": "same" if i % 3 else f"t{9 - i}" for i in range(8)}  # p8 is no known page
    best = {}
    for (p, q), n in want.items():
        if q in kind:
            best.setdefault((p, kind[q]), []).append((-n, title[q], q))
    first = sorted((p, k, q, -n) for (p, k), found in best.items() for n, _, q in sorted(found)[:2])
    pages = spark.createDataFrame([(p, kind[p], title[p]) for p in kind], "page_id string, kind string, title string")
    assert sorted(tuple(r) for r in R.families(a, pages, 2).select("left", "kind", "right", "shared").collect()) == first
    assert R.related_pages(a.limit(0)).count() == 0 and R.families(a.limit(0), pages, 2).count() == 0


def test_a_list_of_neighbours_is_sent_once(spark, sf, monkeypatch):
    """Not once for each of its pages: what is sent grows with the lists, and with the blocks that they touch."""
    a = spark.range(4_000).select(F.format_string("p%05d", F.col("id")).alias("page_id"), F.concat(F.lit("a"), (F.col("id") / 50).cast("int").cast("string")).alias("anchor"))
    _, lists = R._page_lists(a)
    assert lists.count() == 80 and lists.agg(F.sum(F.size("pages") * F.size("starts"))).first()[0] < 12_000  # 98,000 before
    plan = R._pairs(lists, False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_families_are_cut_before_they_are_shuffled(spark):
    a = spark.range(60).select(F.concat(F.lit("p"), "id").alias("page_id"), F.lit("a").alias("anchor"))
    pages = a.select("page_id", F.lit("k").alias("kind"), F.col("page_id").alias("title"))
    plan = R.families(a, pages, 2)._jdf.queryExecution().executedPlan().toString()
    cut = plan.index("Partial")
    assert "WindowGroupLimit" in plan[cut - 200 : cut] and plan.index("FlatMapGroupsInArrow") > cut  # plans read from their ends
    assert "Exchange hashpartitioning(block" in plan
