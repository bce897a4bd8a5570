"""Folding of small sections, and pairs of similar names, against plain Python."""

import pytest
from pyspark.sql import functions as F

from linkloom.operators import enrich, knowledge, structure


def sections_of(levels):
    """Parents by heading level, as the parser gives them."""
    stack, out = [], []
    for i, (level, title, text) in enumerate(levels):
        while stack and stack[-1][0] >= level:
            stack.pop()
        out.append(("n", i, title, level, text, stack[-1][1] if stack else -1))
        stack.append((level, i))
    return out


def folded(rows, least):
    kids = {}
    for r in rows:
        kids.setdefault(r[5], []).append(r)

    def below(r):
        text = r[4].strip()
        parts = [text] if text else []
        for c in kids.get(r[1], []):
            inner = below(c)
            parts.append(f"{c[2]}\n{inner}" if inner else c[2])
        return "\n\n".join(parts)

    out = {}

    def walk(r):
        if kids.get(r[1]) and len(r[4].split()) < least:
            out[r[1]] = below(r)
            return
        out[r[1]] = r[4]
        for c in kids.get(r[1], []):
            walk(c)

    for r in kids.get(-1, []):
        walk(r)
    return out


CASES = [
    [(1, "G", "w " * 20), (2, "P", "two words"), (3, "C", "three words here")],
    [(1, "A", ""), (2, "B", ""), (3, "C", "c"), (2, "D", "d d"), (1, "E", "e"), (2, "F", "f " * 30), (3, "H", "h")],
    [(1, "A", "x " * 13), (2, "B", "x " * 13), (3, "C", "x"), (4, "D", ""), (5, "E", "e"), (6, "F", ""), (2, "G", "leaf")],
    [(0, "", "lead"), (2, "A", "a"), (1, "B", "b"), (3, "C", "c")],
    [(1, "only", "")],
]


@pytest.mark.parametrize("levels", CASES)
def test_thin(spark, levels):
    rows = sections_of(levels)
    d = spark.createDataFrame(rows, "path string, ord int, heading_title string, heading_level int, section_text string, parent int")
    got = structure.thin(d, 12)
    assert got.columns == d.columns
    assert {r.ord: r.section_text for r in got.collect()} == folded(rows, 12)


NAMES = ["Colour", "Color", "Kubernetes", "Kubernets", "NATION_1", "NATION_10", "NATION_11", "Postgres", "Postgress", "a b c", "c b a", "", "!!", "graph index", "graph  index", "index graph", "the long name of a service", "the long names of a service", "x", "xy", "Supplier#000000001", "Supplier#000000002", "Supplier#000010002", "data base", "database", "Graph Index"]


@pytest.mark.parametrize("threshold", [0.95, 0.9, 0.8, 0.6])
def test_duplicate_pairs(spark, threshold):
    """All pairs of names, one entity each name, and the other entities of a name."""
    rows = [(f"e{i:02}", n, "ab"[i % 2]) for i, n in enumerate([*NAMES, "color", "KUBERNETES"])]
    e = spark.createDataFrame(rows, "id string, name string, entity_type string")
    first = e.groupBy(knowledge.normal_name(F.col("name")).alias("x")).agg(F.min(F.struct("id", "name")).alias("f")).select("x", "f.*")
    pair = first.alias("l").join(first.alias("r"), F.col("l.id") < F.col("r.id")).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), knowledge.name_similarity(F.col("l.name"), F.col("r.name")).alias("s"))
    want = {(r.a, r.b): r.s for r in pair.filter(F.col("s") >= threshold).collect()}
    ids = {r.x: r.id for r in first.collect()}
    want |= {(ids[r.x], r.id): 1.0 for r in e.select("id", knowledge.normal_name(F.col("name")).alias("x")).collect() if ids[r.x] != r.id}
    got = {(r.left_id, r.right_id): r.similarity for r in knowledge.duplicate_pairs(e, threshold).collect()}
    assert got == pytest.approx(want) and len(got) > 5


def test_edits_of_one_note(spark):
    n = spark.createDataFrame([("a", "0123456789"), ("b", "0123456789"), ("c", "xyz")], "path string, content string")
    e = [("a", 0, 2, "01", "AA-", 1.0), ("a", 2, 4, "23", "", 1.0), ("a", 9, 10, "9", "é", 1.0), ("b", 0, 5, "01234", "q", 1.0), ("b", 4, 6, "45", "r", 1.0), ("c", 0, 1, "x", "w", 0.1)]
    edits = spark.createDataFrame(e, "path string, start int, end int, part string, text string, confidence double").withColumn("expected", F.sha2("part", 256))
    got = {r.path: (r.status, r.content) for r in enrich.apply_edits(n, edits, 0.5).collect()}
    assert got == {"a": ("applied", "AA-45678é"), "b": ("conflict", "0123456789")}
