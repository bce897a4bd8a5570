import pytest

from linkloom.operators import structure as X

NOTE = """---
title: First
tags: [a, b]
type: skill
---
# Top
:ID: top
:RELATED: #other, #none

A lead line with [[Second]] and ![[image.png]] and [three](third.md#x) and `[[no]]`.

```
# not a heading
[[not a link]]
```

## Sub
:LOGBOOK:
- [2024-01-01] did it
:END:
<< old
- one
- two
"""


def files(spark):
    return spark.createDataFrame([("n/first.md", NOTE), ("n/second.md", "# Second\n:ID: top\n[[#gone]] back to [[first]]"), ("n/third.md", None), ("m/second.md", "")], "path string, content string")


def test_parse():
    s = X.parse_sections(X.frontmatter(NOTE)[1])
    assert [(x["heading_title"], x["heading_level"], x["parent"]) for x in s] == [("Top", 1, -1), ("Sub", 2, 0)]
    assert s[0]["attributes"] == {"ID": "top", "RELATED": "#other, #none"} and s[1]["heading_path"] == "Top / Sub"
    assert s[1]["logbook"] == ["2024-01-01 did it"] and s[0]["links"] == ["Second", "third"]
    assert len(X.parse_sections("")) == 1


def test_notes_and_links(spark):
    n = {r.path: r for r in X.notes(files(spark)).collect()}
    assert n["n/first.md"].title == "First" and n["n/first.md"].tags == ["a", "b"] and n["n/first.md"].doc_type == "skill"
    assert n["n/third.md"].title == "third" and n["n/third.md"].word_count == 0
    s = X.sections(files(spark))
    got = {(r.src, r.dst) for r in X.resolve_links(s, X.notes(files(spark))).collect()}
    assert got == {("n/first.md", "m/second.md"), ("n/first.md", "n/third.md"), ("n/second.md", "n/first.md")}
    assert {(r.src, r.target) for r in X.drawer_links(s).collect()} == {("n/first.md#Top", "other"), ("n/first.md#Top", "none")}


def test_trees_and_checks(spark):
    s = X.sections(files(spark))
    assert {(r.ord, r.trace) for r in X.lineage(s).filter("path = 'n/first.md'").collect()} == {(0, "Top"), (1, "Top > Sub")}
    assert X.thin(s).filter("path = 'n/first.md'").count() == 2  # the parent has words enough, the child no child
    one = X.thin(s, 100).filter("path = 'n/first.md'").collect()
    assert len(one) == 1 and "A lead line" in one[0].section_text and "Sub" in one[0].section_text and "- two" in one[0].section_text
    found = {(r.path, r.issue) for r in X.semantic_issues(s).collect()}
    assert {("n/second.md", "dead_link"), ("n/first.md", "id_collision"), ("n/first.md", "legacy_syntax"), ("n/first.md", "missing_id")} <= found
    assert {r.kind for r in X.block_rows(s).collect()} >= {"paragraph", "code"}


@pytest.mark.parametrize(("what", "how"), [("top", 0), ("Top / Sub", 1), ("top / sub", 2), ("SUB", 3), ("econ", 4)])
def test_address(spark, what, how):
    assert {r.how for r in X.address(X.sections(files(spark)), what).collect()} == {how}
