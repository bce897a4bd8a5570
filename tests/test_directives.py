import pytest

from linkloom.plans.directives import Options, infer_strategy, intent, parse, parse_code_query, parse_import_query, sort_term, tag_expression, terms, timestamp
from linkloom.plans.search import budget, confidence, retrieval_mode


@pytest.mark.parametrize(
    ("line", "query", "want"),
    [
        ("hello world", "hello world", {}),
        ("tag:a tag:b x", "x", {"tags_all": ("a", "b")}),
        ("tag:a or b x", "x", {"tags_any": ("a", "b")}),
        ("tag:(a&b|-c)", "", {"tags_any": ("a", "b"), "tags_not": ("c",)}),
        ("-tag:a", "", {"tags_not": ("a",)}),
        ("orphan !tagless", "", {"orphan": True, "tagless": False}),
        ("sort:path/desc,title", "", {"sort": (("path", "desc"), ("title", "asc"))}),
        ("include:src/a -include:src/b", "", {"include": ("src/a",), "exclude": ("src/b",)}),
        ("created>=2024-01-02 created<2024/01/03", "", {"created_after": 1704153600, "created_before": 1704240000}),
        ("modified_after:17 updated_before:18", "", {"modified_after": 17, "modified_before": 18}),
        ("related:seed~3 ppr_alpha:.5 ppr_max_iter:7", "", {"related": ("seed",), "related_distance": 3, "ppr_alpha": 0.5, "ppr_max_iter": 7}),
        ("max_heading_level:2 per_doc_section_cap:4 scope:mixed", "", {"max_heading_level": 2, "per_doc_section_cap": 4, "scope": "mixed"}),
        ("what:ever http://x", "what:ever http://x", {}),
        ('q:"two words" rest', "two words", {}),
    ],
)
def test_parse(line, query, want):
    p = parse(line)
    assert p.query == query
    for k, v in want.items():
        assert getattr(p.options, k) == v


def test_links_and_limits():
    o = parse("to:a,b link_to_recursive:true link_to_max_distance:3 -from:c limit:7 id:x")
    assert o.options.link_to.seeds == ("a", "b") and o.options.link_to.recursive and o.options.link_to.max_distance == 3
    assert o.options.linked_by.negate and o.limit == 7 and o.direct_id == "x"


def test_base_wins():
    assert parse("scope:doc case:true", Options(scope="section")).options.scope == "section"
    assert parse("match:re x", Options(strategy="exact", strategy_set=True)).options.strategy == "exact"


@pytest.mark.parametrize(("rest", "want"), [("^a.*b$", "re"), ("notes/one", "exact"), ("my-slug", "exact"), ("readme.md", "exact"), ("plain", None), ("two words", None), ("", None)])
def test_strategy(rest, want):
    assert infer_strategy(rest) == want


@pytest.mark.parametrize("bad", ["max_heading_level:9", "ppr_alpha:2", "ppr_tol:0", "per_doc_section_cap:0"])
def test_validation(bad):
    with pytest.raises(ValueError):
        parse(bad)


def test_pieces():
    assert terms('a "b c" d:(e f) g') == ["a", "b c", "d:(e f)", "g"]
    assert tag_expression("a,b") == (["a", "b"], [], [])
    assert sort_term("created") == ("created", "desc") and sort_term("title_desc") == ("title", "desc") and sort_term("nope") is None
    assert timestamp("1970-01-02") == 86400 and timestamp("1970-01-01T00:00:05Z") == 5 and timestamp("x") is None
    assert parse_code_query("lang:Rust kind:symbol do it") == ("do it", ["rust"], ["symbol"])
    assert parse_import_query("package=a;module=*") == {"package": "a"}
    assert intent("please find the notes about graph ranks")["action"] == "find"


def test_policy():
    assert confidence(0, 0.0)[1] == "none" and confidence(5, 1.0)[1] == "high"
    assert retrieval_mode("hybrid", 3, 0.5) == "graph_only" and retrieval_mode("hybrid", 1, 0.5) == "vector_only" and retrieval_mode("vector_only", 9, 1.0) == "vector_only"
    assert budget(10, 0.55) == 16 and budget(10, 9.0) == 20
