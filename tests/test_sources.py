import itertools

import pytest
from pyspark.sql import functions as F

from linkloom.functions import similarity as M
from linkloom.operators import knowledge as K
from linkloom.operators import ranking as R
from linkloom.sources import files as S


@pytest.fixture
def tree(tmp_path):
    for path, text in {
        "a/one.md": "# One", ".git/x.md": "no", "a/.hidden/y.md": "no", "node_modules/z.md": "no", "b/two.markdown": "two", "src/lib.rs": "pub fn go() {}\nstruct Thing;\n", "src/app.py": "class App:\n    def run(self):\n        pass\n",
        "Cargo.toml": '[package]\nname = "x"\n[dependencies]\nserde = "1.0"\ntokio = { version = "1.2", features = ["full"] }\n[dev-dependencies]\nrand = "0.8"\n',
        "pyproject.toml": '[project]\nname = "p"\ndependencies = [\n  "numpy>=1.2",\n  "pandas[all]==2",\n]\nother = "x"\n',
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return str(tmp_path)


def test_discovery(spark, tree):
    assert {r.path for r in S.note_files(spark, tree).collect()} == {"a/one.md", "b/two.markdown"}
    assert {r.path for r in S.note_files(spark, tree, include=("node_modules",)).collect()} == {"a/one.md", "b/two.markdown", "node_modules/z.md"}
    assert S.discover(spark, tree, most_bytes=4).count() == 1


def test_code(spark, tree):
    code = S.code_files(spark, tree, "r")
    assert {(r.name, r.kind, r.line) for r in S.code_symbols(code).collect()} == {("go", "function", 1), ("Thing", "struct", 2), ("App", "class", 1), ("run", "function", 2)}
    assert {r.path for r in S.code_files(spark, tree, "r", "src/*.rs").collect()} == {"src/lib.rs"}


def test_dependencies(spark, tree):
    f = S.discover(spark, tree, ("toml",)).select("path", F.col("content").cast("string").alias("contents"))
    assert {(r.name, r.version) for r in S.dependencies(f).collect()} == {("serde", "1.0"), ("tokio", "1.2"), ("rand", "0.8"), ("numpy", ">=1.2"), ("pandas", "==2")}


def test_graph_json(spark, tmp_path):
    p = tmp_path / "kg.json"
    p.write_text('{"entities": [{"id": "1", "name": "A", "confidence": 0.5}, {"id": "2", "name": " "}],\n "relations": [{"source": "A", "target": "B"}, {"source": "A"}]}')
    e, r = S.read_graph(spark, str(p))
    assert e.count() == 1 and r.count() == 1
    S.write_graph(e, r, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/entities")).count() == 1


@pytest.mark.parametrize(("url", "want"), [("HTTP://Host.com:80/A/b/#x", "http://host.com/A/b"), ("https://h:443/?q=1", "https://h/?q=1"), ("note", "note"), ("https://h:8443/", "https://h:8443")])
def test_canonical(spark, url, want):
    assert spark.range(1).select(S.canonical_url(F.lit(url))).first()[0] == want


def test_wash(spark):
    assert spark.range(1).select(S.washed_markdown(F.lit("a  \n\n\n\n<!-- x\ny -->b ![p](http://t/pixel.gif)"))).first()[0] == "a\n\nb"


def test_swap_distance():
    def slow(a, b):
        if not a or not b:
            return len(a) + len(b)
        d = min(slow(a[:-1], b) + 1, slow(a, b[:-1]) + 1, slow(a[:-1], b[:-1]) + (a[-1] != b[-1]))
        return min(d, slow(a[:-2], b[:-2]) + 1) if len(a) > 1 < len(b) and a[-1] == b[-2] and a[-2] == b[-1] else d

    words = ["".join(w) for n in range(4) for w in itertools.product("ab", repeat=n)] + ["abcd", "acbd", "bacd"]
    assert all(M.alignment_distance(a, b) == slow(a, b) for a in words for b in words)


def test_byte_vector(spark):
    v = spark.createDataFrame([("",), ("é" * 100,)], "t string").select(M.byte_vector(F.col("t")).alias("v")).collect()
    assert sum(v[0].v) == 0 and sum(x * x for x in v[1].v) == pytest.approx(1.0) and len(v[1].v) == 128


def test_clusters(spark):
    ids = [str(i) for i in range(6)]
    edges = spark.createDataFrame([(a, b) for a in ids[:4] for b in ids[:4] if a != b] + [("4", "5")], "src string, dst string")
    sal = spark.createDataFrame([(i, 0.9) for i in ids], "id string, saliency double")
    comp = spark.createDataFrame([(i, 0) for i in ids], "id string, component long")
    assert {r.id for r in R.dense_clusters(edges, sal, comp).collect()} == set(ids[:4])


def test_names(spark):
    d = spark.createDataFrame([("1", "Red Bolt", "part", "x", ["a"], 0.5), ("2", "red bolt!", "part", "longer", [], 0.9), ("3", "blue gear", "part", "", [], 0.1)], "id string, name string, entity_type string, description string, aliases array<string>, confidence double")
    pairs = K.duplicate_pairs(d, 0.8).collect()
    assert [(p.left_id, p.right_id, p.similarity) for p in pairs] == [("1", "2", 1.0)]
    groups = spark.createDataFrame([("1", "g"), ("2", "g")], "id string, group_id string")
    got = {r.group_id: (r.name, r.confidence, r.members) for r in K.merge_entities(d, groups).collect()}
    assert got == {"g": ("Red Bolt", 0.9, 2), "3": ("blue gear", 0.1, 1)}
