"""Operators over groups of documents, and the pipeline, against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from linkloom.llm import bitslice, components, decontam, mixing, queries, simhash, simhash_wide

from linkloom.shared import shared_table
from tests.llm.test_text_operators import ODD, docs


def groups(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("keys", [1, 2, 5, 60, 300])
def test_bitslice(keys):
    rng = np.random.default_rng(keys)
    fps = rng.integers(0, 2**63, 12, dtype=np.uint64)[rng.integers(0, 12, 400)]
    for _ in range(3):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))
    key = np.sort(rng.integers(0, keys, 400))
    links = [(i, j) for i in range(400) for j in range(i) if key[i] == key[j] and bin(int(fps[i] ^ fps[j])).count("1") <= 2]
    want = groups(links, range(400))
    assert bitslice.roots(key, fps.reshape(-1, 1), 64, 2).tolist() == [want[i] for i in range(400)]


@pytest.mark.parametrize("rows", [[], [(1, 1)], [(None, 2)], [(1, 2), (2, 3), (9, 8), (3, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 200)]])
def test_components(spark, rows):
    got = {r.node: r.root for r in components.components(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()}
    links = [(a, b) for a, b in rows if a is not None and a != b]
    assert got == {n: r for n, r in groups(links, {x for ab in links for x in ab}).items() if n != r}


@pytest.mark.parametrize("task", [1, 3, 40])
def test_components_of_several_tasks(spark, task):
    rng = np.random.default_rng(task)
    rows = [*rng.integers(0, 90, (70, 2)).tolist(), *[[200, i] for i in range(201, 230)], *[[i, i + 1] for i in range(300, 330)]]
    links = [(a, b) for a, b in rows if a != b]
    want = {n: r for n, r in groups(links, {x for ab in links for x in ab}).items() if n != r}
    got = components.components(spark.createDataFrame(rows, "a long, b long").repartition(3), "a", "b", task=task).collect()
    assert len(got) == len(want) and {r.node: r.root for r in got} == want


def test_components_of_few_links_take_few_tasks(spark):
    """A long chain took a round of stars after the other, each with thousands of tasks where shuffles have many partitions."""
    sc, before = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sc.setJobGroup("few-links", "")
        got = components.components(spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long"), "a", "b")
        assert {(r.node, r.root) for r in got.collect()} == {(i, 0) for i in range(1, 501)}
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("few-links")]
        assert sum(i.numTasks for j in jobs for s in j.stageIds if (i := sc.statusTracker().getStageInfo(s))) < 60
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()] + ODD + ODD
    d = docs(spark, texts)
    fp = [fingerprint(t) for t in texts]
    want = groups([(i, j) for i in range(len(fp)) for j in range(i) if bin(fp[i] ^ fp[j]).count("1") <= 2], range(len(fp)))
    for block in (simhash.BLOCK, 7):
        got = {r.doc_id: r for r in simhash.simhash_components(d, block=block).collect()}
        assert [got[i].fp & (1 << 64) - 1 for i in range(len(fp))] == fp
        assert {i: got[i].component_id for i in got} == want
    assert simhash.simhash_components(docs(spark, [])).count() == 0


def test_spark_hash_is_xxh64(spark):
    text = "two words here"
    got = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest(text.encode(), 42)


def test_wide_simhash_groups(spark):
    rng = np.random.default_rng(3)
    word = lambda: "w%d" % rng.integers(0, 5_000)
    base = [[word() for _ in range(300)] for _ in range(25)]
    texts, of = [], []
    for k, b in enumerate(base):
        texts.append(" ".join(b))
        of.append(k)
        for n in range(k % 4):
            c = list(b)
            for i in rng.integers(0, 300, n + 1):
                c[i] = word()
            texts.append(" ".join(c) if n else " ".join(b))
            of.append(k)
    d = docs(spark, texts)
    got = {r.doc_id: r.component_id for r in simhash_wide.near_duplicate_groups(d).collect()}
    assert got == {i: of.index(of[i]) for i in range(len(texts))}
    kept = simhash_wide.without_near_duplicates(d.unionByName(d.limit(1)))
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [of.index(k) for k in range(25)]


def test_wide_simhash_family(spark):
    """Pairs in the middle of a family that shares every band at a similarity of about 0.55, and one tree of three."""
    rng = np.random.default_rng(11)
    fps = rng.integers(0, 256, (150, simhash_wide.BITS // 8), dtype=np.uint8)
    fps[:, : simhash_wide.BITS // 16] = fps[0, : simhash_wide.BITS // 16]
    for a, b in ((40, 77), (51, 63), (58, 59), (59, 90)):
        fps[b] = fps[a]
        fps[b, -1] ^= 1 + b % 3
    nodes = spark.createDataFrame([(i, bytearray(f.tobytes()), 300, bytearray([i]), i) for i, f in enumerate(fps)], "node long, fp binary, size long, digest binary, first long")
    prints = nodes.select("digest", F.col("first").alias("doc_id"), F.lit(0).cast("long").alias("tag"))
    for block in (simhash_wide.BLOCK, 40):
        found = simhash_wide.similar_links(docs(spark, []), prints, nodes, 0.8, 0.06, "doc_id", "text", 5, block).collect()
        assert groups([(r.a, r.b) for r in found], range(150)) == groups([(40, 77), (51, 63), (58, 59), (59, 90)], range(150))


def test_wide_simhash_short_texts(spark):
    """Short texts are grouped by their shingle sets, as brute force does."""
    rng = np.random.default_rng(5)
    texts = [f"word{i}" for i in range(500)] + [" ".join(f"s{i}x{n}" for n in range(8 + k)) for i in range(30) for k in range(2)]
    for n in (12, 30, 64, 68, 75, 82):
        for f in range(6):
            base = [f"v{n}x{f}x{i}" for i in range(n)]
            for k in range(4):
                own = list(base)
                own[-int(rng.integers(1, 4))] = f"o{k}"
                texts.append(" ".join(own + [f"e{i}" for i in range(k)]))
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if (k := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - k)]
    assert len(alike) > 60
    for block in (simhash_wide.BLOCK, 3):
        got = {r.doc_id: r.component_id for r in simhash_wide.near_duplicate_groups(docs(spark, texts), block=block).collect()}
        assert got == groups(alike, range(len(texts)))


def test_wide_simhash_edges(spark):
    d = docs(spark, [*ODD, *ODD]).unionByName(docs(spark, ["lost"] * 2).withColumn("doc_id", F.lit(None).cast("long")))
    kept = simhash_wide.without_near_duplicates(d).collect()
    assert sum(r.doc_id is None for r in kept) == 2
    assert len([r for r in kept if r.doc_id is not None]) == len({" ".join((t or "").split()) for t in ODD})
    assert simhash_wide.without_near_duplicates(docs(spark, [])).count() == 0


def test_wide_simhash_repeated_ids(spark):
    """One id with three texts is three documents; rows that repeat id and text are one; columns of any name stay."""
    words = lambda k: " ".join(f"{k}w{i}" for i in range(90))
    rows = [(7, words("a")), (7, words("b")), (7, words("a")), (7, words("c") + " tail"), (8, words("c")), (9, words("b").upper())]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(n) for n in ("id", "tag", "key", "digest", "node", "_once", "text_hash")})
    for _ in range(2):
        kept = simhash_wide.without_near_duplicates(d)
        assert kept.columns == d.columns and {r.tag for r in kept.collect()} == {"tag"}
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(7, words("a")), (7, words("b")), (7, words("c") + " tail")])


def test_wide_simhash_recall(spark):
    """Against all pairs of the larger table: pairs of 0.8 and more share a group, and few others do."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: set(simhash.shingle_hashes((r.text or "").encode(), 5).tolist()) for r in d.collect()}
    having: dict[int, list[int]] = {}
    for i, own in sets.items():
        for h in own:
            having.setdefault(h, []).append(i)
    both: dict[tuple[int, int], int] = {}
    for ids in having.values():
        for x, i in enumerate(ids):
            for j in ids[:x]:
                both[i, j] = both.get((i, j), 0) + 1
    pairs = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in both.items()}
    got = {r.doc_id: r.component_id for r in simhash_wide.near_duplicate_groups(d).collect()}
    alike = [p for p, n in pairs.items() if n >= 0.8]
    assert len(alike) > 50
    assert sum(got[i] == got[j] for i, j in alike) >= 0.99 * len(alike)
    want = groups(alike, sets)
    assert sum(got[i] == got[j] for (i, j), n in pairs.items() if n < 0.8 and want[i] != want[j]) == 0


def test_decontamination(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    planted = items.orderBy("item_id").first()
    texts += [None, "", "x", "before " * 300 + planted.text.upper() + " after" * 300, planted.text[: len(planted.text) // 3]]
    norm = lambda t: b" " + b" ".join(decontam.words_of(t)) + b" "
    want = {(i, r.item_id) for r in items.collect() for i, t in enumerate(texts) if norm(r.text) in norm(t)}
    assert (len(texts) - 2, planted.item_id) in want
    d = docs(spark, texts)
    for words in (decontam.SHARD_WORDS, 2_000):
        got = decontam.contaminated(d, items, shard_words=words).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        assert all(r.score == pytest.approx(1.0) for r in got)
    clean = decontam.without_contaminated(d, items)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {i for i, _ in want}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(d, none).count() == 0 and decontam.without_contaminated(d, none).count() == len(texts)


def bm25_passages(items, texts):
    """score of every item against every passage of its length of every text, by plain loops: {(text, item): {word: score}}."""
    words = {i: decontam.words_of(t) for i, t in items.items()}
    words = {i: w for i, w in words.items() if w}
    df = Counter(w for own in words.values() for w in set(own))
    mean = sum(map(len, words.values())) / len(words)
    weight = {}
    for i, own in words.items():
        tf = Counter(own)
        raw = {w: math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w, n in tf.items()}
        weight[i] = {w: x / sum(raw.values()) for w, x in raw.items()}
    out = {}
    for t, text in enumerate(texts):
        own = decontam.words_of(text)
        for i, w in weight.items():
            size = 128
            while size < 2 * len(words[i]):
                size *= 2
            out[t, i] = {a: sum(w[x] for x in set(own[a : a + size]) if x in w) for a in range(0, max(1, len(own)), size // 2)}
    return out


def test_wand_against_plain_bm25(spark, sf):
    """Every (document, item) with a passage at the threshold, whatever the threshold, overlap and shards."""
    items = {r.item_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()}
    items |= {1_000: "long item " + " ".join(items.values()), 1_001: "  ", 1_002: next(iter(items.values()))}
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    texts += [" ".join(list(items.values())[k].split()[: 6 + 4 * k] + texts[k].split()) for k in range(8)] + [items[1_000], None, ""]
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = bm25_passages(items, texts)
    for threshold, words in ((0.15, decontam.SHARD_WORDS), (0.3, 2_000), (0.3, decontam.SHARD_WORDS), (0.6, 2_000)):
        held = {k: {a: v for a, v in p.items() if v >= threshold - 1e-9} for k, p in want.items()}
        got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs(spark, texts), table, threshold=threshold, overlap=0.0, shard_words=words).collect()}
        assert set(got) == {k for k, p in held.items() if p}
        assert all(r.score == pytest.approx(held[k][r.word_at]) for k, r in got.items())


def test_wand_blocks(monkeypatch):
    """Candidates are those of a plain sum, whatever the size of blocks."""
    rng = np.random.default_rng(8)
    words = [b"w%d" % int(x) for x in rng.zipf(1.3, 40_000) % 900]
    items = [(i, words[60 * i : 60 * i + int(rng.integers(3, 60))], 1) for i in range(600)]
    df = Counter(w for _, own, _ in items for w in set(own))
    for block in (1, 2, 7, 64, 1_000):
        monkeypatch.setattr(decontam, "block_items", lambda n: block)  # noqa: B023
        index = decontam.Index.build(items, df, len(items), 30.0)
        for _ in range(30):
            terms = np.unique(rng.integers(0, len(index.number), int(rng.integers(1, 120))))
            score = np.array([w[np.isin(t, terms)].sum() for t, w in zip(index.terms, index.weights)])
            for threshold in (0.1, 0.3, 0.6):
                assert index.candidates(terms, threshold) == np.flatnonzero(score >= threshold).tolist()
    assert decontam.Index.build([], {}, 0, 1.0).matches("some words", 0.5, 0.5) == []


def test_shards(spark):
    rng = np.random.default_rng(1)
    rows = [(k % 40, [b"w%d" % i for i in range(n)]) for k, n in enumerate([*rng.integers(1, 60, 200), 900, 5_000])]
    d = spark.createDataFrame([(i, list(map(bytearray, w))) for i, w in rows], "item_id long, words array<binary>")
    got = []
    for low, high, placed in decontam.shards_of(d, 1_000):
        sizes = [r.n for r in placed.filter(F.col("piece").between(low, high)).select(F.size("words").alias("n")).collect()]
        assert sizes and (sum(sizes) <= 1_000 or len(sizes) == 1)
        got += sizes
    assert sorted(got) == sorted(len(w) for _, w in rows)


def test_answer_column(spark):
    items = spark.createDataFrame([(1, "which river runs through the old town near the hills", "the blue one by far")], "item_id long, text string, answer string")
    q, a = items.first().text, items.first().answer
    d = docs(spark, [q, f"{q} {a}", a])
    assert [r.doc_id for r in decontam.contaminated(d, items, answer_col="answer").collect()] == [1]


def test_sainte_lague(spark):
    rng = np.random.default_rng(2)
    for seats in (0, 1, 3, 17, 500):
        votes = [float(v) for v in rng.integers(0, 1_000, 9)]
        d = spark.createDataFrame([(i, v, seats) for i, v in enumerate(votes)], "p int, v double, n long")
        got = {r.p: r.won for r in mixing.sainte_lague(d, ["p"], [], "v", "n", ["p"]).collect()}
        order = sorted(((-v / (2 * k - 1), i) for i, v in enumerate(votes) if v for k in range(1, seats + 1)))[:seats]
        assert got == {i: sum(j == i for _, j in order) for i in range(9)}


def test_mixing(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    got = queries.mixing.mix_sources(d).toPandas()
    again = queries.mixing.mix_sources(d.repartition(7)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert (got.taken <= 2 * got["size"]).all() and len(got) == d.count()
    by = got.groupby(got.source.fillna("~")).agg(size=("size", "sum"), whole=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.whole).all()
    assert by.target.sum() == pytest.approx(1.5 * by["size"].sum())
    assert (by.target <= 2 * by["size"] + 1e-6).all()
    assert (abs(by.taken - by.target) <= 0.03 * by.target + 64).all()
    weights = dict(zip(by.index, [3, 1, 2] * 10))
    size, target = by["size"].to_dict(), dict.fromkeys(by.index, 0.0)
    left, open_ = 1.5 * sum(size.values()), set(size)
    while left > 1e-6 and open_:
        w = sum(weights[s] for s in open_)
        for s in open_:
            target[s] += left * weights[s] / w
        left = sum(max(0.0, target[s] - 2 * size[s]) for s in open_)
        full = {s for s in open_ if target[s] >= 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in full}
        open_ -= full
    assert target == pytest.approx(by.target.to_dict())


def test_mixing_edges(spark):
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    got = mixing.mix_sources(docs(spark, [None, "", "  "], source=None)).toPandas()
    assert got.taken.tolist() == [0, 0, 0] and got.target.tolist() == [0.0] * 3
    got = mixing.mix_sources(docs(spark, ODD)).toPandas()
    assert len(got) == len(ODD) and (got.taken <= 2 * got["size"]).all()


def test_pipeline(spark, sf):
    import corpus_pipeline as c

    d, documents = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/documents.parquet").columns
    kept = {r.doc_id for r in d.collect()}
    for name, stage in c.STAGES[:-1]:
        d = shared_table(stage(spark, d, sf), name)
        assert d.columns == documents
        now = {r.doc_id for r in d.collect()}
        assert now <= kept and len(now) > 0.5 * len(kept)
        kept = now
    last = c.STAGES[-1][1](spark, d, sf)
    assert {r.doc_id for r in last.collect()} <= kept
    assert set(c.run(spark, sf).columns) == set(last.columns)


def test_pipeline_edges(spark, sf):
    """Empty tables, null and odd texts, rows that repeat, and columns that clash."""
    import corpus_pipeline as c

    clean = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("quality = 1").limit(20).collect()]
    for texts in ([], [None, "", "x"], [*ODD, *ODD, *clean, *clean]):
        d = docs(spark, texts).withColumns({n: F.lit("c") for n in ("tag", "key", "_once", "id", "words", "place", "node")})
        names, n = d.columns, len(texts)
        for name, stage in c.STAGES[:-1]:
            d = shared_table(stage(spark, d, sf), name)
            assert d.columns == names and d.count() <= n
            n = d.count()
        last = c.STAGES[-1][1](spark, d, sf)
        assert last.count() <= n and last.filter("taken < 0").count() == 0
        if clean and len(texts) > 3:
            kept = {r.text for r in d.collect()}
            assert len(kept & set(clean)) >= 0.5 * len(set(clean))


def test_null_ids(spark, sf):
    """A row without an id is a row like any other, and its result has no id."""
    from linkloom.llm import html_text, langid, lm_score, quality_classifier, quality_rules, secret_scan

    texts = ["some words here and there " * 10] * 3 + ["other words of another kind"]
    d = docs(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") != 1, F.col("doc_id")))
    labels = spark.createDataFrame([(0, 1), (3, 0)], "doc_id long, quality int")
    for got in (
        mixing.mix_sources(d), secret_scan.digest(secret_scan.scan_secrets(d)), quality_classifier.classify(d, labels), lm_score.score_documents(d), langid.identify(d), quality_rules.judge(d), simhash.simhash_components(d),
    ):
        rows = got.collect()
        assert len(rows) == 4 and sum(r.doc_id is None for r in rows) == 1
    found = {r.doc_id: r.component_id for r in simhash.simhash_components(d).collect()}
    assert found == {0: 0, 2: 0, None: 0, 3: 3}
    assert html_text.extract(spark.createDataFrame([(None, None, "<p>x</p>")], "page_id long, url string, html string")).first().text == "x"
    items = spark.createDataFrame([(None, texts[3] * 3), (5, texts[3])], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(d, items).collect()] == [(3, 5)]
