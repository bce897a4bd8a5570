"""The engine's typed tables, as views over stored tables: notes, sections, chunks, symbols, links, ...

Nothing is read here; every function returns a lazy frame, so filters and column choice reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the ASCII folding of corpora touches (full Unicode lower case is `F.lower`).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_ascii(c):
    """Lower case for A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def epoch(ts):
    """Whole seconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, stem, path, title, tags, lead, doc_type, word_count, search_text, created_ts, modified_ts."""
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    tokens = F.filter(F.split(text, r"[ \t\n\r]+"), lambda t: t != "")
    stem = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        stem.alias("stem"),
        F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), stem, F.lit(".md")).alias("path"),
        F.array_join(F.slice(tokens, 1, 6), " ").alias("title"),
        F.array(F.coalesce("lang", F.lit("und")), F.coalesce("source", F.lit("none"))).alias("tags"),
        F.substring(F.trim(text), 1, 180).alias("lead"),
        F.when(F.col("doc_id") % 7 == 0, "skill").otherwise("note").alias("doc_type"),
        F.size(tokens).cast("long").alias("word_count"),
        text.alias("search_text"),
        F.when(F.col("doc_id") % 11 != 0, F.lit(1_600_000_000) + F.col("doc_id") * 3600).alias("created_ts"),
        (F.lit(1_650_000_000) + F.col("doc_id") * 60).alias("modified_ts"),
        F.col("doc_id").alias("doc_no"),
    )


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, ord, heading_title, heading_path, heading_level, section_text, words: a section a line."""
    line = docs.select(F.col("id").alias("doc_id"), F.posexplode(F.split("search_text", "\n")).alias("ord", "section_text"))
    tokens = F.filter(F.split("section_text", r"[ \t\r]+"), lambda t: t != "")
    title = F.array_join(F.slice(tokens, 1, 4), " ")
    level = (1 + F.col("ord") % 6).cast("int")
    return line.select(
        "doc_id",
        "ord",
        title.alias("heading_title"),
        F.when(level == 1, title).otherwise(F.concat(F.lit("Part "), (F.col("ord") / 6).cast("int").cast("string"), F.lit(" / "), title)).alias("heading_path"),
        level.alias("heading_level"),
        "section_text",
        F.size(tokens).cast("long").alias("words"),
    )


def content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id, id, path, language, line_number, line_text and folded copies: a row a non-blank line."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("source").alias("repo_id"), F.concat(F.lit("src/doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("lang").alias("language"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    line = F.trim("raw")
    rows = rows.select("repo_id", "path", "language", (F.col("pos") + 1).cast("long").alias("line_number"), line.alias("line_text")).filter("line_text <> ''")
    return rows.select("repo_id", F.concat_ws(":", "path", "line_number").alias("id"), "path", fold_ascii(F.col("path")).alias("path_folded"), "language", "line_number", "line_text", fold_ascii(F.col("line_text")).alias("line_text_folded"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, name_folded, language, kind, signature, owner_title, path, line_start."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("sym:"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("name"),
        fold_ascii(F.col("p_name")).alias("name_folded"),
        F.when(F.col("p_partkey") % 2 == 0, "rust").otherwise("python").alias("language"),
        F.when(F.col("p_size") > 25, "function").otherwise("struct").alias("kind"),
        F.col("p_type").alias("signature"),
        F.col("p_brand").alias("owner_title"),
        F.concat(F.lit("lib/"), F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".rs")).alias("path"),
        F.col("p_size").cast("long").alias("line_start"),
    )


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, source_path, attachment_path, attachment_name, attachment_ext, kind of pages' links."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1))).alias("target"))
    name = F.element_at(F.split("target", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    rows = p.select("page_id", F.col("url").alias("source_path"), F.col("target").alias("attachment_path"), name.alias("attachment_name"), ext.alias("attachment_ext"))
    return rows.withColumn("kind", attachment_kind(F.col("attachment_ext"))).distinct()


#: File endings of each attachment kind.
KINDS = {
    "image": ("png", "jpg", "jpeg", "gif", "webp", "bmp", "svg", "tif", "tiff", "avif"),
    "pdf": ("pdf",),
    "gpg": ("gpg", "pgp", "asc"),
    "document": ("doc", "docx", "ppt", "pptx", "xls", "xlsx", "odt", "md", "txt"),
    "archive": ("zip", "tar", "gz", "tgz", "bz2", "xz", "7z", "rar"),
    "audio": ("mp3", "wav", "flac", "ogg", "m4a", "aac"),
    "video": ("mp4", "mov", "avi", "mkv", "webm"),
}


def attachment_kind(ext):
    out = F.lit("other")
    for kind, ends in KINDS.items():
        out = F.when(F.lower(ext).isin(*ends), kind).otherwise(out)
    return out


def web_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: a directed graph over parts ('p:') and suppliers ('s:'), dense enough to walk."""
    li = table(spark, sf_dir, "lineitem")
    p, s = F.concat(F.lit("p:"), F.col("l_partkey").cast("string")), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string"))
    return li.select(p.alias("src"), s.alias("dst")).distinct()


def note_links(docs: DataFrame, notes_total: int) -> DataFrame:
    """src, dst: the ring-and-hub graph over note numbers: +1, +97 and a hub a note."""
    hubs = max(1, notes_total // 64)
    no = F.col("doc_no")
    ends = F.array(*[x.cast("string") for x in ((no + 1) % notes_total, (no + 97) % notes_total, no % hubs)])
    e = docs.select(no.cast("string").alias("src"), F.explode(ends).alias("dst"))
    return e.filter("src <> dst").distinct()


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, entity_type, description, aliases, confidence over suppliers, nations and regions."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("entity_type"), F.concat(F.lit("supplier with balance "), F.floor("s_acctbal").cast("string")).alias("description"), F.array(F.concat(F.lit("sup "), F.col("s_suppkey").cast("string"))).alias("aliases"), F.round(F.abs(F.col("s_acctbal")) / 10000, 4).alias("confidence"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.lit("nation").alias("entity_type"), F.lit("a nation").alias("description"), F.array(F.lower("n_name")).alias("aliases"), F.lit(1.0).alias("confidence"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.lit("region").alias("entity_type"), F.lit("a region").alias("description"), F.array(F.lower("r_name")).alias("aliases"), F.lit(1.0).alias("confidence"))
    return s.unionByName(n).unionByName(r)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target (entity names), relation_type."""
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    nr = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"), F.lit("PART_OF").alias("relation_type"))
    sn = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("source"), F.col("n_name").alias("target"), F.lit("LOCATED_IN").alias("relation_type"))
    return nr.unionByName(sn)
