"""File sources: note trees, code repositories, manifests, knowledge-graph JSON, web addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.corpora import glob_pattern

#: Endings of notes and of code, folders never walked, and the largest file read.
NOTE_ENDS = ("md", "markdown")
LANGUAGES = {"rs": "rust", "py": "python", "jl": "julia", "ts": "typescript", "tsx": "typescript", "js": "javascript", "go": "go", "java": "java", "scala": "scala", "c": "c", "h": "c", "cpp": "cpp", "mo": "modelica", "sh": "shell", "toml": "toml", "md": "markdown"}
SKIP_DIRS = ("node_modules", "target", "dist", "build", "__pycache__", "venv")
MOST_BYTES = 1 << 20


def discover(spark: SparkSession, root: str, ends: tuple[str, ...] | None = None, include: tuple[str, ...] = (), exclude: tuple[str, ...] = SKIP_DIRS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path (below root), size, mtime and content (binary) of the files of a tree: hidden and excluded
    folders are left out unless a folder is explicitly included. Sizes and names are judged before
    contents are read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = F.regexp_replace("path", "^file:/+", "/")
    base = root.removeprefix("file:").rstrip("/") + "/"
    f = f.filter(F.col("length") <= most_bytes).withColumn("path", F.when(F.startswith(at, F.lit(base)), F.substring(at, len(base) + 1, 1 << 20)).otherwise(at))
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    asked = F.lit(False)
    for d in include:
        asked |= F.startswith("path", F.lit(d.strip("/") + "/"))
    hidden = F.exists(folders, lambda d: F.startswith(d, F.lit(".")) | d.isin(*exclude)) | F.startswith(F.element_at(parts, -1), F.lit("."))
    keep = asked | ~hidden
    if ends:
        keep &= F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*ends)
    return f.filter(keep).select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), "content")


def note_files(spark: SparkSession, root: str, **filters) -> DataFrame:
    """path and content (text) of a Markdown tree."""
    return discover(spark, root, NOTE_ENDS, **filters).select("path", F.col("content").cast("string").alias("content"))


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for end, name in LANGUAGES.items():
        out = F.when(ext == end, name).otherwise(out)
    return out


def code_files(spark: SparkSession, root: str, repo: str, scope: str | None = None) -> DataFrame:
    """repo_id, path, language, contents of supported code files."""
    f = discover(spark, root, tuple(LANGUAGES)).withColumn("language", language(F.col("path")))
    if scope:
        f = f.filter(F.rlike("path", F.lit(glob_pattern(scope))))
    return f.select(F.lit(repo).alias("repo_id"), "path", "language", F.col("content").cast("string").alias("contents"))


#: Definition lines of each language.
DEFINITIONS = {
    "rust": ((r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+([A-Za-z_]\w*)", "function"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+([A-Za-z_]\w*)", "struct"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+([A-Za-z_]\w*)", "enum"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+([A-Za-z_]\w*)", "trait"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+([A-Za-z_]\w*)", "module")),
    "python": ((r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)", "function"), (r"^\s*class\s+([A-Za-z_]\w*)", "class")),
}


def code_symbols(files: DataFrame) -> DataFrame:
    """path, language, name, kind, line, signature of the definitions in (path, language, contents)."""
    line = files.select("path", "language", F.posexplode(F.split("contents", "\n")).alias("pos", "text"))
    out = None
    for lang, rules in DEFINITIONS.items():
        for pattern, kind in rules:
            name = F.regexp_extract("text", pattern, 1)
            hit = line.filter(F.col("language") == lang).select("path", "language", name.alias("name"), F.lit(kind).alias("kind"), (F.col("pos") + 1).cast("long").alias("line"), F.trim("text").alias("signature")).filter("name <> ''")
            out = hit if out is None else out.unionByName(hit)
    return out


def dependencies(files: DataFrame) -> DataFrame:
    """path, name, version of Cargo.toml and pyproject.toml dependencies in (path, contents)."""
    line = files.select("path", F.posexplode(F.split("contents", "\n")).alias("pos", "text"))
    head = F.regexp_extract("text", r"^\s*\[+([^\]]+)\]+\s*$", 1)
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = line.withColumn("table", F.last(F.when(head != "", head), ignorenulls=True).over(w))
    cargo = line.filter(F.endswith("path", F.lit("Cargo.toml")) & F.rlike("table", F.lit(r"(^|\.)(dev-|build-)?dependencies$")))
    name, value = F.regexp_extract("text", r"^\s*([A-Za-z0-9_-]+)\s*=\s*(.+)$", 1), F.regexp_extract("text", r"^\s*([A-Za-z0-9_-]+)\s*=\s*(.+)$", 2)
    version = F.coalesce(F.nullif(F.regexp_extract(value, r'^"([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract(value, r'version\s*=\s*"([^"]*)"', 1), F.lit("")))
    rust = cargo.select("path", name.alias("name"), version.alias("version")).filter("name <> ''")
    py = line.filter(F.endswith("path", F.lit("pyproject.toml")))
    found = F.explode(F.regexp_extract_all("text", F.lit(r'"([A-Za-z0-9][A-Za-z0-9._-]*(?:\[[^\]]*\])?\s*(?:[=<>~!][^"]*)?)"'), F.lit(1)))
    array = py.withColumn("inside", F.last(F.when(F.rlike("text", F.lit(r"^\s*dependencies\s*=\s*\[")), 1).when(F.rlike("text", F.lit(r"^\s*[A-Za-z_-]+\s*=")), 0), ignorenulls=True).over(w))
    spec = array.filter("table = 'project' and inside = 1").select("path", found.alias("spec"))
    python = spec.select("path", F.regexp_extract("spec", r"^([A-Za-z0-9._-]+)", 1).alias("name"), F.nullif(F.regexp_extract("spec", r"([=<>~!].*)$", 1), F.lit("")).alias("version"))
    return rust.unionByName(python)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of a knowledge-graph JSON document; rows without a name or an end are dropped."""
    entity = "array<struct<id:string,name:string,entity_type:string,description:string,source:string,aliases:array<string>,confidence:double>>"
    relation = "array<struct<id:string,source:string,target:string,relation_type:string,description:string,confidence:double>>"
    d = spark.read.schema(f"entities {entity}, relations {relation}").option("multiLine", True).json(path)
    e = d.select(F.explode("entities").alias("e")).select("e.*").filter("name is not null and trim(name) <> ''")
    r = d.select(F.explode("relations").alias("r")).select("r.*").filter("source is not null and target is not null")
    return e, r


def write_graph(entities: DataFrame, relations: DataFrame, path: str) -> None:
    """A folder with `entities` and `relations` as JSON lines, written by the tasks that hold them."""
    entities.write.mode("overwrite").json(f"{path}/entities")
    relations.write.mode("overwrite").json(f"{path}/relations")


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no default port, no trailing slash."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    head, rest = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)), F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$", 1)
    head = F.regexp_replace(F.regexp_replace(head, "^(http://[^:]*):80$", "$1"), "^(https://[^:]*):443$", "$1")
    return F.when(head != "", F.concat(head, F.regexp_replace(rest, "/+$", ""))).otherwise(u)


def washed_markdown(text: Column) -> Column:
    """Markdown without comments, tracking images, repeated blank lines and trailing spaces."""
    t = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"!\[[^\]]*\]\((?:data:|https?://[^)]*(?:pixel|track|beacon))[^)]*\)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+(?=\n|$)", ""), r"\n{3,}", "\n\n"))
