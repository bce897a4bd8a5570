"""Text structure: Markdown notes to sections, links, drawers, blocks and trees; references and addresses.

A note is one row and one small parse: the parser is a helper over a string, Spark deals the notes out.
What patterns can say (references, dependency lines, symbols) stays in column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from linkloom.shared import shared_table

HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
FENCE = re.compile(r"^\s*(```+|~~~+)")
DRAWER = re.compile(r"^:([A-Za-z][A-Za-z0-9_-]*):\s*(.*)$")
LOGBOOK = re.compile(r"^\s*-\s*\[([^\]]+)\]\s*(.*)$")
WIKI = re.compile(r"(!?)\[\[([^\]|#]+)(?:#([^\]|]*))?(?:\|([^\]]*))?\]\]")
LINK = re.compile(r"(!?)\[([^\]]*)\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)")
RELATION_KEYS = ("RELATED", "DEPENDS_ON", "EXTENDS", "SEE_ALSO")
SECTION = "path string, ord int, heading_title string, heading_path string, heading_level int, line_start int, line_end int, section_text string, attributes map<string,string>, logbook array<string>, links array<string>, parent int, above array<int>, titles array<string>"
#: Notes that are parsed at a time, and characters of parsed rows that are held before they are sent on.
AT_A_TIME, HELD = 64, 1_000_000


def frontmatter(text: str) -> tuple[dict, str]:
    """Scalars and lists of a leading `---` block, and the rest."""
    m = re.match(r"---\s*\n(.*?)\n---\s*(?:\n|\Z)", text, re.S)
    if not m:
        return {}, text
    out, key = {}, None
    for line in m[1].split("\n"):
        if (item := re.match(r"\s*-\s+(.*)", line)) and key:
            out[key] = [*(out[key] if isinstance(out[key], list) else []), item[1].strip("\"' ")]
        elif pair := re.match(r"([A-Za-z_][\w-]*):\s*(.*)", line):
            key, value = pair[1], pair[2].strip()
            out[key] = [v.strip("\"' ") for v in value[1:-1].split(",") if v.strip()] if value.startswith("[") else value.strip("\"'")
    return out, text[m.end():]


def parse_sections(text: str) -> list[dict]:
    """Sections by ATX headings outside fences; always at least one. Leading `:KEY: value` lines, or a
    :PROPERTIES: block, are attributes (upper-case keys, last wins); dated lines of :LOGBOOK: its log."""
    out, stack, fence = [], [], None
    now = {"title": "", "level": 0, "start": 1, "lines": []}
    rows = text.split("\n")
    for n, line in enumerate(rows, 1):
        mark = FENCE.match(line)
        if mark:
            fence = None if fence and line.strip().startswith(fence) else fence or mark[1]
        if not fence and not mark and (h := HEADING.match(line)):
            out.append({**now, "end": n - 1})
            now = {"title": h[2], "level": len(h[1]), "start": n, "lines": []}
        else:
            now["lines"].append(line)
    out.append({**now, "end": len(rows)})
    if out[0]["level"] == 0 and not any(x.strip() for x in out[0]["lines"]) and len(out) > 1:
        out = out[1:]
    made = []
    for i, s in enumerate(out):
        stack = [(j, t, lv) for j, t, lv in stack if lv < s["level"]]
        parent, above = (stack[-1][0] if stack else -1), [j for j, _, _ in stack]
        if s["level"]:
            stack.append((i, s["title"], s["level"]))
        attributes, log, body, block, head = {}, [], [], None, True
        for line in s["lines"]:
            key = line.strip().upper()
            if key in (":PROPERTIES:", ":LOGBOOK:"):
                block = key
            elif key == ":END:" and block:
                block = None
            elif block == ":LOGBOOK:":
                if m := LOGBOOK.match(line):
                    log.append(f"{m[1]} {m[2]}")
            elif (block or head) and (m := DRAWER.match(line.strip())):
                if m[2].strip():
                    attributes[m[1].upper()] = m[2].strip()
            else:
                head = head and not line.strip()
                body.append(line)
        body_text = "\n".join(body)
        made.append({"ord": i, "heading_title": s["title"], "heading_path": " / ".join(t for _, t, _ in stack), "heading_level": s["level"], "line_start": s["start"], "line_end": s["end"], "section_text": body_text, "attributes": attributes, "logbook": log, "links": links_of(body_text), "parent": parent, "above": above, "titles": [t for _, t, _ in stack]})
    return made


def links_of(text: str) -> list[str]:
    """Targets of wiki and Markdown links outside fences and code spans, without embeds and addresses."""
    plain = re.sub(r"`[^`\n]*`", "", re.sub(r"(?ms)^\s*(```|~~~).*?(^\s*\1|\Z)", "", text))
    out = [m[2].strip() for m in WIKI.finditer(plain) if not m[1]]
    out += [m[3].split("#")[0] for m in LINK.finditer(plain) if not m[1] and not re.match(r"[a-z][a-z0-9+.-]*:", m[3], re.I)]
    return sorted({re.sub(r"\.(md|markdown)$", "", x.removeprefix("./")) for x in out if x})


def _parsed(files: DataFrame, schema: str, parse: Callable[[str, str], Iterable[dict]]) -> DataFrame:
    """The rows that `parse` gives for each file (path, content), sent on a few at a time, however many a batch brings."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for start in range(0, b.num_rows, AT_A_TIME):
                piece = b.slice(start, AT_A_TIME)
                for path, content in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    for row in parse(path, content or ""):
                        held.append(row)
                        size += 200 + sum(len(x) for x in row.values() if isinstance(x, str))
                        if size > HELD:
                            yield pa.RecordBatch.from_pylist(held, fields)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, fields)

    return files.select("path", "content").mapInArrow(run, schema)


def sections(files: DataFrame) -> DataFrame:
    """Section rows of Markdown files (path, content); `above` are the sections from the root down to the parent, `titles` those from the root to the section."""
    return _parsed(files, SECTION, lambda path, content: ({"path": path, **s} for s in parse_sections(frontmatter(content)[1])))


NOTE = "path string, stem string, title string, tags array<string>, doc_type string, lead string, word_count long, saliency_base double, decay_rate double"


def notes(files: DataFrame) -> DataFrame:
    """Note rows of Markdown files (path, content): front matter, title, lead, words."""

    def number(value, low: float, high: float, default: float) -> float:
        try:
            return min(high, max(low, float(value)))
        except (TypeError, ValueError):
            return default

    def one(path: str, content: str) -> dict:
        meta, body = frontmatter(content)
        stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
        title = meta.get("title") or next((m[2] for line in body.split("\n") if (m := HEADING.match(line)) and len(m[1]) == 1), stem)
        tags = meta.get("tags") or []
        tags = tags if isinstance(tags, list) else [t for t in re.split(r"[,\s]+", tags) if t]
        lead = next((line.strip() for line in body.split("\n") if line.strip() and not line.lstrip().startswith(("#", ":", "-", ">", "`", "|"))), "")
        return {"path": path, "stem": stem, "title": title, "tags": tags, "doc_type": meta.get("type") or "note", "lead": lead[:180], "word_count": len(body.split()), "saliency_base": number(meta.get("saliency_base"), 1, 10, 5.0), "decay_rate": number(meta.get("decay_rate"), 0, 1, 0.05)}

    return _parsed(files, NOTE, lambda path, content: [one(path, content)])


def resolve_links(section_rows: DataFrame, note_rows: DataFrame) -> DataFrame:
    """(src, dst) between note paths: targets meet notes by path or stem, the first by (path, stem) wins."""
    a = note_rows.select("path", "stem", F.explode(F.array(F.lower("stem"), F.lower(F.regexp_replace("path", r"\.(md|markdown)$", "")))).alias("alias"))
    w = Window.partitionBy("alias").orderBy("path", "stem")
    a = a.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("alias", F.col("path").alias("dst"))
    e = section_rows.select(F.col("path").alias("src"), F.explode("links").alias("link")).withColumn("alias", F.lower("link"))
    return e.join(a, "alias").filter("src <> dst").select("src", "dst").distinct()


def drawer_links(section_rows: DataFrame) -> DataFrame:
    """(src, target, kind) of the relation keys in property drawers; src is `path#heading path`."""
    kinds = F.map_filter("attributes", lambda k, v: k.isin(*RELATION_KEYS))
    rows = section_rows.select(F.concat_ws("#", "path", "heading_path").alias("src"), F.explode(kinds).alias("kind", "value"))
    return rows.select("src", F.explode(F.regexp_extract_all("value", F.lit(r"#([^\s,]+)"), F.lit(1))).alias("target"), "kind").distinct()


def lineage(section_rows: DataFrame, most: int = 6) -> DataFrame:
    """(path, ord, trace): titles from the root to each section, at most `most` levels above it."""
    none = F.size("titles") == 0  # text before the first heading
    near = F.slice("titles", F.greatest(F.size("titles") - most, F.lit(1)), most + 1)
    return section_rows.select("path", "ord", F.when(none, F.col("heading_title")).otherwise(F.array_join(near, " > ")).alias("trace"))


def thin(section_rows: DataFrame, least: int = 12, most: int = 6) -> DataFrame:
    """Sections with `section_text` after folding: a section that has children and fewer than `least` own words
    takes the titles and texts of all below it, in order, and they end as sections of their own. The
    outermost such ancestor takes all; parent pointers are followed up `most` levels, as many as headings have.
    A note's sections meet by one shuffle, and no other."""
    words = F.size(F.filter(F.split("section_text", r"\s+"), lambda t: t != ""))
    note = Window.partitionBy("path")
    has, few = F.collect_set("parent").over(note), F.collect_set(F.when(words < max(1, least), F.col("ord"))).over(note)
    rows = section_rows.withColumn("_small", F.array_intersect(has, few))
    line = F.slice(F.concat("above", F.array("ord")), F.greatest(F.size("above") - most + 1, F.lit(1)), most + 1)
    rows = rows.withColumn("_into", F.get(F.filter(line, lambda x: F.array_contains("_small", x)), F.lit(0)))
    own = [c for c in section_rows.columns if c != "path"]
    piece_of = F.struct("ord", "parent", F.col("heading_title").alias("title"), F.trim("section_text").alias("text"))
    rows = rows.groupBy("path", F.coalesce("_into", "ord").alias("_top")).agg(F.array_sort(F.collect_list(piece_of)).alias("all"), F.max("_into").alias("_into"), F.max_by(F.struct(*own), F.col("ord") == F.coalesce("_into", "ord")).alias("_own"))
    # A title without a text is followed by its first child on the next line, everything else after an empty line.
    piece = lambda x: F.when(x["text"] == "", x["title"]).otherwise(F.concat(x["title"], F.lit("\n"), x["text"]))
    join = lambda acc, x: F.struct(
        F.concat(acc["out"], F.when(acc["out"] == "", "").when((acc["text"] == "") & (acc["ord"] == x["parent"]), "\n").otherwise("\n\n"), F.when(x["ord"] == acc["top"], x["text"]).otherwise(piece(x))).alias("out"),
        x["ord"].alias("ord"), x["text"].alias("text"), acc["top"].alias("top"),
    )
    start = F.struct(F.lit("").alias("out"), F.lit(-1).alias("ord"), F.lit("x").alias("text"), F.col("_top").alias("top"))
    merged = F.when(F.col("_into").isNull(), F.col("_own.section_text")).otherwise(F.aggregate("all", start, join, lambda acc: acc["out"]))
    return rows.select("path", *[merged.alias(c) if c == "section_text" else F.col(f"_own.{c}").alias(c) for c in own]).select(section_rows.columns)


def entity_refs(text: Column) -> Column:
    """Names of `[[Name#type|alias]]` references, in order, once each."""
    names = F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"), F.lit(1))
    return F.array_distinct(F.transform(names, lambda x: F.trim(x)))


def block_rows(section_rows: DataFrame) -> DataFrame:
    """(path, ord, block, kind, text): paragraphs, lists, code, quotes and tables of each section."""
    b = section_rows.select("path", "ord", F.posexplode(F.filter(F.split("section_text", r"\n[ \t]*\n"), lambda t: F.trim(t) != "")).alias("block", "raw"))
    text = F.trim("raw")
    kind = F.when(F.rlike(text, F.lit("^(```|~~~)")), "code").when(F.rlike(text, F.lit(r"^([-*+]|\d+[.)])\s")), "list").when(F.startswith(text, F.lit(">")), "quote").when(F.startswith(text, F.lit("|")), "table").otherwise("paragraph")
    return b.select("path", "ord", "block", kind.alias("kind"), text.alias("text"), F.substring(F.sha2(text, 256), 1, 16).alias("hash"))


def semantic_issues(section_rows: DataFrame) -> DataFrame:
    """(path, ord, issue, detail): dead and deprecated references, missing and repeated ids, old syntax."""
    said = F.regexp_extract_all("section_text", F.lit(r"\[\[#([^\]|]+)"), F.lit(1))
    old_way = F.rlike("section_text", F.lit(r"SEE ALSO|RELATED TO|<<"))
    own = section_rows.select("path", "ord", F.col("attributes")["ID"].alias("id"), F.upper(F.col("attributes")["STATUS"]).alias("status"), "heading_level", said.alias("said"), old_way.alias("old_way"))
    own = shared_table(own, "section-marks")  # the notes are parsed once; no text is written
    ids, refs = own, own.select("path", "ord", F.explode("said").alias("id"))
    known = ids.filter("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.max("status").alias("status"))
    met = refs.join(known, "id", "left")
    row = lambda df, issue, detail: df.select("path", "ord", F.lit(issue).alias("issue"), detail.alias("detail"))
    dead = row(met.filter("n is null"), "dead_link", F.col("id"))
    old = row(met.filter("status = 'DEPRECATED'"), "deprecated_ref", F.col("id"))
    missing = row(ids.filter("id is null and heading_level between 1 and 2"), "missing_id", F.lit(""))
    twice = row(ids.join(known.filter("n > 1").select("id"), "id"), "id_collision", F.col("id"))
    legacy = row(own.filter("old_way"), "legacy_syntax", F.lit(""))
    return dead.union(old).union(missing).union(twice).union(legacy)


def address(section_rows: DataFrame, what: str, least: int = 0) -> DataFrame:
    """(path, ord, score, how) of an address: id 1.0, else exact heading path 1.0, else any case .95, else
    its end .85, else a title part .7 and more; only the best way's rows. Ways before `least` give no rows, but
    where they match, the looser ways than `least` aren't taken."""
    low = what.lower()
    h, t = F.lower("heading_path"), F.lower("heading_title")
    how = F.when(F.col("attributes")["ID"] == what, 0).when(F.col("heading_path") == what, 1).when(h == low, 2).when(F.endswith(h, F.lit("/ " + low)) | (t == low), 3).when(F.contains(t, F.lit(low)), 4)
    score = F.when(how <= 1, 1.0).when(how == 2, 0.95).when(how == 3, 0.85).otherwise(0.7 + F.least(F.lit(0.25), F.lit(0.25 * len(what)) / F.greatest(F.length(t), F.lit(1))))
    hit = section_rows.select("path", "ord", score.alias("score"), how.alias("how")).filter("how is not null")
    best = hit.agg(F.greatest(F.min("how"), F.lit(least)).alias("how")).filter("how is not null")
    return hit.join(F.broadcast(best), "how").select("path", "ord", "score", "how")  # one row
