"""Secret scans over an incremental blob ledger.

A blob is a text named by its SHA-256. The ledger holds, for each (blob, rule version) pair that was
ever scanned, the findings. `scan_unseen` groups the paths' texts by name, drops pairs that the ledger
has, and runs the rules once a blob; `findings_by_path` joins the ledger back to every path.

A rule's matches come from the pieces that `split` leaves between them: piece and match lengths, summed
in order, give each match's start and end in code points. A rule takes a text apart only after a plain
search has found a match in it. `redact` shuffles only texts with a match; the others pass in the scan.

Defined results: null text counts as empty; empty texts and tables give no findings (the digest of an
empty list is SHA-256 of the empty string); copies and repeated rows share one blob and each get its
findings; other columns are ignored. A blob that a third of all paths share is scanned once: texts are
reduced to one a blob before the shuffle, and its findings are spread over the salts its paths use.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import free_names
from linkloom.shared import salt_mask, salt_of, salts_in

EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


@dataclass(frozen=True)
class Rule:
    """`pattern` is searched leftmost without overlap; matches whose `group` is shorter than
    `least` are dropped afterwards. Texts without `hint`, where given, can't match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    hint: str = ""


#: The three base rules, in their order. A maximal run of 16+ (18+) characters is what a run of any
#: length leaves after short ones are dropped, so those two carry the length in the pattern.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", hint="AKIA"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: What the ledger adds to them.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
)
RULES = BASE + MORE
RULE_VERSION = "v1"


def path_blobs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, blob name, salt and text of each path (a path is a row: one version of one document)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text")).withColumn("salt", salt_of("doc_id"))


def _found(rule: Rule, text: Column) -> Column:
    """Whether the rule's pattern matches anywhere in the text."""
    found = F.regexp_like(text, F.lit(rule.pattern))
    return F.contains(text, F.lit(rule.hint)) & found if rule.hint else found


def _matches(rule: Rule, nth: int) -> Column:
    """Array of (kind number, match number, length before the match, length, length of its group)."""
    size = lambda a: F.transform(a, lambda x: F.length(x))
    found = F.arrays_zip(
        size(F.split("text", rule.pattern, -1)).alias("gap"),
        size(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))).alias("n"),
        size(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))).alias("g"),
    )
    rows = F.transform(found, lambda x, i: F.struct(F.lit(nth).alias("rule"), i.alias("i"), x["gap"].alias("gap"), x["n"].alias("n"), x["g"].alias("g")))
    rows = F.filter(rows, lambda x: x["n"].isNotNull())
    return F.when(_found(rule, F.col("text")), rows)


def scan_unseen(paths: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """New ledger rows: blob, rule_version, the salts of its paths, and its spans by start and rule.
    `ledger` (blob, rule_version, ...) names the pairs that need no scan; blobs without a span count
    as scanned and get an empty array."""
    blobs = paths.groupBy("blob").agg(F.first("text").alias("text"), salt_mask(F.col("salt")).alias("mask"))
    if ledger is not None:
        blobs = blobs.join(ledger.filter(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    none = F.array(F.lit(None).cast("struct<rule:int,i:int,gap:int,n:int,g:int>"))
    hits = F.concat(*[F.coalesce(_matches(r, k), F.slice(none, 1, 0)) for k, r in enumerate(rules)])
    rows = blobs.select("blob", "mask", F.explode_outer(hits).alias("hit")).select("blob", "mask", "hit.*")
    line = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(line))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("rule") + 1)
    span = F.when(F.col("g") >= least, F.struct((F.col("end") - F.col("n")).alias("start"), "rule", "end"))
    return rows.groupBy("blob").agg(F.bit_or("mask").alias("mask"), F.lit(version).alias("rule_version"), F.sort_array(F.collect_list(span)).alias("spans"))


def spans_of(paths: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows of every blob of `paths`: new ones, and for blobs that `ledger` has its spans."""
    fresh = scan_unseen(paths, ledger, rules, version)
    if ledger is None:
        return fresh
    known = ledger.filter(F.col("rule_version") == version).select("blob", "rule_version", "spans").dropDuplicates(["blob"])
    seen = paths.groupBy("blob").agg(salt_mask(F.col("salt")).alias("mask")).join(known, "blob")
    return fresh.unionByName(seen.select(*fresh.columns))


def findings_by_path(paths: DataFrame, ledger: DataFrame) -> DataFrame:
    """doc_id and spans of every path, from ledger rows of one rule version."""
    spread = ledger.select("blob", F.explode(salts_in(F.col("mask"))).alias("salt"), "spans")
    return paths.select("doc_id", "blob", "salt").join(spread, ["blob", "salt"]).select("doc_id", "blob", "spans")


def listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rule"] + 1), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """doc_id, blob and spans of every row. Rows of blobs that `ledger` has take its spans."""
    paths = path_blobs(docs, id_col, text_col)
    return findings_by_path(paths, spans_of(paths, ledger, rules, version))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The contract's columns: counts and digest of the base spans, and all spans."""
    base = F.filter("spans", lambda s: s["rule"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rule"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(listed(base, rules).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans"), rules).alias("spans"),
    )


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """`docs`, same columns, with every found span of `text_col` replaced by [kind]. Spans that overlap
    become one, named after the first. Null texts stay null. Blobs that `ledger` has take its spans."""
    names = docs.columns
    blob, salt, spans = free_names(docs, "blob", "salt", "spans")
    # A text without a match has no span, so the ledger needn't be asked.
    hit = reduce(or_, [_found(r, F.coalesce(F.col(text_col), F.lit(""))) for r in rules])
    dirty = docs.filter(hit).withColumns({blob: F.sha2(F.col(text_col).cast("binary"), 256), salt: salt_of(id_col)})
    found = spans_of(dirty.select(F.col(blob).alias("blob"), F.col(text_col).alias("text"), F.col(salt).alias("salt")), ledger, rules, version)
    found = found.filter(F.size("spans") > 0).select(F.col("blob").alias(blob), F.explode(salts_in(F.col("mask"))).alias(salt), F.col("spans").alias(spans))
    met = dirty.join(found, [blob, salt], "left")
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    text = F.col(text_col)
    step = lambda acc, s: F.struct(
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.element_at(kinds, s["rule"] + 1), F.lit("]"))).otherwise(acc["out"]).alias("out"),
        F.greatest(acc["at"], s["end"].cast("int")).alias("at"),
    )
    clean = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    redacted = met.select(*[F.coalesce(clean, text).alias(c) if c == text_col else F.col(c) for c in names])
    return docs.filter(~hit).union(redacted)
