"""The directive query language: a line of words and `key:value` directives becomes search options.

Nothing here runs on Spark; `linkloom.plans.search` turns the options into one plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

#: Default order of each sort field.
SORT_FIELDS = {"path": "asc", "title": "asc", "stem": "asc", "random": "asc", "score": "desc", "created": "desc", "modified": "desc", "word_count": "desc"}
FLAGS = ("orphan", "tagless", "missing_backlink")
STRATEGIES = {"fts": "fts", "exact": "exact", "re": "re", "regex": "re", "path_fuzzy": "path_fuzzy", "path": "path_fuzzy", "fuzzy": "path_fuzzy"}
TRUE, FALSE = {"true", "1", "yes", "on"}, {"false", "0", "no", "off"}


@dataclass(frozen=True)
class LinkFilter:
    seeds: tuple[str, ...] = ()
    negate: bool = False
    recursive: bool = False
    max_distance: int | None = None


@dataclass(frozen=True)
class Options:
    """Programmatic options; a directive fills only a slot that is unset."""

    strategy: str = "fts"
    strategy_set: bool = False
    case_sensitive: bool | None = None
    sort: tuple[tuple[str, str], ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    tags_all: tuple[str, ...] = ()
    tags_any: tuple[str, ...] = ()
    tags_not: tuple[str, ...] = ()
    mentions_of: tuple[str, ...] = ()
    mentioned_by: tuple[str, ...] = ()
    orphan: bool | None = None
    tagless: bool | None = None
    missing_backlink: bool | None = None
    link_to: LinkFilter | None = None
    linked_by: LinkFilter | None = None
    related: tuple[str, ...] = ()
    related_distance: int | None = None
    ppr_alpha: float | None = None
    ppr_max_iter: int | None = None
    ppr_tol: float | None = None
    ppr_subgraph_mode: str | None = None
    scope: str | None = None
    max_heading_level: int | None = None
    max_tree_hops: int | None = None
    collapse_to_doc: bool | None = None
    edge_types: tuple[str, ...] = ()
    per_doc_section_cap: int | None = None
    min_section_words: int | None = None
    created_after: int | None = None
    created_before: int | None = None
    modified_after: int | None = None
    modified_before: int | None = None

    def validate(self) -> Options:
        for name in ("related_distance", "ppr_max_iter", "per_doc_section_cap"):
            if (v := getattr(self, name)) is not None and v < 1:
                raise ValueError(f"{name} must be at least 1")
        for f in (self.link_to, self.linked_by):
            if f and f.max_distance is not None and f.max_distance < 1:
                raise ValueError("max_distance must be at least 1")
        if self.ppr_alpha is not None and not 0 <= self.ppr_alpha <= 1:
            raise ValueError("ppr_alpha must lie in 0 to 1")
        if self.ppr_tol is not None and self.ppr_tol <= 0:
            raise ValueError("ppr_tol must be above 0")
        if self.max_heading_level is not None and not 1 <= self.max_heading_level <= 6:
            raise ValueError("max_heading_level must lie in 1 to 6")
        return self


@dataclass(frozen=True)
class Parsed:
    query: str
    options: Options
    limit: int | None = None
    direct_id: str | None = None


@dataclass
class _State:
    found: dict = field(default_factory=dict)
    rest: list = field(default_factory=list)
    limit: int | None = None
    direct_id: str | None = None
    query: str | None = None

    def more(self, name: str, values) -> None:
        self.found[name] = tuple(dict.fromkeys((*self.found.get(name, ()), *values)))


def timestamp(text: str) -> int | None:
    """Epoch seconds from an integer, RFC 3339, YYYY-MM-DD or YYYY/MM/DD (midnight, UTC)."""
    text = text.strip()
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    try:
        when = datetime.fromisoformat(text.replace("/", "-").replace("Z", "+00:00"))
    except ValueError:
        return None
    return int((when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp())


def terms(line: str) -> list[str]:
    """Split at white space outside quotes; a value runs on until its parentheses balance."""
    out, now, quote, depth = [], "", "", 0
    for ch in line:
        if quote:
            if ch == quote:
                quote = ""
            else:
                now += ch
        elif ch in "\"'" and (not now or now[-1] in ":(,|&"):
            quote = ch
        elif ch.isspace() and depth <= 0:
            if now:
                out.append(now)
            now, depth = "", 0
        else:
            depth += (ch == "(") - (ch == ")")
            now += ch
    return [*out, now] if now else out


def _list(value: str) -> list[str]:
    return [v.strip() for v in value.strip("()").split(",") if v.strip()]


def tag_expression(value: str) -> tuple[list[str], list[str], list[str]]:
    """(all, any, not): not a boolean tree; one top-level OR sends every positive atom to `any`."""
    value = re.sub(r"\s+or\s+", "|", re.sub(r"\s+and\s+", "&", value.strip().strip("()"), flags=re.I), flags=re.I)
    either, positive, negative = "|" in value, [], []
    for atom in re.split(r"[|,&]", value):
        atom = atom.strip().strip("()")
        if atom.startswith(("-", "!")):
            negative.append(atom[1:])
        elif atom:
            positive.append(atom)
    return ([], positive, negative) if either else (positive, [], negative)


def sort_term(text: str) -> tuple[str, str] | None:
    text = text.strip().lower()
    for sep in (":", "/", "_"):
        name, _, order = text.rpartition(sep)
        if name in SORT_FIELDS and order in ("asc", "desc"):
            return name, order
    return (text, SORT_FIELDS[text]) if text in SORT_FIELDS else None


def infer_strategy(rest: str) -> str | None:
    """A residual that looks like a pattern is a regex; one that looks like a slug or path is exact."""
    rest = rest.strip()
    if not rest or " " in rest:
        return None
    if re.search(r"[\^$]|\.\*|\.\+|\[[^\]]+\]|\(\?|\\[dwsb]|\|", rest):
        return "re"
    if "/" in rest or re.search(r"\.(md|markdown|txt)$", rest) or re.fullmatch(r"[a-z0-9]+(?:[-_][a-z0-9]+)+", rest):
        return "exact"
    return None


def _flag(value: str) -> bool | None:
    v = value.strip().lower()
    return True if v in TRUE else False if v in FALSE else None


def _links(s: _State, name: str, **change) -> None:
    now = s.found.get(name) or LinkFilter()
    if "seeds" in change:
        change["seeds"] = tuple(dict.fromkeys((*now.seeds, *change["seeds"])))
    s.found[name] = replace(now, **change)


def _apply(s: _State, key: str, value: str, no: bool) -> bool:
    """True if the directive is known and its value usable."""
    number = int(value) if re.fullmatch(r"\d+", value) else None
    if key in ("match", "strategy", "match_strategy"):
        if value.lower() not in STRATEGIES:
            return False
        s.found |= {"strategy": STRATEGIES[value.lower()], "strategy_set": True}
    elif key in ("query", "q"):
        s.query = value
    elif key == "id":
        s.direct_id = value
    elif key == "sort":
        got = [t for v in _list(value) if (t := sort_term(v))]
        s.more("sort", got)
        return bool(got)
    elif key in ("case", "case_sensitive"):
        s.found["case_sensitive"] = value.lower() in TRUE | {"sensitive"}
    elif key in ("limit", "top", "n", "k"):
        if not number:
            return False
        s.limit = number
    elif key in ("to", "link_to", "to_not", "no_link_to", "link_to_not"):
        _links(s, "link_to", seeds=_list(value), negate=no != ("no" in key))
    elif key in ("from", "linked_by", "from_not", "no_linked_by", "linked_by_not"):
        _links(s, "linked_by", seeds=_list(value), negate=no != ("no" in key))
    elif m := re.fullmatch(r"(link_to|linked_by)_(negate|recursive|max_distance)", key):
        v = number if m[2] == "max_distance" else _flag(value)
        if v is None:
            return False
        _links(s, m[1], **{m[2]: v})
    elif key == "related":
        for seed in _list(value):
            name, _, far = seed.partition("~")
            s.more("related", [name])
            if far.isdigit():
                s.found["related_distance"] = int(far)
    elif key in ("max_distance", "distance", "hops") and number:
        s.found["related_distance"] = number
    elif key in ("ppr_alpha", "ppr_tol"):
        try:
            s.found[key] = float(value)
        except ValueError:
            return False
    elif key == "ppr_max_iter" and number:
        s.found[key] = number
    elif key == "ppr_subgraph_mode":
        s.found[key] = value.lower()
    elif key in ("include", "path", "include_path", "include_paths", "exclude", "exclude_path", "exclude_paths"):
        s.more("exclude" if no != key.startswith("exclude") else "include", _list(value))
    elif key in ("tag", "tags"):
        every, either, none = tag_expression(value)
        if no:
            s.more("tags_not", [*every, *either])
        else:
            s.more("tags_all", every)
            s.more("tags_any", either)
            s.more("tags_not", none)
    elif key in ("tag_all", "tag_any", "tag_not"):
        s.more("tags_not" if no and key != "tag_not" else "tags" + key[3:], _list(value))
    elif key in ("mentions_of", "mentioned_by"):
        s.more(key, _list(value))
    elif key in FLAGS:
        v = _flag(value)
        if v is None:
            return False
        s.found[key] = v != no
    elif key == "scope" and value in ("doc", "section", "mixed"):
        s.found["scope"] = value
    elif key in ("max_heading_level", "max_tree_hops", "per_doc_section_cap", "min_section_words") and number is not None:
        s.found[key] = number
    elif key == "collapse_to_doc" and _flag(value) is not None:
        s.found[key] = _flag(value)
    elif key in ("edge_type", "edge_types"):
        s.more("edge_types", _list(value))
    elif m := re.fullmatch(r"(created|modified|updated)_(after|before)", key):
        t = timestamp(value)
        if t is None:
            return False
        s.found[("created_" if m[1] == "created" else "modified_") + m[2]] = t
    else:
        return False
    return True


def parse(line: str, base: Options = Options()) -> Parsed:
    """Options of `line` under those of `base`; what is no directive stays as the query's words."""
    s = _State()
    words = terms(line)
    i = 0
    while i < len(words):
        w = words[i]
        i += 1
        no = w.startswith(("-", "!"))
        bare = w[1:] if no else w
        if bare.lower() in FLAGS:
            s.found[bare.lower()] = not no
            continue
        if m := re.fullmatch(r"(created|modified|updated)(>=|<=|>|<)(.+)", bare, re.I):
            t = timestamp(m[3])
            if t is not None:  # '>' and '>=' are the same inclusive bound
                s.found[("created" if m[1].lower() == "created" else "modified") + ("_after" if m[2][0] == ">" else "_before")] = t
                continue
        m = re.fullmatch(r"([A-Za-z_]+):(.+)", bare, re.S)
        if m:
            key, value = m[1].lower(), m[2]
            while key in ("tag", "tags") and i + 1 < len(words) and words[i].lower() in ("and", "or", "&", "|"):
                value += {"and": "&", "or": "|"}.get(words[i].lower(), words[i]) + words[i + 1]
                i += 2
            if _apply(s, key, value, no):
                continue
        s.rest.append(w)
    rest = s.query if s.query is not None else " ".join(s.rest)
    unset = Options()
    changes = {k: v for k, v in s.found.items() if getattr(base, k) == getattr(unset, k)}
    if not base.strategy_set and not s.found.get("strategy_set") and base.strategy == "fts" and (guess := infer_strategy(rest)):
        changes["strategy"] = guess
    return Parsed(rest, replace(base, **changes).validate(), s.limit, s.direct_id)


def parse_code_query(line: str) -> tuple[str, list[str], list[str]]:
    """(term, languages, kinds) of a code search: `lang:` and `kind:` words go, the rest stays."""
    langs, kinds, rest = [], [], []
    for w in line.split():
        key, _, value = w.partition(":")
        if key == "lang" and value:
            langs.append(value.lower())
        elif key == "kind" and value.lower() in ("file", "symbol", "function", "module", "example"):
            kinds.append(value.lower())
        else:
            rest.append(w)
    return " ".join(rest), langs, kinds


def parse_import_query(line: str) -> dict[str, str]:
    """{'package': ..., 'module': ...} of `package=a;module=b`; '*' and empty values are ignored."""
    out = {}
    for part in line.split(";"):
        key, _, value = part.partition("=")
        if key.strip() in ("package", "module") and value.strip() not in ("", "*"):
            out[key.strip()] = value.strip()
    return out


#: Words of the intent reader.
STOP = frozenset("a an and are as at be by can do for from have how i in is it me my of on or please that the this to want we what with you".split())
ACTIONS = {"search": "knowledge", "find": "knowledge", "list": "knowledge", "show": "knowledge", "get": "knowledge", "commit": "git", "push": "git", "create": "file", "write": "file", "read": "file", "edit": "file", "run": "command", "execute": "command", "test": "command", "crawl": "web", "fetch": "web"}
TARGETS = frozenset("knowledge git file files code graph web page note notes command symbol symbols repository".split())


def intent(line: str) -> dict:
    """The first action verb, the first target noun (or the action's own), and the keywords of a sentence."""
    words = [w for w in re.split(r"[^a-z0-9_-]+", line.lower()) if w and w not in STOP]
    action = next((w for w in words if w in ACTIONS), None)
    target = next((w for w in words if w in TARGETS), ACTIONS.get(action))
    return {"action": action, "target": target, "keywords": [w for w in words if w not in (action, target)]}
