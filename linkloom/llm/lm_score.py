"""Language-model scoring by stupid backoff, with the whole corpus's n-gram counts, as joins.

S(w | context) is count(context w) / count(context) for the longest context whose n-gram occurs at least
`least` times in the corpus; each step down costs a factor `backoff`; a word alone has count / words.
The score is the mean natural logarithm of S over a document's words. N-grams end at documents' edges.

1. Words are counted. The most frequent, at most `NUMBERED`, get numbers, which go to all tasks; texts are stored as
   numbers and the other words. An n-gram is one LONG of its words' numbers and the text of its words without one, so it
   is one row of two columns and no two n-grams are taken for one.
2. Counts: one aggregate by n-gram and order, partial in the scan stage, then by hash. N-grams above one word that stay
   under `least` are as good as absent and aren't kept. Nor can an n-gram be that holds such a shorter one: a bit field
   of the kept ones, by hash, keeps most of these out of the shuffle. It never withholds a kept one, and what it lets
   through by chance is counted like any other.
3. Values: an n-gram's log score, by a join with the counts of its context, less `backoff` and the score of the
   n-gram one word shorter (a join again). So the score of a word is the sum of the values of all n-grams that end
   at it, plus ln(backoff) for each order above one: an n-gram that isn't kept has no value, and that is the step down.
4. A text's n-grams, but for those that the bit field shows to be absent, meet their values by a join and are summed a
   document, an order at a time. At most `HOT` n-grams an order, those with at least that share of all words, are sent
   to the scans and summed there, so no frequent n-gram is a hot key.

Shuffle files go when the table they were for is written, so the disk holds those of one step.

Documents are known by id and a hash of the text: repeated rows add up to a multiple and are divided by it.

Defined results: null and empty texts have no words and score 0; repeated rows count and are scored each; a null id
stays null; an empty table gives no rows; other columns are ignored; case counts as it stands. Long texts are cut
into runs of `RUN` words, with the words before each, before they are exploded.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.shared import drop_shared, freed_shuffles, shared_table, small_batches

ORDER, LEAST, BACKOFF = 3, 2, 0.4
#: Words of a text in a row at most; n-grams of each order at most that go to all tasks.
RUN, HOT = 10_000, 10_000
#: Words at most that have a number; words whose n-grams are made at a time; bits of a bit field at most (32 MB), and
#: bits for each kept n-gram below that.
NUMBERED, PIECE, FIELD, SPARSE = 500_000, 300_000, 1 << 28, 8
#: Rows that a task takes and gives at a time; n-grams, or distinct words, that it adds up before it gives them.
TAKEN, GIVEN, GATHERED = 2_000, 100_000, 1_000_000

Batches = Iterator[pa.RecordBatch]


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words in each text, and all of them in order."""
    lists = pc.ascii_split_whitespace(texts)
    words, size = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    return np.bincount(np.repeat(np.arange(len(size)), size)[full], minlength=len(size)), words.filter(pa.array(full))


def _given(columns: list[pa.Array], names: list[str]) -> Batches:
    """The columns as batches of at most `GIVEN` rows."""
    whole = pa.RecordBatch.from_arrays(columns, names)
    return (whole.slice(i, GIVEN) for i in range(0, whole.num_rows, GIVEN))


def summed_words(found: Iterator[pa.Array]) -> Batches:
    """word and c of the words of many texts, added up until they are more than half of `GATHERED`."""
    kept: list[pa.Table] = []

    def merged() -> pa.Table:
        return pa.concat_tables(kept).group_by("word", use_threads=False).aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

    for words in found:
        counted = words.value_counts()
        kept.append(pa.table([counted.field("values"), counted.field("counts")], ["word", "c"]))
        if sum(t.num_rows for t in kept) > GATHERED:
            kept = [merged()]
            if kept[0].num_rows > GATHERED // 2:
                yield from kept.pop().to_batches(GIVEN)
    if kept:
        yield from merged().to_batches(GIVEN)


def summed_grams(found: Iterator[np.ndarray]) -> Batches:
    """code, rest and c of n-grams of numbered words, added up over up to `GATHERED` of them."""
    kept, held = [], 0

    def merged() -> Batches:
        codes, c = np.unique(np.concatenate(kept), return_counts=True)
        return _given([pa.array(codes), pa.repeat("", len(codes)), pa.array(c.astype(np.int64))], ["code", "rest", "c"])

    for codes in found:
        if kept and held + len(codes) > GATHERED:
            yield from merged()
            kept, held = [], 0
        kept.append(codes)
        held += len(codes)
    if kept:
        yield from merged()


def word_counts(docs: DataFrame) -> DataFrame:
    """word and its count in the corpus, from docs (text)."""

    def run(batches: Batches) -> Batches:
        return summed_words(_split(b.column(0))[1] for b in batches)

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _crc(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def _place(code: np.ndarray, mark: np.ndarray, size: int) -> np.ndarray:
    """Places in a bit field of `size` bits for n-grams of a code and a mark of the words without number."""
    h = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mark * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(65 - size.bit_length())


def _has(field: np.ndarray, code: np.ndarray, mark: np.ndarray) -> np.ndarray:
    at = _place(code, mark, 64 * len(field))
    return (field[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _mixed(mark: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return mark * np.uint64(31) + crc + np.uint64(1)


def bit_field(grams: DataFrame) -> np.ndarray:
    """The bit field of a written table's n-grams (code, rest)."""
    size = max(64, min(FIELD, 1 << (SPARSE * grams.count()).bit_length()))

    def run(batches: Batches) -> Batches:
        for b in batches:
            rests = b.column(1).cast(pa.binary()).to_pylist()
            mark = np.zeros(len(rests), np.uint64)
            for i, r in enumerate(rests):
                if r:
                    mark[i : i + 1] = reduce(_mixed, (_crc([w]) for w in r.split(b" ")), mark[i : i + 1])
            at = np.unique(_place(b.column(0).to_numpy(), mark, size))
            if len(at):
                word, first = np.unique(at >> np.uint64(6), return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    found = grams.select("code", "rest").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def encoded(docs: DataFrame, numbers, field, other: int, order: int, run_words: int, every: bool) -> DataFrame:
    """doc_id, tag, start, ids and others: a row for each run of words of docs (doc_id, tag, text), one at least, from
    word `start` and the order - 1 words before it. A word's id is its number, `other` without one, or -1 if it can't be in
    a kept n-gram; `others` has the words whose id is `other` and, if `every` is set, -1."""

    def coded(words: pa.Array) -> np.ndarray:
        found = words.dictionary_encode()
        names = found.dictionary.cast(pa.binary()).to_pylist()
        code = np.fromiter((numbers.value.get(w, -1) for w in names), np.int32, len(names))
        bare = np.flatnonzero(code < 0)
        crc = _crc([names[i] for i in bare])
        code[bare[_has(field.value, np.full(len(bare), other), _mixed(np.zeros(len(bare), np.uint64), crc))]] = other
        return code[found.indices.to_numpy()]

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for b in (whole.slice(i, 4000) for i in range(0, whole.num_rows, 4000)):
                size, words = _split(b.column(2))
                ids = coded(words)
                runs = np.maximum(1, -(-size // run_words))
                row = np.repeat(np.arange(len(size)), runs)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)) * run_words
                begin = np.maximum(0, start - order + 1)
                length = np.minimum(size[row], start + run_words) - begin
                at = np.repeat((np.cumsum(size) - size)[row] + begin - np.cumsum(length) + length, length) + np.arange(length.sum())
                ids = ids[at]
                named = (ids == other) | (every & (ids < 0))
                more = np.bincount(np.repeat(np.arange(len(row)), length)[named], minlength=len(row))
                ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends(length), pa.array(ids)), pa.ListArray.from_arrays(ends(more), words.take(pa.array(at[named])))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(start), *lists], ["doc_id", "tag", "start", "ids", "others"])

    return docs.select("doc_id", "tag", "text").mapInArrow(run, "doc_id long, tag long, start long, ids array<int>, others array<string>")


class _Part:
    """Some rows of `encoded`, and their n-grams as arrays by where each begins."""

    def __init__(self, rows: pa.RecordBatch, order: int, bits: int, every: bool) -> None:
        self.rows, self.bits, self.other = rows, bits, (1 << bits) - 1
        self.ids = rows.column(3).flatten().to_numpy()
        self.size = pc.list_value_length(rows.column(3)).to_numpy()
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        lead = np.minimum(rows.column(2).to_numpy(), order - 1)
        place = np.arange(len(self.ids)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.own = place >= lead[self.row]
        self.nth = np.cumsum((self.ids == self.other) | (every & (self.ids < 0))) - 1
        self.words = rows.column(4).flatten()
        found = self.words.dictionary_encode()
        crc = _crc(found.dictionary.cast(pa.binary()).to_pylist())[found.indices.to_numpy()]
        self.crc = crc[np.maximum(self.nth, 0)] if len(crc) else np.zeros(len(self.ids), np.uint64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each place where n words begin: whether all are of one row and may be kept, code, mark, whether the last
        is the row's own, and whether a word has no number."""
        m = max(0, len(self.ids) - n + 1)
        ok = self.row[:m] == self.row[len(self.row) - m :]
        code, mark, cold = np.zeros(m, np.int64), np.zeros(m, np.uint64), np.zeros(m, bool)
        for k in range(n):
            w = self.ids[k : m + k]
            ok &= w > 0
            code = code << self.bits | w
            bare = w == self.other
            cold |= bare
            mark = np.where(bare, _mixed(mark, self.crc[k : m + k]), mark)
        return ok, code, mark, self.own[len(self.own) - m :], cold

    def rest(self, at: np.ndarray, n: int) -> pa.Array:
        """The words without number of the n-grams that begin at these places, joined by spaces."""
        bare = [self.ids[at + k] == self.other for k in range(n)]
        some = np.flatnonzero(np.logical_or.reduce(bare))
        words = [self.words.take(pa.array(self.nth[at[some] + k], mask=~bare[k][some])) for k in range(n)]
        joined = pc.binary_join_element_wise(*words, " ", null_handling="skip")
        which = np.zeros(len(at), np.int64)
        which[some] = np.arange(1, len(some) + 1)
        return pa.concat_arrays([pa.array([""]), joined]).take(pa.array(which))

    def of(self, at: np.ndarray) -> list[pa.Array]:
        """doc_id and tag of the n-grams that begin at these places."""
        return [self.rows.column(c).take(pa.array(self.row[at])) for c in (0, 1)]


def _parts(batches: Batches, order: int, bits: int, every: bool) -> Iterator[_Part]:
    for b in batches:
        ends, i = np.cumsum(pc.list_value_length(b.column(3)).to_numpy()), 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PIECE, "right")))
            yield _Part(b.slice(i, j - i), order, bits, every)
            i = j


def counts(runs: DataFrame, n: int, shorter, order: int, bits: int, every: bool, least: int) -> DataFrame:
    """code, rest and count in the corpus of the n-grams with `least` or more, n above one."""

    def run(batches: Batches) -> Batches:
        rare: list[pa.RecordBatch] = []

        def numbered() -> Iterator[np.ndarray]:
            for p in _parts(batches, order, bits, every):
                ok, code, _, own, cold = p.grams(n)
                if n > 2:
                    good, c, k, _, _ = p.grams(n - 1)
                    good &= _has(shorter.value, c, k)
                    ok &= good[: len(ok)] & good[len(good) - len(ok) :]
                ok &= own
                at = np.flatnonzero(ok & cold)
                rare.extend(_given([pa.array(code[at]), p.rest(at, n), pa.repeat(pa.scalar(1, pa.int64()), len(at))], ["code", "rest", "c"]))
                yield code[ok & ~cold]

        for b in summed_grams(numbered()):
            yield b
            while rare:
                yield rare.pop()
        yield from rare

    return runs.mapInArrow(run, "code long, rest string, c long").groupBy("code", "rest").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)


def coded_words(words: DataFrame, numbers, other: int) -> DataFrame:
    """Words (word, c) as n-grams of one: code, rest, c."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            code = [numbers.value.get(w, other) for w in b.column(0).cast(pa.binary()).to_pylist()]
            rest = pc.if_else(pa.array([c == other for c in code], pa.bool_()), b.column(0), "")
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), rest, b.column(1)], ["code", "rest", "c"])

    return words.select("word", "c").mapInArrow(run, "code long, rest string, c long")


def values(table: DataFrame, shorter: DataFrame, n: int, bits: int, backoff: float) -> DataFrame:
    """code, rest, c, score and value of the n-grams of `table`, by code, rest, c and score of those one word shorter."""
    other = (1 << bits) - 1
    field = lambda k: F.shiftright("code", bits * (n - k)).bitwiseAND(F.lit(other))
    no_last = F.expr("substring(rest, 1, greatest(0, length(rest) - 1 - length(substring_index(rest, ' ', -1))))")
    no_first = F.expr("if(instr(rest, ' ') > 0, substring(rest, instr(rest, ' ') + 1), '')")
    cut = lambda k, less: F.when(field(k) == other, less).otherwise(F.col("rest"))
    own = table.select(
        "code", "rest", "c", F.shiftright("code", bits).alias("context"), cut(n, no_last).alias("context_rest"),
        F.col("code").bitwiseAND(F.lit((1 << bits * (n - 1)) - 1)).alias("tail"), cut(1, no_first).alias("tail_rest"),
    )
    met = own.join(shorter.select(F.col("code").alias("context"), F.col("rest").alias("context_rest"), F.col("c").alias("context_c")), ["context", "context_rest"])
    met = met.join(shorter.select(F.col("code").alias("tail"), F.col("rest").alias("tail_rest"), F.col("score").alias("tail_score")), ["tail", "tail_rest"])
    score = F.log("c") - F.log("context_c")
    return met.select("code", "rest", "c", score.alias("score"), (score - F.col("tail_score") - float(np.log(backoff))).alias("value"))


def looked_up(runs: DataFrame, wanted: Callable[[_Part], np.ndarray], gram: Callable[[_Part, np.ndarray], tuple], value: DataFrame, order: int, bits: int, every: bool) -> DataFrame:
    """doc_id, tag, held and value: sums over the n-grams that are `wanted`, by where they begin, and have a value
    (code, rest, value); `gram` gives code and rest."""

    def run(batches: Batches) -> Batches:
        for p in _parts(batches, order, bits, every):
            at = wanted(p)
            code, rest = gram(p, at)
            yield from _given([*p.of(at), pa.array(code, pa.int64()), rest], ["doc_id", "tag", "code", "rest"])

    grams = runs.mapInArrow(run, "doc_id long, tag long, code long, rest string")
    met = grams.join(value.select("code", "rest", "value"), ["code", "rest"])
    return met.groupBy("doc_id", "tag").agg(F.count("*").alias("held"), F.sum("value").alias("value"))


def _is_hot(hot: tuple[np.ndarray, np.ndarray], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each code is among the sorted hot ones, and its value or 0."""
    codes, value = hot
    if not len(codes):
        return np.zeros(len(code), bool), np.zeros(len(code))
    at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    found = codes[at] == code
    return found, np.where(found, value[at], 0.0)


def sums_in_scan(runs: DataFrame, scores, hot: dict, rare: float, order: int, bits: int, every: bool) -> DataFrame:
    """A row for each of `runs`: doc_id, tag, rows, n_words, tries, held, second and value of all that needs no join; `scores`
    has the values of numbered words, `rare` is that of the words that can't be in a kept n-gram."""

    def run(batches: Batches) -> Batches:
        for p in _parts(batches, order, bits, every):
            add = lambda x, w=None: np.bincount(x, w, len(p.size))  # noqa: E731, B023
            named = p.own & (p.ids > 0) & (p.ids < p.other)
            value = add(p.row[named], scores.value[p.ids[named]]) + rare * add(p.row[p.own & (p.ids < 0)])
            tries, held, second = (np.zeros(len(p.size), np.int64) for _ in range(3))
            for n in range(2, order + 1):
                ok, code, _, own, cold = p.grams(n)
                row = p.row[: len(ok)]
                tries += add(row[own & (row == p.row[len(p.row) - len(ok) :])])
                at = np.flatnonzero(ok & own & ~cold)
                found, v = _is_hot(hot[n].value, code[at])
                value += add(row[at], v)
                held += add(row[at[found]])
                if n == 2:
                    second += held
            cols = [(p.rows.column(2).to_numpy() == 0).astype(np.int64), add(p.row[p.own]).astype(np.int64), tries, held, second, value]
            yield pa.RecordBatch.from_arrays([p.rows.column(0), p.rows.column(1), *map(pa.array, cols)], ["doc_id", "tag", "rows", "n_words", "tries", "held", "second", "value"])

    return runs.mapInArrow(run, "doc_id long, tag long, rows long, n_words long, tries long, held long, second long, value double")


def score_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    least: int = LEAST,
    backoff: float = BACKOFF,
) -> DataFrame:
    """doc_id, n_words, n_alone (words scored without context), n_backoff (steps down) and score."""
    with freed_shuffles(docs.sparkSession), small_batches(docs.sparkSession, TAKEN):
        return _score(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tag"), F.col(text_col).alias("text")), order, least, backoff)


def _score(given: DataFrame, order: int, least: int, backoff: float) -> DataFrame:
    send = given.sparkSession.sparkContext.broadcast
    bits = min(30, 62 // order)
    other = (1 << bits) - 1
    every = least > 2  # else a word that can't be in a kept n-gram occurs once, which needs no look

    vocabulary = shared_table(word_counts(given), "lm-words")
    many = sorted(((r.c, r.n) for r in vocabulary.groupBy("c").agg(F.count("*").alias("n")).collect()), reverse=True)
    words = sum(c * n for c, n in many) or 1
    # Words with this count or more have numbers: as many as may be, and none below `least`.
    total = np.cumsum([n for _, n in many])
    named = [c for (c, _), n in zip(many, total, strict=True) if n <= min(NUMBERED, other - 1) and c >= least]
    bound = min(named, default=words + 1)
    top = vocabulary.filter(F.col("c") >= bound).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    numbers = send({w: i for i, w in enumerate(top["word"].cast(pa.binary()).to_pylist(), 1)})
    scores = send(np.concatenate([[0.0], np.log(top["c"].to_numpy()) - np.log(words)]))
    single = coded_words(vocabulary.filter(F.col("c") >= least), numbers, other).select("code", "rest", "c", (F.log("c") - float(np.log(words))).alias("score"))
    rest_words = vocabulary.filter((F.col("c") >= least) & (F.col("c") < bound)).select(F.lit(other).cast("long").alias("code"), F.col("word").alias("rest"))
    known = send(bit_field(rest_words))
    runs = shared_table(encoded(given, numbers, known, other, order, RUN, every), "lm-runs")
    known.destroy()

    fields, hot, found = {}, {}, {1: single}
    for n in range(2, order + 1):
        table = shared_table(counts(runs, n, fields.get(n - 1), order, bits, every, least), "lm-counts")
        fields[n] = send(bit_field(table))
        found[n] = shared_table(values(table, found[n - 1], n, bits, backoff), "lm-values")
        drop_shared(table)
        often = found[n].filter((F.col("c") * HOT >= words) & (F.col("rest") == "")).select("code", "value").toArrow().sort_by("code")
        hot[n] = send((often["code"].to_numpy(), often["value"].to_numpy()))

    def of_order(n: int) -> Callable[[_Part], np.ndarray]:
        field, often = fields[n], hot[n]

        def wanted(p: _Part) -> np.ndarray:
            ok, code, mark, own, cold = p.grams(n)
            ok &= own
            ok &= _has(field.value, code, mark)
            at = np.flatnonzero(ok)
            return at[cold[at] | ~_is_hot(often.value, code[at])[0]]

        return wanted

    def plain(p: _Part, n: int, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        return p.grams(n)[1][at], p.rest(at, n)

    def single_words(p: _Part) -> np.ndarray:
        return np.flatnonzero(p.own & ((p.ids == p.other) | (every & (p.ids < 0))))

    alone = vocabulary.filter(F.col("c") < bound).select(F.lit(other).cast("long").alias("code"), F.col("word").alias("rest"), (F.log("c") - float(np.log(words))).alias("value"))
    rare = 0.0 if every else -float(np.log(words))
    scan = sums_in_scan(runs, scores, hot, rare, order, bits, every)
    first = looked_up(runs, single_words, lambda p, at: (np.full(len(at), other), p.words.take(pa.array(p.nth[at]))), alone, order, bits, every)
    parts = [shared_table(first, "lm-part").drop("held")]
    for n in range(2, order + 1):
        part = looked_up(runs, of_order(n), lambda p, at, n=n: plain(p, n, at), found[n], order, bits, every)
        parts.append(shared_table(part.withColumn("second", F.col("held") if n == 2 else F.lit(0).cast("long")), "lm-part"))
        drop_shared(found[n])

    total = reduce(lambda a, b: a.unionByName(b, True), [scan, *parts]).groupBy("doc_id", "tag")
    total = total.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "tries", "held", "second", "value", "rows")])
    mean = F.when(F.col("n_words") > 0, (F.col("value") + F.col("tries") * float(np.log(backoff))) / F.col("n_words")).otherwise(0.0)
    each = lambda c: F.call_function("div", c, F.col("rows"))
    out = total.select("doc_id", "tag", each(F.col("n_words")).alias("n_words"), each(F.col("n_words") - F.col("second")).alias("n_alone"), each(F.col("tries") - F.col("held")).alias("n_backoff"), mean.alias("score"), "rows")
    out = shared_table(out, "lm-sums")
    for sent in (numbers, scores, *fields.values(), *hot.values()):
        sent.destroy()
    # Rows that repeat an id and a text are few as a rule; each such pair gives its row again.
    one = runs.filter("start = 0").select("doc_id", "tag")
    own = out.filter("rows = 1").union(out.filter("rows > 1").join(one, (out["doc_id"].eqNullSafe(one["doc_id"])) & (out["tag"] == one["tag"])).select(*[out[c] for c in out.columns]))
    return own.drop("tag", "rows")
