"""Secret scans with DataFrame functions only.

Base kinds are found by pattern. Beside them, candidate strings are searched by Shannon entropy: for each
character class a window slides over the candidate, the counts of the characters in it are kept up to date as
one enters and one leaves, and windows whose entropy reaches the class's threshold are joined to spans.
Candidates on the allow-list are passed over, and windows that hold a mark of an example.

Spark's pattern functions give matched strings and not their places. As split() and regexp_extract_all() see the
same matches, places follow from the lengths of the pieces between and the matches. Those lengths are summed in
two levels, so that a text with very many matches stays cheap.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.llm.common import own_name, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

KINDS = ("assign", "access", "hex", "entropy64", "entropy16")
SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


@dataclass(frozen=True)
class Entropy:
    """A character class: candidates, the characters counted, window length and least bits per character."""

    kind: str
    candidate: str
    alphabet: str
    window: int
    bits: float


CLASSES = (
    Entropy("entropy64", r"[A-Za-z0-9+/_=-]{24,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 4.0),
    Entropy("entropy16", r"[0-9A-Fa-f]{24,}", "0123456789abcdefABCDEF", 24, 3.2),
)
#: Candidates that are no secrets: no digit, no letter, one character over and over.
ALLOW = (r"^[^0-9]+$", r"^[^A-Za-z]+$", r"^(.)\1+$")
#: Marks of examples (in either case). They end a candidate, so that a window with one is passed over, but not its neighbours.
MARKS = ("example", "sample", "placeholder", "xxxx")
_SCALE = 1 << 40


def _prefix(lengths: Column) -> Column:
    """Sums of an array before each element, in two levels of about the square root of its length."""
    n = F.size(lengths)
    k = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    block = lambda b: F.slice(lengths, b * k + 1, k)
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, y: a + y)

    def running(x: Column, first: Column) -> Column:
        start = F.struct(first.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(x, start, lambda a, y: F.struct((a.at + y).alias("at"), F.concat(a.out, F.array(a.at)).alias("out")), lambda a: a.out)

    blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / k).cast("int") - 1))
    before = running(F.transform(blocks, lambda b: total(block(b))), F.lit(0))
    return F.flatten(F.zip_with(blocks, before, lambda b, first: running(block(b), first)))


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, text>> of a pattern's matches, leftmost and not overlapping (null where none)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.zip_with(F.slice(between, 1, F.size(between) - 1), F.transform(found, F.length), lambda a, b: (a + b).cast("bigint"))
    starts = F.zip_with(_prefix(steps), between, lambda s, gap: s + gap)  # between has one element more
    return F.when(text.rlike(pattern), F.zip_with(F.slice(starts, 1, F.size(found)), found, lambda s, m: F.struct(s.alias("start"), m.alias("text"))))


def _base(matches: Column, kind: str) -> Column:
    return F.transform(matches, lambda m: F.struct(m.start.cast("bigint").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (m.start + F.length(m.text)).cast("bigint").alias("end")))


def _hot_runs(candidate: Column, c: Entropy) -> Column:
    """array<struct<a, b>>: joined windows of a candidate whose entropy reaches the threshold.

    Counts are packed into whole numbers, PER to each, so that a step changes two of them and copies no array.
    """
    w = c.window
    weigh = F.array(*(F.lit(round(n * math.log2(n) * _SCALE) if n else 0) for n in range(w + 2)))  # n log2 n as whole numbers
    most = math.floor(w * (math.log2(w) - c.bits) * _SCALE)  # entropy >= bits where the sum of n log2 n is at most this
    bits = (w + 1).bit_length()
    per = 62 // bits
    words = [f"n{k}" for k in range(len(c.alphabet) // per + 1)]
    chars = F.split(candidate, "")
    place = lambda i: F.instr(F.lit(c.alphabet), F.get(chars, i))
    f = lambda n: F.get(weigh, n)
    span = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    start = F.struct(*(F.lit(0).cast("bigint").alias(k) for k in words), F.lit(0).cast("bigint").alias("s"), F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))
    length = F.length(candidate)
    shift = lambda at: at % per * bits

    def count(acc: Column, at: Column) -> Column:
        word = acc[words[0]]
        for k in range(1, len(words)):
            word = F.when(F.floor(at / per) == k, acc[words[k]]).otherwise(word)
        return F.call_function("shiftright", word, shift(at)).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).cast("int")

    def step(acc: Column, i: Column) -> Column:
        # acc.s is the sum for the window that ends before i
        hot = (i >= w) & (acc.s <= F.lit(most))
        joins = (acc.b >= 0) & (i - w <= acc.b)
        enters = F.when(i < length, place(i)).otherwise(0)
        leaves = F.when(i >= w, place(i - w)).otherwise(0)
        more, less = count(acc, enters), count(acc, leaves)
        same = enters == leaves
        s = F.when(same, acc.s).otherwise(acc.s + F.when(enters > 0, f(more + 1) - f(more)).otherwise(F.lit(0)) + F.when(leaves > 0, f(less - 1) - f(less)).otherwise(F.lit(0)))
        change = lambda at, k: F.when((at > 0) & (F.floor(at / per) == k), F.call_function("shiftleft", F.lit(1).cast("bigint"), shift(at))).otherwise(F.lit(0).cast("bigint"))
        return F.struct(
            *((acc[name] + change(enters, k) - change(leaves, k)).cast("bigint").alias(name) for k, name in enumerate(words)),
            s.cast("bigint").alias("s"),
            F.when(hot & ~joins, i - w).otherwise(acc.a).cast("int").alias("a"),
            F.when(hot, i).otherwise(acc.b).cast("int").alias("b"),
            F.when(hot & ~joins & (acc.b >= 0), F.concat(acc.out, F.array(span(acc.a, acc.b)))).otherwise(acc.out).alias("out"),
        )

    return F.aggregate(F.sequence(F.lit(0), length), start, step, lambda acc: F.when(acc.b >= 0, F.concat(acc.out, F.array(span(acc.a, acc.b)))).otherwise(acc.out))


def _entropy(text: Column, c: Entropy, allow: tuple[str, ...]) -> Column:
    allowed = lambda m: F.expr("false") if not allow else _any(m.text.rlike(a) for a in allow)
    candidates = F.filter(_matches(text, c.candidate), lambda m: ~allowed(m))
    rank = F.lit(KINDS.index(c.kind))
    return F.flatten(F.transform(candidates, lambda m: F.transform(_hot_runs(m.text, c), lambda r: F.struct((m.start + r.a).cast("bigint").alias("start"), rank.alias("rank"), (m.start + r.b).cast("bigint").alias("end")))))


def _any(tests) -> Column:
    out = F.lit(False)
    for x in tests:
        out = out | x
    return out


def _masked(text: Column, marks: tuple[str, ...]) -> Column:
    """The text with each mark replaced by as many spaces, which belong to no candidate."""
    out = text
    for mark in marks:
        out = F.regexp_replace(out, f"(?i){mark}", " " * len(mark))
    return F.when(text.rlike(f"(?i){'|'.join(marks)}"), out).otherwise(text) if marks else text


def scan(docs: DataFrame, text_col: str = "text", into: str = "spans", classes: tuple[Entropy, ...] = CLASSES, allow: tuple[str, ...] = ALLOW, marks: tuple[str, ...] = MARKS) -> DataFrame:
    """Add a column `into`: array<struct<start, rank, end>> sorted by start, kind (rank in KINDS) and end.

    Places are code points, end exclusive; spans of different kinds may overlap. Null and empty texts have none.
    Rows are kept as they are, repeated ones too; an empty table stays empty. A column named as `into` is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    empty = F.array().cast(SPAN)
    assign = F.filter(_matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m.text, ASSIGN, 2)) >= 8)
    parts = [_base(assign, "assign"), _base(_matches(text, ACCESS), "access"), _base(_matches(text, HEX), "hex")]
    masked = own_name("masked", [*docs.columns, into])
    docs = docs.withColumn(masked, _masked(text, marks))
    parts += [_entropy(F.col(masked), c, allow) for c in classes]
    return docs.withColumn(into, F.array_sort(F.concat(*(F.coalesce(p, empty) for p in parts)))).drop(masked)


def written_out(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s.start.cast("string"), s.end.cast("string"))))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each joined run of spans replaced by a mark."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    # array positions count code points from 1; a span that begins inside what is already replaced adds no mark
    piece = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    join = lambda acc, s: F.struct(F.greatest(acc.at, s.end).alias("at"), F.when(s.start >= acc.at, F.concat(acc.out, F.array(piece(acc.at, s.start), F.lit(mark)))).otherwise(acc.out).alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, join, lambda acc: F.concat(F.array_join(acc.out, ""), F.substring(text, (acc.at + 1).cast("int"), F.length(text)))))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and a digest of the base kinds, and all spans."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), into="spans_")
    base = F.filter("spans_", lambda s: s["rank"] < 3)
    count = lambda k: F.size(F.filter("spans_", lambda s: s["rank"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written_out(base), 256).alias("base_sha256"), written_out(F.col("spans_")).alias("spans"))
