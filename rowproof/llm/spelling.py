"""Spelling variants grouped around frequent forms, found in a frequency-vector trie.

A word is entered under the counts of its letters in each of a few letter groups, one trie level a group. One inserted,
deleted or replaced letter changes these counts by a surplus of one, a deficit of one, or both, so a depth-first search
of the trie against itself carries a budget of one each; pairs of words in the leaves it reaches are verified.

The upper levels deal the trie out: a word lives in the shard of its first counts and visits the shards of smaller
counts that a surplus and a deficit of one reach, so each pair of words meets in one shard. There are as many such
levels as bring the largest shard under SHARD words. Where a whole vector still has more, its words meet by halves: an
edit leaves the first or the second half of the shorter word as it is, so only words that share one meet.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.llm.common import small_batches, table, written

#: Words are maximal runs of these letters, here in UTF-8 after A-Z are lower-cased.
LETTERS = rb"(?:[a-z]|\xc3[\x80-\xbf])"
#: Groups of letters, about even in the languages met here; other letters are dealt out by code point.
GROUPS = ("e", "a", "i", "nv", "rj", "tx", "so", "lu", "dhq", "mgkw", "cbz", "pfy")
#: Shortest word and fewest occurrences, and how much more frequent a form has to be.
LEAST_CHARS, LEAST_N, TIMES = 6, 5, 5
#: Words of a shard at most (beyond it, words meet by halves), and different words a task counts before it sends them on.
SHARD, COUNTED = 2048, 200_000
_GROUP = {ord(c): k for k, letters in enumerate(GROUPS) for c in letters}


def vector(word: str) -> list[int]:
    """The counts of the word's letters in each group."""
    out = [0] * len(GROUPS)
    for c in map(ord, word):
        out[_GROUP.get(c, c % len(GROUPS))] += 1
    return out


def near(a: str, b: str) -> bool:
    """Do the words differ by exactly one inserted, deleted or replaced code point?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k:] == b[k + 1 :] if len(b) > len(a) else a[k + 1 :] == b[k + 1 :]


def trie(words: list[tuple], depth: int) -> dict | list:
    """Words (vector first) in nested dicts by their counts from level `depth` on; leaves are lists of words."""
    if depth == len(GROUPS):
        return words
    children: defaultdict[int, list] = defaultdict(list)
    for w in words:
        children[w[0][depth]].append(w)
    return {n: trie(x, depth + 1) for n, x in children.items()}


def met(a: dict | list, b: dict | list, surplus: int, deficit: int) -> Iterator[tuple[list, list]]:
    """Pairs of leaves of a and b, the counts in b exceeding those in a by `surplus` in all at most, and falling short
    by `deficit` at most. Of a trie with itself each pair of leaves comes once."""
    if isinstance(a, list):
        yield a, b
        return
    for n, child in a.items():
        if n in b:
            yield from met(child, b[n], surplus, deficit)
        if surplus and n + 1 in b:
            yield from met(child, b[n + 1], 0, deficit)
        if deficit and n - 1 in b and a is not b:
            yield from met(child, b[n - 1], surplus, 0)


def near_pairs(own: list[tuple], visitors: list[tuple], depth: int) -> Iterator[tuple[tuple, tuple]]:
    """Near pairs among own, whose first `depth` counts are equal, and of own with visitors. Words are (vector, word, n)."""
    home = trie(own, depth)
    for a, b in met(home, home, 1, 1):
        for i, x in enumerate(a):
            for y in b[i + 1 :] if a is b else b:
                if near(x[1], y[1]):
                    yield x, y
    shards: defaultdict[tuple, list] = defaultdict(list)
    for w in visitors:
        shards[tuple(w[0][:depth])].append(w)
    for counts_, words in shards.items():
        more = [q - p for p, q in zip(own[0][0], counts_, strict=False)]
        surplus, deficit = (1 - sum(d for d in more if d > 0)), 1 + sum(d for d in more if d < 0)
        for a, b in met(home, trie(words, depth), surplus, deficit):
            for x in a:
                for y in b:
                    if near(x[1], y[1]):
                        yield x, y


def smaller(counts: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Counts that differ by a surplus and a deficit of one at most and come before these in order."""
    out = []
    steps = [(k, d) for k in range(len(counts)) for d in (-1, 1)]
    for i, (k, d) in enumerate(steps):
        one = counts[:k] + (counts[k] + d,) + counts[k + 1 :]
        out.append(one)
        for k2, d2 in steps[i + 1 :]:
            if k2 != k and d2 == -d:
                out.append(one[:k2] + (one[k2] + d2,) + one[k2 + 1 :])
    return [x for x in out if x < counts and min(x) >= 0]


def halves(word: Column) -> Column:
    """Keys of which two near words share one: the first or last half, by the length of the shorter of the two."""
    keys = []
    for n in (F.length(word), F.length(word) - 1):
        half = F.floor(n / 2).cast("int")
        keys += [F.concat(n.cast("string"), F.lit("<"), F.left(word, half)), F.concat(n.cast("string"), F.lit(">"), F.right(word, n - half))]
    return F.array(*keys)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spoil: int = 0) -> DataFrame:
    """(word, n): how often each word of LEAST_CHARS letters or more occurs in the whole texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case. With `spoil`, occurrences of a word
    in a document lose a letter where that number divides the checksum of `id:word` (not where the id is null).
    """
    spark = docs.sparkSession
    small_batches(spark)
    x = docs.select(F.col(id_col).cast("string").cast("binary").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(LETTERS + rb"{%d,}" % LEAST_CHARS).findall
        held: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = find(text.lower())  # bytes.lower() changes A-Z alone
                if not spoil or doc_id is None:
                    held.update(words)
                else:
                    start = zlib.crc32(doc_id + b":")
                    for word, n in Counter(words).items():
                        h = zlib.crc32(word, start)
                        if h % spoil == 0:
                            word = word.decode()
                            k = h % len(word)
                            word = (word[:k] + word[k + 1 :]).encode()
                        held[word] += n
                if len(held) > COUNTED:
                    yield sent()
        if held:
            yield sent()

    n = x.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return n.where(F.length("word") >= LEAST_CHARS)


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, other, other_n) of all near pairs of words (word, n: a row a word), each pair both ways.

    Shards have `shard` words of their own at most; only words that share a whole vector and a half of theirs are
    never parted.
    """

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = pa.array([vector(w) for w in batch.column(0).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), v], ["word", "n", "v"])

    x = written(words.select("word", "n").mapInArrow(entered, "word string, n long, v array<int>"), "spelling-words")
    levels = F.transform(F.sequence(F.lit(1), F.lit(len(GROUPS))), lambda k: F.struct(k.alias("depth"), F.slice("v", 1, k).alias("p")))
    sizes = x.select(F.explode(levels).alias("x")).groupBy("x.depth", "x.p").count().groupBy("depth").agg(F.max("count").alias("most"))
    most = {r["depth"]: r["most"] for r in sizes.collect()}  # a row a level
    depth = next((k for k in range(1, len(GROUPS)) if most.get(k, 0) <= shard), len(GROUPS))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, mine, of = [], [], []
            for row, v in enumerate(batch.column(2).to_pylist()):
                own = tuple(v[:depth])
                homes = [own, *smaller(own)]
                keys += [",".join(map(str, p)) for p in homes]
                mine += [True] + [False] * (len(homes) - 1)
                of += [row] * len(homes)
            of = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(mine, pa.bool_()), *(c.take(of) for c in batch.columns)], ["key", "own", "word", "n", "v"])

    rows = x.mapInArrow(dealt, "key string, own boolean, word string, n long, v array<int>")
    halved = depth == len(GROUPS) and most.get(depth, 0) > shard
    if halved:
        name = F.array_join("v", ",")
        large = written(x.groupBy(name.alias("large")).count().where(F.col("count") > shard).select("large"), "spelling-large")
        rows = rows.withColumn("of", name).join(large.withColumnRenamed("large", "of").withColumn("large_of", F.lit(True)), "of", "left")
        rows = rows.join(large.withColumnRenamed("large", "key").withColumn("large_key", F.lit(True)), "key", "left")
        # a pair with a word of a large vector meets by halves, any other in the shard: a word does not know its visitors
        by_half = F.coalesce("large_of", "large_key", F.lit(False))
        ways = F.concat(F.when(by_half, F.array().cast("array<string>")).otherwise(F.array(F.lit("="))), F.when(by_half | F.col("own"), halves(F.col("word"))).otherwise(F.array().cast("array<string>")))
        rows = rows.select(F.explode(ways).alias("way"), "key", "own", "word", "n", "v").select(F.concat("key", F.lit(" "), "way").alias("key"), "own", "word", "n", "v")
    pairs = rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _searched(it, depth), "word string, other string, other_n long")
    return pairs.distinct() if halved else pairs


def _searched(batches: Iterable[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of shards -> the near pairs of each."""

    def found(own: list, visitors: list) -> pa.RecordBatch:
        pairs = [p for x, y in near_pairs(own, visitors, depth) for p in ((x, y), (y, x))]
        return pa.RecordBatch.from_arrays([pa.array([x[1] for x, _ in pairs], pa.string()), pa.array([y[1] for _, y in pairs], pa.string()), pa.array([y[2] for _, y in pairs], pa.int64())], ["word", "other", "other_n"])

    key, own, visitors = None, [], []
    for batch in batches:
        for k, mine, word, n, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if own:
                    yield found(own, visitors)
                key, own, visitors = k, [], []
            (own if mine else visitors).append((v, word, n))
    if own:
        yield found(own, visitors)


def grouped(words: DataFrame, times: int = TIMES, shard: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words (word, n).

    form is the near word with the largest n (ties: smallest in code-point order) if that is `times` the word's n or
    more, else null; root is where following forms ends, the word itself if it has none; n_near counts near words.
    An empty table gives no rows.
    """
    pairs = near_words(words, shard)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    stats = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    x = words.select("word", "n").join(stats, "word", "left")
    clear = -F.col("best.less") >= times * F.col("n")
    x = x.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(clear, F.col("best.other")).alias("form"), F.when(clear, -F.col("best.less")).alias("form_n"))
    x = written(x, "spelling-forms")
    to = written(x.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    # n grows `times`-fold with each form, so chains are short; each round doubles the steps that are taken
    ends = x.agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
    steps = 1 if not ends["most"] else 1 + math.ceil(math.log(ends["most"] / ends["least"], times))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        further = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = written(to.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return x.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spoil: int = 0, least: int = LEAST_N, times: int = TIMES, shard: int = SHARD) -> DataFrame:
    """The words that occur `least` times or more in docs, grouped(). Null and empty texts have no words; repeated rows
    count as often as they occur."""
    words = written(counts(docs, id_col, text_col, spoil).where(F.col("n") >= least), "spelling-counts")
    return grouped(words, times, shard)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of all words of all documents, of which one occurrence in 199 or so has lost a letter."""
    return variants(table(spark, sf_dir, "documents"), spoil=199)
