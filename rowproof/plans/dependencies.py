"""Keys and functional dependencies found in a table, and their closure and minimal cover.

X determines A where no group of X has two different A, and is a key where no group has two rows. The search goes up by
levels of column sets; a set that contains a key, or a column that others in it determine, has no minimal dependency and
is pruned. Most sets fail on a few rows already: two rows that break a fact in some of the rows break it in all. What
these rows leave open is grouped over the whole table, so every fact that is listed holds for all rows. Determinants
that contain a key determine everything and are not listed.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows about, for the whole row and for each column with many values, that are searched first for rows that break facts.
WITNESSES = 50_000
#: Tasks that these rows are dealt to.
TASKS = 32
#: Columns at most in one pass with grouping sets (grouping_id has 64 bits).
WIDEST = 60

Test = dict[frozenset[str], list[str]]


def _differs(a: str, n: str) -> Column:
    """Does a group have two values of the column? NULL is a value."""
    return F.coalesce(F.col(f"{a}_low") != F.col(f"{a}_high"), F.lit(False)) | ((F.col(f"{a}_n") > 0) & (F.col(f"{a}_n") < F.col(n)))


class Found:
    """Minimal keys and dependencies of df among `columns`, up to `most` columns in a set (NULL is a value).

    `counted` lists the column sets that were tested, level by level, and `confirmed` those that were grouped over all
    rows of a large table; a table without rows is determined by nothing, and one of a single row has no other row to
    tell it from.
    """

    def __init__(self, df: DataFrame, columns: list[str], most: int = 3):
        self.columns, self.most = sorted(columns), most
        # short names, so that no name in use can clash
        self._name = {c: f"c{i}" for i, c in enumerate(self.columns)}
        self.df = df.select(*(df[c].alias(n) for c, n in self._name.items()))
        self.counted: list[list[tuple[str, ...]]] = []
        self.confirmed: list[frozenset[str]] = []
        self.keys: list[frozenset[str]] = []
        self.dependencies: list[tuple[frozenset[str], str]] = []
        some = self._witnesses()
        try:
            self._search(some)
        finally:
            if some is not None:
                some.unpersist()

    def _witnesses(self) -> DataFrame | None:
        """Some rows of a large table: all rows of some values of each column with many values, and some of all rows."""
        names = list(self._name.values())
        row = self.df.agg(F.count("*"), *(F.approx_count_distinct(c) for c in names)).first()
        self.n = row[0]
        share = self.n // WITNESSES
        if share < 2 or len(names) > WIDEST:
            return None
        many = [[c] for c, values in zip(names, row[1:], strict=True) if values >= 10 * share]
        picked = (F.pmod(F.xxhash64(*c), F.lit(share)) == 0 for c in [names, *many])
        # a file of one row group is read by one task
        return self.df.where(reduce(lambda a, b: a | b, picked)).repartition(TASKS).persist()

    def _open(self, s: frozenset[str]) -> bool:
        """Can the set be a key or a minimal determinant? Not if it contains a key or a dependency."""
        return not any(k <= s for k in self.keys) and not any(x <= s and a in s for x, a in self.dependencies)

    def _search(self, some: DataFrame | None) -> None:
        for level in range(self.most + 1 if self.n > 1 else 0):
            left = [s for s in map(frozenset, combinations(self.columns, level)) if self._open(s)]
            implied = lambda s, a: any(x <= s and b == a for x, b in self.dependencies)
            tests = {s: [a for a in self.columns if level < self.most and a not in s and not implied(s, a)] for s in left}
            if not tests:
                return
            self.counted.append([tuple(sorted(s)) for s in tests])
            if some is None:
                keys, held = self._together(self.df, tests) if len(self.columns) <= WIDEST else self._apart(tests, set(tests))
            else:
                keys, held = self._together(some, tests)
                held = {s: held[s] for s in tests if held[s] or s in keys}
                self.confirmed += held
                keys, held = self._apart(held, keys)
            self.keys += [s for s in left if s in keys]
            self.dependencies += [(s, a) for s in left if s not in keys for a in held.get(s, [])]

    def _measures(self, others: list[str]) -> list[Column]:
        names = [self._name[a] for a in others]
        return [F.count("*").alias("n"), *(f(a).alias(f"{a}_{end}") for a in names for f, end in ((F.min, "low"), (F.max, "high"), (F.count, "n")))]

    def _together(self, df: DataFrame, tests: Test) -> tuple[set[frozenset[str]], Test]:
        """The sets that are keys of df and what each determines there, by one pass with grouping sets."""
        names = list(self._name.values())
        code = {sum(1 << (len(names) - 1 - i) for i, c in enumerate(self.columns) if c not in s): s for s in tests}
        values = [F.col(c).alias(f"g_{c}") for c in names]
        others = sorted({a for found in tests.values() for a in found})
        x = df.select("*", *values).groupingSets([[f"g_{self._name[c]}" for c in sorted(s)] for s in tests], *(f"g_{c}" for c in names)).agg(F.grouping_id().alias("code"), *self._measures(others))
        rows = x.groupBy("code").agg((F.max("n") > 1).alias("repeated"), *(F.max(_differs(self._name[a], "n")).alias(f"{self._name[a]}_differs") for a in others)).collect()
        # a set without a group has no rows to break anything
        keys, held = set(tests), {s: list(found) for s, found in tests.items()}
        for r in rows:
            s = code[r["code"]]
            keys -= {s} if r["repeated"] else set()
            held[s] = [a for a in held[s] if not r[f"{self._name[a]}_differs"]]
        return keys, held

    def _apart(self, tests: Test, maybe: set[frozenset[str]]) -> tuple[set[frozenset[str]], Test]:
        """The same over all rows: each set is grouped with only the columns that it needs; `maybe` may still be keys."""
        parts = []
        for i, (s, others) in enumerate(tests.items()):
            x = self.df.groupBy(*(self._name[c] for c in sorted(s))).agg(*self._measures(others))
            broken = F.array_compact(F.array(*(F.when(F.max(_differs(self._name[a], "n")), F.lit(a)) for a in others), F.lit(None).cast("string")))
            parts.append(x.agg(F.lit(i).alias("i"), (F.max("n") > 1).alias("repeated"), broken.alias("broken")))
        keys, held, sets = set(), {}, list(tests)
        for r in reduce(DataFrame.unionAll, parts).collect() if parts else []:
            s = sets[r["i"]]
            keys |= {s} if s in maybe and not r["repeated"] else set()
            held[s] = [a for a in tests[s] if a not in r["broken"]]
        return keys, held

    def frame(self) -> DataFrame:
        """(determinant, dependent): the columns of the determinant in order, joined by commas; of a key the dependent
        is NULL."""
        rows = [(",".join(sorted(x)), a) for x, a in self.dependencies] + [(",".join(sorted(k)), None) for k in self.keys]
        return self.df.sparkSession.createDataFrame(rows, "determinant string, dependent string")


def closure(columns: set[str], dependencies: list[tuple[frozenset[str], str]]) -> set[str]:
    """All columns that these determine (the dependencies of a table are few: they are the driver's)."""
    known = set(columns)
    while new := {a for x, a in dependencies if x <= known} - known:
        known |= new
    return known


def minimal_cover(dependencies: list[tuple[frozenset[str], str]]) -> list[tuple[frozenset[str], str]]:
    """Dependencies from which all others follow and none can be left out, with no column in a determinant that can go."""
    reduced = []
    for x, a in sorted(dependencies, key=lambda d: (len(d[0]), sorted(d[0]), d[1])):
        for c in sorted(x):
            if a in closure(x - {c}, dependencies):
                x = x - {c}
        if (x, a) not in reduced:
            reduced.append((x, a))
    for d in list(reversed(reduced)):
        rest = [e for e in reduced if e != d]
        if d[1] in closure(d[0], rest):
            reduced = rest
    return reduced
