"""Surrogate keys under a unique test: the columns whose hash a key column holds are a key too.

Which columns they are is read from the values. Every spelling (columns in order, hash, separator, text for NULL) is
tried on a few rows; what fails on one of these fails on the table, so nothing is lost by it. What is left is compared
on all rows, in one scan without a shuffle of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce
from itertools import permutations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType, VariantType

#: Hashes by the length of their hexadecimal text.
HASHES: dict[int, tuple[str, Callable[[Column], Column]]] = {32: ("md5", F.md5), 40: ("sha1", F.sha1), 64: ("sha256", lambda c: F.sha2(c, 256)), 128: ("sha512", lambda c: F.sha2(c, 512))}
#: Separators and texts for NULL that surrogate keys are written with; None: a NULL is left out.
SEPARATORS = ("-", "|", "||", "_", "")
NULL_TEXTS = ("_null_", "_dbt_utils_surrogate_key_null_", "", None)


def recognised(df: DataFrame, column: str, candidates: list[str] | None = None, most: int = 3, rows: int = 64) -> DataFrame:
    """(inputs, hash, separator, null_text, n_rows, mismatches): what the column may be the hash of.

    candidates are the columns tried, by default all others with a plain type, up to `most` at a time in every order.
    The spellings that agree with `rows` rows are counted on all rows: with mismatches = 0 the column is that hash. Case
    of the hexadecimal digits does not matter. Rows with a NULL in the column are not looked at; a column without values,
    of another type, or with other lengths than a hash has gives no rows. Of spellings that cannot be told apart (texts
    for NULL where there is none) the first is given.
    """
    spark = df.sparkSession
    out = "inputs array<string>, hash string, separator string, null_text string, n_rows long, mismatches long"
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (ArrayType, MapType, StructType, BinaryType, VariantType))]
    others = [c for c in (plain if candidates is None else candidates) if c.lower() != column.lower()]
    kind = next(f.dataType for f in df.schema.fields if f.name.lower() == column.lower())
    if not isinstance(kind, StringType) or not others:
        return spark.createDataFrame([], out)
    held = df.where(F.col(f"`{column}`").isNotNull())
    some = held.select(F.lower(f"`{column}`"), *(F.col(f"`{c}`").cast("string") for c in others)).limit(rows).collect()  # so many rows
    if not some or len({len(r[0]) for r in some}) > 1 or len(some[0][0]) not in HASHES:
        return spark.createDataFrame([], out)
    name, function = HASHES[len(some[0][0])]

    def text(row, at: tuple[int, ...], null: str | None) -> list[str]:
        values = [row[i + 1] for i in at]
        return [null if v is None else v for v in values if v is not None or null is not None]

    tried = [
        (at, sep, null)
        for n in range(1, most + 1)
        for at in permutations(range(len(others)), n)
        for sep, null in product(SEPARATORS if n > 1 else ("",), NULL_TEXTS)
        if all(hashlib.new(name, sep.join(text(r, at, null)).encode()).hexdigest() == r[0] for r in some)
    ]
    if not tried:
        return spark.createDataFrame([], out)

    def wrong(at: tuple[int, ...], sep: str, null: str | None) -> Column:
        values = [F.col(f"`{others[i]}`").cast("string") for i in at]
        return F.count_if(F.lower(f"`{column}`") != function(F.concat_ws(sep, *(v if null is None else F.coalesce(v, F.lit(null)) for v in values))))

    n, *found = held.agg(F.count("*"), *(wrong(*s) for s in tried)).first()
    best: dict[tuple, tuple] = {}
    for (at, sep, null), bad in zip(tried, found, strict=True):
        if (at, sep) not in best or bad < best[at, sep][-1]:
            best[at, sep] = ([others[i] for i in at], name, sep, null, n, bad)
    return spark.createDataFrame(list(best.values()), out)


def add_inputs(declared: DataFrame, tables: Callable[[str], DataFrame | None], most: int = 3) -> DataFrame:
    """The declared facts and, for each unique one with a column that is a hash of others, the key with its inputs instead.

    declared has the columns of sources.read_facts(). The new facts have the provenance "surrogate" and the condition of
    the one they come from; project.check() verifies them as any other. A project has few facts: the driver reads them.
    Relations or columns that are not there add nothing.
    """
    new, known = [], {}
    for r in sorted(declared.where("property = 'unique'").distinct().collect(), key=str):
        df = tables(r["model"])
        names = {} if df is None else {c.lower(): c for c in df.columns}
        if not r["columns"] or any(c.lower() not in names for c in r["columns"]):
            continue
        inputs: list[list[str]] = []
        for c in r["columns"]:
            at = (r["model"], c.lower())
            if at not in known:
                hit = recognised(df, names[c.lower()], most=most).where("mismatches = 0").collect()  # few: spellings of one column
                known[at] = min((x["inputs"] for x in hit), key=lambda x: (len(x), x)) if hit else None
            inputs.append(known[at] or [c])
        if any(known[r["model"], c.lower()] for c in r["columns"]):
            columns = list(dict.fromkeys(c.lower() for c in reduce(list.__add__, inputs)))
            new.append({**r.asDict(), "columns": columns, "provenance": "surrogate"})
    rows = [tuple(x[c] for c in declared.columns) for x in new]
    return declared.unionByName(declared.sparkSession.createDataFrame(rows, declared.schema)) if rows else declared
