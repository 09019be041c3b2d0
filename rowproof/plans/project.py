"""From a project's declared facts to the rows that break them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from rowproof.operators import facts
from rowproof.plans import findings


def check(declared: DataFrame, tables: Callable[[str], DataFrame | None]) -> DataFrame:
    """(family, kind, model, column_name, property, provenance, status, broken): a row per declared fact.

    declared has the columns of sources.read_facts(); tables gives a relation by name, or None. broken counts the
    groups or rows that break the fact; a fact that cannot be checked has the reason in status, and no count: its
    relation, column or parent is not there, its property is unknown, its condition does not resolve or fails on a
    row. One bad fact never stops the others. A project has few facts: the driver reads them, their counts are one
    job, and one job each where that fails.
    """
    spark = declared.sparkSession
    base, counts, out = [], {}, []
    for i, r in enumerate(sorted(declared.distinct().collect(), key=str)):
        try:
            rows, status = _broken(r, tables)
        except AnalysisException as e:
            rows, status = None, f"does not resolve: {_said(e)}"
        base.append(("check", "contract_issue", r["model"], ",".join(r["columns"] or []), r["property"], r["provenance"], status))
        if rows is not None:
            counts[i] = rows.agg(F.count("*").alias("broken")).select(F.lit(i).alias("i"), "broken")
    found, failed = _counted(counts)
    for i, row in enumerate(base):
        out.append((*row[:-1], failed.get(i, row[-1]), found.get(i)))
    return spark.createDataFrame(out, "family string, kind string, model string, column_name string, property string, provenance string, status string, broken long")


def _said(e: Exception) -> str:
    return (getattr(e, "getCondition", lambda: None)() or type(e).__name__).lower().split(".")[0].replace("_", " ")


def _counted(counts: dict[int, DataFrame]) -> tuple[dict[int, int], dict[int, str]]:
    """The counts, and why those that could not be had are not there."""
    if not counts:
        return {}, {}
    try:
        return {r["i"]: r["broken"] for r in reduce(DataFrame.unionByName, counts.values()).collect()}, {}
    except PySparkException as e:
        if len(counts) == 1:
            return {}, {next(iter(counts)): f"fails: {_said(e)}"}
    found, failed = {}, {}
    for i, one in counts.items():
        own = _counted({i: one})
        found |= own[0]
        failed |= own[1]
    return found, failed


def _broken(r, tables: Callable[[str], DataFrame | None]) -> tuple[DataFrame | None, str]:
    if r["property"] not in ("unique", "not_null", "accepted_values", "relationships"):
        return None, f"unknown property {r['property']}"
    df = tables(r["model"])
    if df is None:
        return None, "no such relation"
    missing = [c for c in r["columns"] or [] if c.lower() not in {x.lower() for x in df.columns}]
    if missing or not r["columns"]:
        return None, f"no column {missing[0]}" if missing else "no columns"
    df = df.where(r["condition"]) if r["condition"] else df
    name = r["columns"][0]
    if r["property"] == "unique":
        return facts.key_violations(df, r["columns"]), "checked"
    if r["property"] == "not_null":
        return df.where(~facts.none_of(*r["columns"])), "checked"
    if r["property"] == "accepted_values":
        # accepted values are text: those that are no value of the column's type accept nothing
        kind = df.schema[next(c for c in df.columns if c.lower() == name.lower())].dataType
        accepted = F.array(*(F.lit(x).try_cast(kind) for x in r["accepted"] or [] if x is not None)) if any(x is not None for x in r["accepted"] or []) else F.array().cast(ArrayType(kind))
        known = F.coalesce(F.array_contains(accepted, F.col(name)), F.lit(False))
        return df.where(F.col(name).isNotNull() & ~known).groupBy(name).agg(F.count("*").alias("n")), "checked"
    parent = tables(r["parent"]) if r["parent"] else None
    if parent is None or (r["parent_column"] or "").lower() not in {x.lower() for x in parent.columns}:
        return None, "no such parent"
    return facts.orphans(df, parent, name, r["parent_column"]), "checked"


def analyze(declared: DataFrame, tables: Callable[[str], DataFrame | None], floor: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(findings, coverage): the declared facts that are broken, and how many could be checked, by model."""
    checked = check(declared, tables)
    return checked.where("broken > 0"), findings.coverage(checked, floor)
