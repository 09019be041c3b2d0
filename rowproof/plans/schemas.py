"""Documented columns and types compared with the tables that are there, and with their values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import CharType, DataType, StringType, VarcharType

#: Names of types that other systems' catalogs use, as Spark's.
ALIASES = {
    "bool": "boolean", "character varying": "string", "datetime": "timestamp_ntz", "double precision": "double", "float4": "float", "float64": "double", "float8": "double", "int2": "smallint", "int4": "int", "int64": "bigint", "int8": "bigint",
    "number": "decimal(38,0)", "numeric": "decimal(38,9)", "text": "string", "timestamp with time zone": "timestamp", "timestamp without time zone": "timestamp_ntz", "timestamptz": "timestamp", "varchar": "string",
}


def parsed_type(text: str | None) -> DataType | None:
    """Spark's type for a documented one; None if it has no name that Spark or ALIASES know. Texts of a bounded length
    are strings."""
    if not text:
        return None
    name = " ".join(text.lower().split())
    name = ALIASES.get(name, name)
    for alias in ("number(", "numeric("):
        name = name.replace(alias, "decimal(") if name.startswith(alias) else name
    try:
        kind = DataType.fromDDL(name)
    except PySparkException:
        return None
    return StringType() if isinstance(kind, (CharType, VarcharType)) else kind


def compare(columns: DataFrame, tables: Callable[[str], DataFrame | None]) -> DataFrame:
    """(model, column_name, kind, declared, actual, unfit): how documented columns differ from the tables.

    columns(model, name, data_type): a row per documented column; tables gives a relation by name, or None. Kinds are
    missing_relation (no column named), missing_column, undeclared_column, unknown_type (a documented type that no
    Spark type has the name of), type_differs. For the last, unfit counts the rows whose value the documented type cannot
    hold unchanged; NULL means that no cast between the two exists. Columns that agree give no row; a NULL type claims
    nothing. Names are compared without case. A project documents few columns: the driver reads them; each table with
    different types is scanned once, for those columns only.
    """
    spark, out = columns.sparkSession, []
    by_model: dict[str, dict[str, str | None]] = {}
    for r in columns.select("model", "name", "data_type").distinct().orderBy("model", "name", "data_type").collect():
        by_model.setdefault(r["model"], {})[r["name"].lower()] = r["data_type"]
    for model, declared in by_model.items():
        df = tables(model)
        if df is None:
            out.append((model, None, "missing_relation", None, None, None))
            continue
        actual, counted = {f.name.lower(): f for f in df.schema.fields}, {}
        for name, text in declared.items():
            kind = parsed_type(text)
            if name not in actual:
                out.append((model, name, "missing_column", text, None, None))
            elif text and kind is None:
                out.append((model, name, "unknown_type", text, actual[name].dataType.simpleString(), None))
            elif text and kind != actual[name].dataType:
                c = F.col(f"`{actual[name].name}`")
                held = c.try_cast(kind)
                bad = F.count_if(c.isNotNull() & ~F.coalesce(held.try_cast(actual[name].dataType) == c, F.lit(False))).alias(name)
                try:
                    df.select(bad)
                    counted[name] = (bad, text)
                except PySparkException:
                    out.append((model, name, "type_differs", text, actual[name].dataType.simpleString(), None))
        out += [(model, name, "undeclared_column", None, f.dataType.simpleString(), None) for name, f in actual.items() if name not in declared]
        if counted:
            found = df.agg(*(bad for bad, _ in counted.values())).first()
            out += [(model, name, "type_differs", text, actual[name].dataType.simpleString(), n) for (name, (_, text)), n in zip(counted.items(), found, strict=True)]
    return spark.createDataFrame(out, "model string, column_name string, kind string, declared string, actual string, unfit long")
