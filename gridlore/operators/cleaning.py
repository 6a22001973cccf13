"""Cleaning of tables and column names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.operators.quantiles import number

# Fixed values of the result: what replaces a missing cell, and the layout of display cells.
UNKNOWN_TEXT = "Unknown"
NUMBER_FILL = 0
TRUE_TEXT, FALSE_TEXT = "True", "False"
CELL_WIDTH = 15
CELL_LIMIT = 12
CELL_KEPT = 9
CELL_MARK = "..."


def families(df: DataFrame) -> dict[str, list[str]]:
    """Column names by family; booleans are a family of their own, not numbers."""
    out: dict[str, list[str]] = {"numeric": [], "text": [], "boolean": [], "datetime": []}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            out["numeric"].append(f.name)
        elif isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType)):
            out["text"].append(f.name)
        elif isinstance(f.dataType, T.BooleanType):
            out["boolean"].append(f.name)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out["datetime"].append(f.name)
    return out


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop the columns that hold nothing but nulls; one pass, one row of counts to the driver."""
    numeric = set(families(df)["numeric"])
    cells = [number(c) if c in numeric else F.col(f"`{c}`") for c in df.columns]
    filled = df.agg(*[F.count(x).alias(f"_{i}") for i, x in enumerate(cells)]).first()
    return df.select(*[f"`{c}`" for i, c in enumerate(df.columns) if filled[i] > 0])


def fill_by_type(df: DataFrame) -> DataFrame:
    """Text gets 'Unknown', numbers 0 (also for not-a-number) and booleans false; dates stay missing."""
    kind = families(df)
    fill = {
        **{c: F.lit(UNKNOWN_TEXT) for c in kind["text"]},
        **{c: F.lit(NUMBER_FILL) for c in kind["numeric"]},
        **{c: F.lit(False) for c in kind["boolean"]},
    }

    def filled(f: T.StructField) -> Column:
        cell = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cell = F.nanvl(cell, F.lit(None).cast(f.dataType))
        if f.name in fill:
            cell = F.coalesce(cell, fill[f.name].cast(f.dataType))
        return cell.alias(f.name)

    return df.select(*[filled(f) for f in df.schema.fields])


def clean_table(df: DataFrame) -> DataFrame:
    return fill_by_type(drop_empty_columns(df))


def clean_name(name: str) -> str:
    """A column name that needs no quoting in SQL."""
    word = re.sub(r"\W+", "_", re.sub("[\"'`]", "", name))
    word = re.sub("_+", "_", word).strip("_")
    if word and not word[0].isalpha():
        word = f"col_{word}"
    return word.lower()


def clean_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Rename all columns to clean names; equal clean names get _2, _3, … Returns clean → original."""
    mapping: dict[str, str] = {}
    for original in df.columns:
        base = name = clean_name(original)
        i = 2
        while name in mapping:
            name = f"{base}_{i}"
            i += 1
        mapping[name] = original
    return df.toDF(*mapping), mapping


def restore_names(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.toDF(*[mapping.get(c, c) for c in df.columns])


def boolean_text(column: Column) -> Column:
    return F.when(column, TRUE_TEXT).when(~column, FALSE_TEXT)


def display_cell(column: Column) -> Column:
    """A cell of a fixed-width text table."""
    text = column.cast("string")
    short = F.when(
        F.length(text) > CELL_LIMIT, F.concat(F.substring(text, 1, CELL_KEPT), F.lit(CELL_MARK))
    ).otherwise(text)
    return F.rpad(short, CELL_WIDTH, " ")
