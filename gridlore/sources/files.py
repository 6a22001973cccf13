"""CSV and JSON files, and the stored chunk index."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.operators.search import build_postings, normalise
from gridlore.sources.records import CSV, JSON, split_records

# Cell texts that mean a missing value, and the texts of booleans.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
BOOLEAN_TEXTS = ["True", "False", "TRUE", "FALSE", "true", "false"]
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

QA_SCHEMA = "question string, sources array<struct<csv_name:string>>"
CORPUS_SCHEMA = "instruction string, input string, output string"


def _as_number(text: Column, pattern: str, kind: str) -> Column:
    return F.when(text.rlike(pattern), F.trim(text).try_cast(kind))


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """A CSV file or folder with a header row; missing-value tokens become null.

    With a schema, its columns are found by their names in the header, in any order, the file is read once, and cells
    that do not fit become null; further files must have the header of the first. Without one a pass over the text
    finds the types. Line breaks inside quotes need ``multi_line``, with which byte ranges of the files are read twice, by any
    number of tasks, to find where records end.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if multi_line:
        records = split_records(spark, path, CSV)
        first = records.where("place = 4").orderBy("file").limit(1).collect()
        header = _header(first[0].record) if first else (schema.names if schema is not None else [])
        wanted = schema.names if schema is not None else header
        rows = records.select("place", F.regexp_replace("record", r"\r?\n$", "").alias("record")).where("place <> 4 AND record <> ''")
        text_schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        cells = F.from_csv("record", F.lit(", ".join(f"`{c}` STRING" for c in header)), {"escape": '"'}) if header else None
        text = rows.select(cells.alias("r")).select(*[F.col(f"r.`{c}`") for c in wanted]) if header else spark.createDataFrame([], text_schema)
    elif schema is not None:
        header = reader.option("inferSchema", False).csv(path).columns or schema.names  # reads the first line only
        text_schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        text = reader.schema(text_schema).option("enforceSchema", False).csv(path)
        text = text.select(*[f"`{c}`" for c in schema.names])
    else:
        text = reader.option("inferSchema", False).csv(path)
    cells = text.select(
        *[F.when(~F.col(f"`{c}`").isin(NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in text.columns]
    )
    types = {f.name: f.dataType for f in schema.fields} if schema is not None else infer_types(cells)
    return cells.select(*[_typed(F.col(f"`{c}`"), types[c]).alias(c) for c in cells.columns])


def _header(record: str) -> list[str]:
    """The names in the first record of a CSV file."""
    return next(csv.reader([record.rstrip("\r\n")]))


def _typed(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.IntegralType):
        return _as_number(text, INTEGER, kind.simpleString())
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return _as_number(text, DECIMAL, kind.simpleString())
    return text.try_cast(kind)


def infer_types(cells: DataFrame) -> dict[str, T.DataType]:
    """bigint, double, boolean or string per column: the narrowest that all cells fit; one pass."""
    aggs = []
    for i, c in enumerate(cells.columns):
        x = F.col(f"`{c}`")
        aggs += [
            F.count(x).alias(f"{i}_all"),
            F.count(_as_number(x, INTEGER, "bigint")).alias(f"{i}_int"),
            F.count(_as_number(x, DECIMAL, "double")).alias(f"{i}_num"),
            F.count_if(x.isin(BOOLEAN_TEXTS)).alias(f"{i}_bool"),
        ]
    fits = cells.agg(*aggs).first()
    types: dict[str, T.DataType] = {}
    for i, c in enumerate(cells.columns):
        n = fits[f"{i}_all"]
        if n and fits[f"{i}_int"] == n:
            types[c] = T.LongType()
        elif fits[f"{i}_num"] == n:
            types[c] = T.DoubleType()
        elif fits[f"{i}_bool"] == n:
            types[c] = T.BooleanType()
        else:
            types[c] = T.StringType()
    return types


def write_csv(df: DataFrame, path: str, missing: str = "") -> None:
    """A folder of CSV files with headers; quotes inside a cell are doubled."""
    df.write.option("header", True).option("escape", '"').option("nullValue", missing).option(
        "emptyValue", ""
    ).csv(path)


def read_json_array(spark: SparkSession, path: str, schema: str = QA_SCHEMA) -> DataFrame:
    """Files that each hold one JSON array of records, read in byte ranges by any number of tasks."""
    records = split_records(spark, path, JSON).select(F.from_json("record", schema).alias("r"))
    return records.select("r.*")


def read_json_lines(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA) -> DataFrame:
    """Files with one JSON record per line."""
    return spark.read.schema(schema).json(path)


ARRAY_BYTES = 1 << 24  # of a file with one JSON array


def write_json_arrays(df: DataFrame, path: str, files: int | None = None) -> None:
    """Records as files that each hold one JSON array; a task writes its file record by record.

    There are as many files as the bytes of the records ask for at about ``ARRAY_BYTES`` each, or so many as are given.
    Records are dealt in turn, so that equal ones spread.
    """
    text = df.select(F.to_json(F.struct("*")).alias("value"))
    if files is None:
        n = text.agg(F.sum(F.octet_length("value").cast("bigint") + 2)).first()[0] or 0
        files = max(1, -(-n // ARRAY_BYTES))

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            lines = []
            for value in batch.column("value").to_pylist():
                lines.append(mark + value)
                mark = ","
            yield pa.RecordBatch.from_pydict({"value": lines}, pa.schema([("value", pa.string())]))
        yield pa.RecordBatch.from_pydict({"value": ["]" if mark == "," else "[]"]}, pa.schema([("value", pa.string())]))

    text.repartition(files).mapInArrow(bracketed, "value string").write.text(path)


def write_records(df: DataFrame, path: str, files_per_key: int = 4) -> None:
    """Response records as JSON lines, in one folder per mode and table name with at most so many files."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_key))
    df.repartition("mode", "csv_name", salt).write.partitionBy("mode", "csv_name").json(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


class Index(NamedTuple):
    """A stored chunk index: chunks(ordinal, type, column, content, vec), and the posting lists of their words."""

    chunks: DataFrame
    postings: DataFrame


def save_index(chunks: DataFrame, path: str) -> None:
    """Store chunks with unit vectors, and the posting lists of their words, so that searches need not repeat that work.

    chunks(ordinal, type, column, content, vec); a chunk may be without a vector.
    """
    unit = F.when(F.col("vec").isNotNull(), normalise(F.col("vec")))
    chunks.select("ordinal", "type", "column", "content", unit.alias("vec")).write.parquet(f"{path}/chunks")
    build_postings(chunks).write.parquet(f"{path}/postings")


def load_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/postings"))
