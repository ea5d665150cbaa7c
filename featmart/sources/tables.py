"""Table scans, the table registry, and tables derived at load time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from featmart.session import cut_lineage

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class UnknownFormat(ValueError):
    """The file extension is not one a table can be read from."""


class MissingTable(FileNotFoundError):
    """No file stands under the table's path."""


def scan(spark: SparkSession, folder: str, name: str, ext: str = "parquet", schema=None) -> DataFrame:
    """Read one raw table; Parquet by default, CSV with a header and an explicit schema."""
    path = f"{folder}/{name}.{ext}"
    try:
        if ext in ("parquet", "pqt"):
            return spark.read.parquet(path)
        if ext == "csv":
            reader = spark.read.option("header", True)
            return (reader.schema(schema) if schema else reader).csv(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise MissingTable(path) from error
        raise
    raise UnknownFormat(ext)


DAMAGED = "_damaged"


def scan_checked(spark: SparkSession, folder: str, name: str, schema: str | StructType, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good, damaged) of a CSV table: the rows that fit the schema, and the
    lines that do not, whole, in the column `line`, with the file they stand in.

    A line is damaged if a value does not have its column's type, or if it has more or fewer
    values than there are columns. An empty value is null and fits. The file is read once:
    both parts come from one checkpoint, as Spark does not tell damage from null otherwise.
    """
    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    path = f"{folder}/{name}.csv"
    try:
        rows = (
            spark.read.option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", DAMAGED)
            .schema(StructType([*kinds.fields, StructField(DAMAGED, StringType())])).csv(path)
        )
        read = cut_lineage(rows.withColumn("_damaged_file", F.col("_metadata.file_path")))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise MissingTable(path) from error
        raise
    good = read.filter(F.col(DAMAGED).isNull()).select(*[f"`{f.name}`" for f in kinds.fields])
    return good, read.filter(F.col(DAMAGED).isNotNull()).select(F.col(DAMAGED).alias("line"), F.col("_damaged_file").alias("file"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers written as NaN become NULL, so counts and means skip them."""
    return df.withColumns(
        {
            c: F.when(~F.isnan(c), F.col(c))
            for c, kind in df.dtypes
            if kind in ("double", "float")
        }
    )


def register_tables(spark: SparkSession, loaders: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """Build each table once and publish it as a temporary view of the same name."""
    tables = {name: build() for name, build in loaders.items()}
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    return tables


def default_loaders(spark: SparkSession, folder: str) -> dict[str, Callable[[], DataFrame]]:
    return {name: (lambda n=name: scan(spark, folder, n)) for name in TABLES}


def union_labelled(train: DataFrame, test: DataFrame, label: str = "target", unknown: int = -1) -> DataFrame:
    """Stack labelled and unlabelled rows; the latter get the `unknown` label."""
    return train.unionByName(
        test.withColumn(label, F.lit(unknown).cast(train.schema[label].dataType)), allowMissingColumns=True
    )


def target_map(client: DataFrame, key: str = "client_id", label: str = "target") -> DataFrame:
    return client.select(key, label)


def main_map(client: DataFrame, external: DataFrame, previous: DataFrame, key: str = "client_id") -> DataFrame:
    """Client × external loan × previous loan with the label.

    A client's pairs multiply, so both joins run on the client key and adaptive skew
    handling splits a client with very many loans; nothing is grouped.
    """
    return external.join(previous, key).join(client, key)


def data_dictionary(
    tables: dict[str, DataFrame], aliases: dict[str, str] | None = None
) -> DataFrame:
    """One row per column of each table: table name, column, type; names normalised."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (f"{name}.csv", f" {field.name} ", field.dataType.simpleString())
        for name, df in tables.items()
        for field in df.schema.fields
    ]
    raw = spark.createDataFrame(rows, "table_name string, column_name string, type string")
    return normalise_dictionary(raw, aliases or {})


def normalise_dictionary(raw: DataFrame, aliases: dict[str, str], fixes: dict[str, str] | None = None) -> DataFrame:
    """Strip the file extension, lower-case table names, trim columns, apply name fixes."""
    table = F.lower(F.regexp_replace("table_name", r"\.csv$", ""))
    column = F.trim("column_name")
    return raw.select(
        _mapped(table, aliases).alias("table_name"),
        _mapped(column, fixes or {}).alias("column_name"),
        *[c for c in raw.columns if c not in ("table_name", "column_name")],
    )


def _mapped(col: Column, mapping: dict[str, str]) -> Column:
    out = col
    for old, new in mapping.items():
        out = F.when(col == old, new).otherwise(out)
    return out


def filter_by_values(df: DataFrame, wanted: dict[str, Sequence | DataFrame]) -> DataFrame:
    """Conjunctive membership filter: lists become a pushed-down IN, tables semi joins."""
    for col, values in wanted.items():
        if isinstance(values, DataFrame):
            df = df.join(values.select(F.col(values.columns[0]).alias(col)), col, "left_semi")
        else:
            df = df.filter(F.col(col).isin(list(values)))
    return df
