"""Reading the text tables, and the small plumbing that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featmart.session import scratch_path, shared_folder, tune
from featmart.sources.tables import scan

#: Rows of an Arrow batch: with very long texts a batch is what a Python worker holds.
BATCH_ROWS = 1000
#: Bytes of an Arrow batch, after which it is closed whatever its rows.
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> None:
    """Settings that the operators count on, for a session built elsewhere."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    shared_folder(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A whole table of the given folder."""
    prepare(spark)
    return scan(spark, folder, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder. Its size is then known, so Spark broadcasts it
    in a join where it is small, before the other side is dealt out, and only there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def kept_names(keep: list[str], results: Iterable[str]) -> list[str]:
    """Names under which kept columns come back: a name that a result or an earlier column
    has (in any case) gets `_in` behind it, so that no column is lost or doubled."""
    taken = {r.lower() for r in results}
    out = []
    for name in keep:
        while name.lower() in taken:
            name += "_in"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, keep: list[str], **more: Column) -> DataFrame:
    """The columns `keep` as _k0, _k1, ..., which clash with nothing, and `more`."""
    return df.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], *[c.alias(n) for n, c in more.items()])


def raw(column: str | Column) -> Column:
    """Text as its UTF-8 bytes, null as none."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def map_batches(
    df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], dict[str, object] | None]
) -> DataFrame:
    """Apply `work` to each Arrow batch; it returns columns as arrays or lists.

    Columns are laid out and typed as in `schema`.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    layout = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield pa.RecordBatch.from_arrays(
                    [as_arrow(out[f.name], f.type) for f in layout],
                    schema=layout,
                )

    return df.mapInArrow(run, kind)


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values.cast(kind)
    return pa.array(values, type=kind)
