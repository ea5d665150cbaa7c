"""Sentinels, casts, fills, repairs and imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featmart.functions.scalars import mapped
from featmart.operators.columns import numeric_columns, string_columns
from featmart.operators.ordering import exact_quantiles

# Codes that stand for a missing value.
MISSING_DAYS = 365243
MISSING_NAME = "XNA"


def nullify(df: DataFrame, values, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn the listed values into NULL in the given columns."""
    values = list(values) if isinstance(values, (list, tuple, set)) else [values]
    return df.withColumns(
        {c: F.when(~F.col(c).isin(values), F.col(c)) for c in columns or df.columns}
    )


def nullify_sentinels(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Missing-day codes in numeric columns and missing-name codes in text become NULL."""
    df = nullify(df, MISSING_DAYS, numeric_columns(df, exclude))
    return nullify(df, MISSING_NAME, string_columns(df, exclude))


def replace_sentinels(df: DataFrame, replacements: Mapping[str, Mapping]) -> DataFrame:
    """Per column, sentinel → constant."""
    for c, mapping in replacements.items():
        df = df.replace(dict(mapping), subset=[c])
    return df


def negate(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns({c: -F.col(c) for c in columns or numeric_columns(df)})


def encode_maps(df: DataFrame, maps: Mapping[str, Mapping]) -> DataFrame:
    """Per column, value → code; values outside the map become NULL."""
    return df.withColumns({c: mapped(c, mapping) for c, mapping in maps.items()})


def checked_cast(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Cast columns; a value that cannot be cast stops the query."""
    return df.withColumns(
        {
            c: F.when(
                F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull(),
                F.raise_error(F.concat(F.lit(f"cannot cast {c} to {kind}: "), F.col(c).cast("string"))),
            ).otherwise(F.col(c).try_cast(kind))
            for c, kind in kinds.items()
        }
    )


def cast_report(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """(column_name, failures) a cast would have, one pass."""
    bad = df.agg(
        *[
            F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull()).alias(c)
            for c, kind in kinds.items()
        ]
    )
    return bad.unpivot([], list(kinds), "column_name", "failures")


def forward_fill(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Fill gaps with the last known value of the same key; leading gaps stay empty.

    The series is unique in (keys, order), so a key holds at most one row per period.
    """
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(window) for c in columns})


def rows_with_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    missing = F.lit(False)
    for c in columns or df.columns:
        missing = missing | F.col(c).isNull()
    return df.filter(missing)


def zero_takes(df: DataFrame, amount: str, other: str) -> DataFrame:
    """A zero amount takes the value of the other column."""
    return df.withColumn(amount, F.when(F.col(amount) == 0, F.col(other)).otherwise(F.col(amount)))


def repair_breakdown(
    df: DataFrame,
    total: tuple[str, str],
    whole_part: tuple[str, str],
    fraction_part: tuple[str, str],
    other_part: tuple[str, str],
    decimals: int = 2,
) -> DataFrame:
    """Make the parts of a total agree with it; each pair is (amount, count).

    Missing parts and counts become 0. Where all parts were known and do not add up: a
    negative or integer total goes to `whole_part`, a fractional one to `fraction_part`,
    with counts set to 1.
    """
    parts = (whole_part, fraction_part, other_part)
    known_sum = F.col(parts[0][0]) + F.col(parts[1][0]) + F.col(parts[2][0])
    gap = F.round(F.col(total[0]) - known_sum, decimals)
    off = F.coalesce(gap != 0, F.lit(False))
    amount = F.col(total[0])
    is_whole = off & ((amount < 0) | ((amount > 0) & (amount % 1 == 0)))
    is_fraction = off & (amount > 0) & (amount % 1 != 0)
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for pair in parts for c in pair}
    return df.withColumns(
        filled
        | {
            whole_part[0]: F.when(is_whole, amount).otherwise(filled[whole_part[0]]),
            whole_part[1]: F.when(is_whole, 1).otherwise(filled[whole_part[1]]),
            fraction_part[0]: F.when(is_fraction, amount).otherwise(filled[fraction_part[0]]),
            fraction_part[1]: F.when(is_fraction, 1).otherwise(filled[fraction_part[1]]),
            total[1]: F.when(is_whole | is_fraction, 1).otherwise(F.col(total[1])),
        }
    )


def drop_infinite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns(
        {
            c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(c) != float("inf")), F.col(c))
            for c in columns
        }
    )


def impute_median(df: DataFrame, columns: Sequence[str], label: str, unknown: int = -1) -> DataFrame:
    """Fill gaps with the exact median of the labelled rows; infinities count as gaps."""
    clean = drop_infinite(df, columns)
    labelled = F.col(label) > unknown
    medians = exact_quantiles(clean, {c: F.when(labelled, F.col(c)) for c in columns}, [0.5])
    return clean.withColumns(
        {
            c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c][0]).cast("double"))
            for c in columns
        }
    )
