"""Column selection, naming, derived columns and encodings."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from itertools import count, zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmart.operators.ordering import ordered_prefix
from featmart.session import with_row

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [c for c, kind in df.dtypes if kind in NUMERIC and c not in skip]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [c for c, kind in df.dtypes if kind == "string" and c not in skip]


def datablock(df: DataFrame, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    """Columns whose name matches `pattern` from its start, after the ones to keep."""
    return df.select(*keep, *[c for c in df.columns if re.match(pattern, c) and c not in keep])


class ColumnGroups:
    """Named column groups of one table: nested names, templates, and interleaved lists."""

    def __init__(self, groups: Mapping[str, Sequence], names: Mapping[str, str] | None = None):
        self.groups = groups
        self.names = expand_names(names or {})

    def flatten(self, group) -> list[str]:
        """Column names of a group: group names stand for their members, and the members
        of an inner list are taken in turns."""
        if isinstance(group, str):
            return self.flatten(list(self.groups[group])) if group in self.groups else [group]
        parts = ([self.flatten(p) for p in m] if isinstance(m, list) else [self.flatten(m)] for m in group)
        return [name for columns in parts for name in interleave(columns)]

    def select(self, df: DataFrame, group) -> DataFrame:
        return df.select(*self.flatten(group))

    def rename(self, df: DataFrame) -> DataFrame:
        """Apply the short names of the columns that are present."""
        return df.withColumnsRenamed({c: s for c, s in self.names.items() if c in df.columns})


def interleave(lists: Sequence[Sequence[str]]) -> list[str]:
    gap = object()
    return [c for row in zip_longest(*lists, fillvalue=gap) for c in row if c is not gap]


def expand_names(names: Mapping) -> dict[str, str]:
    """Write out templates: {("flag_{i}", range(1, 4)): "F{i}"} gives flag_1 → F1, …"""
    out: dict[str, str] = {}
    for key, short in names.items():
        if isinstance(key, tuple):
            template, values = key
            out |= {template.format(i=v): short.format(i=v) for v in values}
        else:
            out[key] = short
    return out


def safe_names(columns: Sequence[str]) -> list[str]:
    """Names of word characters only, different even without regard to case.

    A name that is taken gets the first free suffix _2, _3, …; an empty one is `column`.
    """
    given: set[str] = set()
    out = []
    for name in columns:
        clean = re.sub(r"\W+", "_", name).strip("_") or "column"
        tries = (clean if i == 1 else f"{clean}_{i}" for i in count(1))
        out.append(next(t for t in tries if t.lower() not in given))
        given.add(out[-1].lower())
    return out


def derive(df: DataFrame, text: str) -> DataFrame:
    """Add columns from lines `name = expression`; later lines may use earlier names.

    Expressions are Spark SQL; `@where(cond, a, b)` is accepted for a conditional.
    """
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if line:
            name, expression = line.split("=", 1)
            df = df.withColumn(name.strip(), F.expr(expression.replace("@where(", "if(")))
    return df


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, n, n_unique) for each column, in one aggregation."""
    columns = list(columns or df.columns)
    stats = df.agg(
        *[
            F.struct(F.count(c).alias("n"), F.count_distinct(c).alias("n_unique"), F.count("*").alias("rows")).alias(c)
            for c in columns
        ]
    )
    return stats.unpivot([], columns, "column_name", "s").select("column_name", "s.*")


def categorical_columns(df: DataFrame, kind: str | None = None, max_modalities: int | None = None) -> DataFrame:
    """Columns picked by type and/or by number of distinct values."""
    columns = [c for c, k in df.dtypes if kind is None or k == kind]
    counts = distinct_counts(df, columns).select("column_name", "n_unique")
    return counts if max_modalities is None else counts.filter(F.col("n_unique") <= max_modalities)


def feature_roles(df: DataFrame, threshold: int) -> DataFrame:
    """Role of each column: key (all values distinct), categorical (few), numeric (rest)."""
    return distinct_counts(df).select(
        "column_name",
        "n_unique",
        F.when(F.col("n_unique") == F.col("rows"), "key")
        .when(F.col("n_unique") <= threshold, "categorical")
        .otherwise("numeric")
        .alias("role"),
    )


def drop_flagged(df: DataFrame, letter_flag: str, number_flag: str) -> DataFrame:
    """Drop rows with letter flag N or number flag 0; unknown flags are kept."""
    flagged = F.coalesce(F.col(letter_flag) == "N", F.lit(False)) | F.coalesce(
        F.col(number_flag) == 0, F.lit(False)
    )
    return df.filter(~flagged)


def drop_category(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(~F.col(column).eqNullSafe(value))


def align_columns(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    common = [c for c in left.columns if c in right.columns]
    return left.select(*common), right.select(*common)


def align_rows(df: DataFrame, reference: DataFrame, key: str, position: str = "position") -> DataFrame:
    """Rows of `df` for the keys of `reference`, with the position they have there."""
    return reference.select(key, position).join(df, key)


def composite_key(df: DataFrame, keys: Sequence[str], name: str = "key", sep: str = "-") -> DataFrame:
    return df.withColumn(name, F.concat_ws(sep, *keys))


def name_words(df: DataFrame, column: str, words: int = 5, sep: str = "_") -> DataFrame:
    """Split names into word_0 … word_{n-1}; missing words are NULL."""
    parts = F.split(F.col(column), sep)
    return df.withColumns({f"word_{i}": F.get(parts, F.lit(i)) for i in range(words)})


def categories_of(df: DataFrame, column: str) -> list:
    """Sorted distinct values. Each becomes a column, so a plan can only hold so many: pass
    the wanted ones, or reduce the long tail first, where there are very many."""
    return sorted(r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().collect())


def one_hot(
    df: DataFrame,
    columns: Sequence[str],
    categories: Mapping[str, Sequence] | None = None,
    dummy_na: bool = True,
    drop_first: bool = False,
    drop_constant: bool = True,
) -> DataFrame:
    """Replace category columns by 0/1 columns in sorted category order."""
    dummies: dict[str, Column] = {}
    for c in columns:
        values = list((categories or {}).get(c) or categories_of(df, c))
        for v in values[1:] if drop_first else values:
            dummies[f"{c}_{v}"] = F.when(F.col(c).eqNullSafe(v), 1).otherwise(0)
        if dummy_na:
            dummies[f"{c}_nan"] = F.when(F.col(c).isNull(), 1).otherwise(0)
    names = safe_names(list(dummies))
    encoded = df.select(
        *[c for c in df.columns if c not in columns],
        *[expr.alias(n) for n, expr in zip(names, dummies.values())],
    )
    if drop_constant:
        spans = encoded.agg(*[(F.max(n) != F.min(n)).alias(n) for n in names]).first()
        encoded = encoded.drop(*[n for n in names if not spans[n]])
    return encoded


def factorize(df: DataFrame, column: str, name: str, first_seen: str | None = None) -> DataFrame:
    """Integer codes from 0: by sorted category, or by first appearance along `first_seen`.

    Missing values get -1. Codes come from the distinct categories only.
    """
    known = df.filter(F.col(column).isNotNull())
    if first_seen:
        cats = known.groupBy(column).agg(F.min(first_seen).alias("_order"))
        order = [F.col("_order"), F.col(column)]
    else:
        cats = known.select(column).distinct()
        order = [F.col(column)]
    codes = ordered_prefix(cats, order, {name: F.lit(1)}).select(column, (F.col(name) - 1).alias(name))
    return df.join(codes, column, "left").withColumn(name, F.coalesce(name, F.lit(-1).cast("long")))


def compact_types(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Narrow columns where the content allows it without loss; keys stay as they are.

    Integers that are only 0 or 1 become booleans, other integers the smallest type that
    holds their range, doubles become floats if every value survives the cast.
    """
    checks: dict[str, Column] = {}
    for c, kind in df.dtypes:
        if c in keys:
            continue
        if kind in ("smallint", "int", "bigint"):
            checks[c] = F.struct(F.min(c).alias("low"), F.max(c).alias("high"))
        elif kind == "double":
            checks[c] = F.struct(
                F.bool_and(F.col(c).cast("float").cast("double").eqNullSafe(F.col(c))).alias("exact")
            )
    if not checks:
        return df
    found = df.agg(*[expr.alias(c) for c, expr in checks.items()]).first()
    out = []
    for c in df.columns:
        target = None
        if c in checks:
            stat = found[c].asDict()
            if stat.get("exact"):
                target = "float"
            elif stat.get("low") is not None:
                if stat["low"] >= 0 and stat["high"] <= 1:
                    target = "boolean"
                else:
                    target = next(
                        (t for t, bits in (("tinyint", 7), ("smallint", 15), ("int", 31))
                         if -(2**bits) <= stat["low"] and stat["high"] < 2**bits),
                        None,
                    )
        out.append(F.col(c).cast(target).alias(c) if target else F.col(c))
    return df.select(*out)


def null_rates(df: DataFrame) -> dict[str, float]:
    row = df.agg(
        F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in df.columns]
    ).first()
    total = row["_rows"]
    return {c: 1 - row[c] / total if total else 0.0 for c in df.columns}


def drop_sparse(left: DataFrame, right: DataFrame, percent: float) -> tuple[DataFrame, DataFrame]:
    """Drop the columns missing in more than `percent` of the rows of either frame."""
    rates = [null_rates(left), null_rates(right)]
    bad = {c for r in rates for c, rate in r.items() if rate * 100 > percent}
    return left.drop(*bad), right.drop(*bad)


def correlations(df: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], float | None]:
    """Pearson correlation of each pair, one aggregation over the rows.

    With n, Σx, Σy, Σx², Σxy the pairs share their sums; `corr` itself is used because it
    is computed stably and combines map-side.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    out: dict[tuple[str, str], float | None] = {}
    for start in range(0, len(pairs), 300):
        part = pairs[start:start + 300]
        row = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(part)]).first()
        out |= {pair: row[f"r{i}"] for i, pair in enumerate(part)}
    return out


def drop_collinear(df: DataFrame, columns: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """Of each pair correlated above the threshold keep only the earlier column."""
    found = correlations(df, columns)
    bad = {b for (a, b), r in found.items() if r is not None and r > threshold}
    return df.drop(*bad)


def drop_duplicate_columns(df: DataFrame, row_key: Sequence[str]) -> DataFrame:
    """Drop columns whose content equals that of an earlier column.

    Columns are compared by the sums of two independent hashes of (row, value), and by
    their known values; sums do not cancel where row keys repeat. No column is collected.
    """
    columns = [c for c in df.columns if c not in row_key]
    hashed = {c: F.xxhash64(*row_key, F.coalesce(F.col(c).cast("string"), F.lit("\0"))) for c in columns}
    row = df.agg(
        *[
            F.struct(
                F.sum(h.cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64(F.lit(1), h, c).cast("decimal(38,0)")).alias("y"),
                F.count(c).alias("n"),
            ).alias(c)
            for c, h in hashed.items()
        ]
    ).first()
    seen: set = set()
    bad = []
    for c in columns:
        signature = tuple(row[c])
        if signature in seen:
            bad.append(c)
        seen.add(signature)
    return df.drop(*bad)


def polynomial_features(df: DataFrame, columns: Sequence[str], degree: int) -> DataFrame:
    """All products of the columns up to `degree`, named by their factors."""
    terms: list[tuple[str, ...]] = [()]
    frontier: list[tuple[str, ...]] = [()]
    for _ in range(degree):
        frontier = [t + (c,) for t in frontier for c in columns if not t or columns.index(c) >= columns.index(t[-1])]
        terms += frontier
    products = []
    for term in terms[1:]:
        product = F.col(term[0])
        for c in term[1:]:
            product = product * F.col(c)
        products.append(product.alias("_x_".join(term)))
    return df.select(*[c for c in df.columns if c not in columns], F.lit(1.0).alias("one"), *products)


def equal_width_bins(df: DataFrame, column: str, bins: int, name: str = "bin", decimals: int | None = None) -> DataFrame:
    """1-based right-closed bins of equal width between min and max; the minimum is in bin 1.

    Min and max are one row, joined by broadcast.
    """
    span = df.agg(F.min(column).cast("double").alias("_low"), F.max(column).cast("double").alias("_high"))
    position = (F.col(column) - F.col("_low")) / F.nullif((F.col("_high") - F.col("_low")), F.lit(0.0)) * bins
    if decimals is not None:
        position = F.round(position, decimals)
    code = F.greatest(F.ceil(position), F.lit(1).cast("long"))
    return (
        df.transform(with_row, span)
        .withColumn(name, F.when(F.col(column).isNotNull(), F.coalesce(code, F.lit(1).cast("long"))))
        .drop("_low", "_high")
    )


def edge_bins(column: str, edges: Sequence[float], include_lowest: bool = True) -> Column:
    """1-based right-closed bin between sorted edges; outside values are NULL."""
    c = F.col(column)
    low = c >= edges[0] if include_lowest else c > edges[0]
    out = None
    for i, high in enumerate(edges[1:], start=1):
        cond = low & (c <= high)
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return out.cast("long")
