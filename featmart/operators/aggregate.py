"""Child-to-parent aggregation with named rules, subsets, and two-level roll-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmart.functions.scalars import STATUS_ORDER
from featmart.operators.columns import categories_of, numeric_columns, safe_names
from featmart.operators.keys import join_parts
from featmart.operators.ordering import ordered_prefix

Rules = Mapping[str, Sequence[str]]
VAR_DECIMALS = 1


def statistic(name: str, value: Column, row: Column) -> Column:
    """One named statistic; `row` is 1 for the rows that belong to the subset."""
    return {
        "min": lambda: F.min(value),
        "max": lambda: F.max(value),
        "mean": lambda: F.avg(value),
        "sum": lambda: F.sum(value),
        "var": lambda: F.var_samp(value),
        "size": lambda: F.count(row),
        "count": lambda: F.count(value),
        "nunique": lambda: F.count_distinct(value),
    }[name]()


def rule_columns(rules: Rules, prefix: str, where: Column | None = None, decimals: int | None = None) -> list[Column]:
    """Aggregates named prefix_column_stat; with `where`, over the rows that satisfy it only.

    With `decimals`, sums are rounded and means taken from them, so that results repeat
    exactly whatever the order in which partitions are added up.
    """
    out = []
    for column, stats in rules.items():
        value = F.col(column) if where is None else F.when(where, F.col(column))
        row = F.lit(1) if where is None else F.when(where, 1)
        for name in stats:
            if decimals is None or name not in ("mean", "sum", "var"):
                expr = statistic(name, value, row)
            elif name == "mean":
                # The rounded sum does not depend on the order of addition, so neither does the mean.
                expr = F.try_divide(F.round(F.sum(value), decimals), F.count(value))
            else:
                expr = F.round(statistic(name, value, row), decimals if name == "sum" else VAR_DECIMALS)
            out.append(expr.alias(f"{prefix}_{column}_{name}".lower()))
    return out


def rule_agg(df: DataFrame, keys: Sequence[str], rules: Rules, prefix: str, decimals: int | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(*rule_columns(rules, prefix, decimals=decimals))


def subset_agg(
    df: DataFrame, keys: Sequence[str], rules: Rules, prefix: str, subsets: Mapping[str, tuple[Column, Rules]],
    decimals: int | None = None,
) -> DataFrame:
    """Aggregates of all rows and of each subset side by side, in one grouping."""
    columns = rule_columns(rules, prefix, decimals=decimals)
    for name, (where, subset_rules) in subsets.items():
        columns += rule_columns(subset_rules, name, where, decimals)
    return df.groupBy(*keys).agg(*columns)


def agg_numeric(df: DataFrame, key: str, name: str, ignore: Sequence[str] = (), decimals: int | None = None) -> DataFrame:
    """count, mean, max, min and sum of every numeric column except other ids."""
    columns = numeric_columns(df, {key, *ignore})
    rules = {c: ("count", "mean", "max", "min", "sum") for c in columns}
    return rule_agg(df, [key], rules, name, decimals)


def agg_all_stats(df: DataFrame, key: str, name: str, ignore: Sequence[str] = (), decimals: int | None = None) -> DataFrame:
    """min, max, mean, sum and variance of every numeric column, and the row count."""
    rules = {c: ("min", "max", "mean", "sum", "var") for c in numeric_columns(df, {key, *ignore})}
    return df.groupBy(key).agg(*rule_columns(rules, name, decimals=decimals), F.count("*").alias(f"{name}_count"))


def agg_categorical(
    df: DataFrame, key: str, columns: Sequence[str], name: str, categories: Mapping[str, Sequence] | None = None
) -> DataFrame:
    """Per category: number of rows, and share of the parent's rows."""
    aggs = []
    for c in columns:
        values = (categories or {}).get(c) or categories_of(df, c)
        for v, label in zip(values, safe_names([str(v) for v in values])):
            hits = F.count_if(F.col(c) == v)
            aggs.append(hits.alias(f"{name}_{c}_{label}_count".lower()))
            aggs.append((hits / F.count("*")).alias(f"{name}_{c}_{label}_norm".lower()))
    return df.groupBy(key).agg(*aggs)


def dummy_means(df: DataFrame, column: str, prefix: str, categories: Sequence | None = None) -> list[Column]:
    """Mean of each category's 0/1 column, as aggregates."""
    values = categories or categories_of(df, column)
    labels = safe_names([str(v) for v in values])
    return [
        F.avg(F.when(F.col(column) == v, 1.0).otherwise(0.0)).alias(f"{prefix}_{column}_{label}_mean".lower())
        for v, label in zip(values, labels)
    ]


def two_level(
    child: DataFrame, loan_key: str, client_key: str, name: str, numeric_ignore: Sequence[str] = (),
    category: str | None = None, decimals: int | None = None,
) -> DataFrame:
    """Child rows → loan → client: numeric statistics and category counts of each loan, then of each client."""
    pairs = child.select(loan_key, client_key).distinct()
    numbers = agg_numeric(child.drop(client_key), loan_key, name, numeric_ignore)
    parts = [numbers]
    if category:
        parts.append(agg_categorical(child, loan_key, [category], name))
    by_loan = join_parts(pairs, parts, loan_key)
    return agg_numeric(by_loan.drop(loan_key), client_key, "client", decimals=decimals)


def client_pivot_agg(
    df: DataFrame,
    pivot: str,
    aggs: Sequence[Column],
    client_key: str = "client_id",
    loan_key: str = "loan_id",
    status: str | None = None,
    statuses: Sequence[str] | None = None,
    include_uniques: bool = True,
    columns: Sequence[str] = (),
) -> DataFrame:
    """Group several loans of a client by a pivot (month or instalment number), counting rows.

    `status` is reduced to the most telling one of the group; `statuses` lists its values,
    otherwise they are looked up. With `include_uniques=False`
    the rows of clients that have one loan only pass through ungrouped, as n_prev = 1.
    """
    grouped_aggs = [F.count("*").alias("n_prev"), *aggs]
    if status:
        grouped_aggs.append(combined_status(status, statuses or categories_of(df, status)).alias(status))
    if include_uniques:
        return df.groupBy(client_key, pivot).agg(*grouped_aggs)
    loans = df.groupBy(client_key).agg((F.min(loan_key) == F.max(loan_key)).alias("_single"))
    marked = df.join(loans, client_key)
    grouped = marked.filter(~F.col("_single")).groupBy(client_key, pivot).agg(*grouped_aggs)
    single = marked.filter("_single").select(
        client_key, pivot, F.lit(1).cast("long").alias("n_prev"), *columns, *([status] if status else [])
    )
    return grouped.unionByName(single)


def combined_status(status: str, known: Sequence[str], order: Sequence[str] = STATUS_ORDER) -> Column:
    """Most telling status of a group; without one, its other statuses joined in order.

    One boolean per known status is all the aggregate keeps, so it hashes and combines
    map-side whatever the size of the group.
    """
    others = [s for s in sorted(known) if not any(name in s for name in order)]
    text = F.concat_ws("", *[F.when(F.bool_or(F.col(status) == s), F.lit(s)) for s in others])
    out = F.when(text != "", text)
    for name in reversed(order):
        out = F.when(F.bool_or(F.col(status).contains(name)), F.lit(name)).otherwise(out)
    return out


def region_table(
    client: DataFrame, region: str, label: str, rating: str, ratings: Sequence, flags: Mapping[str, Column]
) -> DataFrame:
    """One row per region: clients, labels, ratings and flags, numbered by size."""
    grouped = client.groupBy(region).agg(
        F.count("*").alias("clients"),
        *[F.count_if(F.col(label) == v).alias(f"label_{n}") for v, n in ((-1, "unknown"), (0, "repaid"), (1, "default"))],
        *[F.count_if(F.col(rating) == r).alias(f"{rating}_{r}".lower()) for r in ratings],
        *[F.count_if(expr).alias(name) for name, expr in flags.items()],
    )
    order = [F.col("clients").desc(), F.col(region)]
    return ordered_prefix(grouped, order, {"region_id": F.lit(1)})


def label_share(regions: DataFrame, region: str) -> DataFrame:
    """Share of defaults among labelled clients, most defaulting region first."""
    known = F.col("label_repaid") + F.col("label_default")
    return regions.select(
        region, F.try_divide("label_default", known).alias("default_share")
    ).orderBy(F.desc("default_share"), region)


def bridge(left: DataFrame, middle: DataFrame, right: DataFrame, on_left: str, on_right: str,
           columns: Sequence[str]) -> DataFrame:
    """Distinct pairs of two entities linked through a middle table."""
    return middle.join(left, on_left).join(right, on_right).select(*columns).distinct()


def category_profile(df: DataFrame, key: str, column: str, categories: Sequence | None = None,
                     normalize: bool = False) -> DataFrame:
    """Rows per category for each key, as counts or as shares of the key's rows."""
    values = categories or categories_of(df, column)
    labels = safe_names([str(v) for v in values])
    size = F.count("*")
    cells = [F.count_if(F.col(column) == v) for v in values]
    return df.groupBy(key).agg(
        size.alias("size"),
        *[(cell / size if normalize else cell).alias(f"{column}_{n}".lower()) for cell, n in zip(cells, labels)],
    )


ACCOUNT_SUMS = ("balance", "drawn", "receivable", "payment")


def account_sums(account: DataFrame, decimals: int = 4) -> DataFrame:
    """Months and summed amounts per loan and client."""
    return account.groupBy("loan_id", "client_id").agg(
        F.count("month").alias("n_months"),
        *[F.round(F.sum(c), decimals).alias(f"sum_{c}") for c in ACCOUNT_SUMS],
    )


def null_accounts(sums: DataFrame) -> DataFrame:
    """Accounts on which nothing ever happened."""
    return sums.filter((F.col("sum_balance") == 0) & (F.col("sum_drawn") == 0) & (F.col("sum_payment") == 0))


def unbalanced_accounts(sums: DataFrame, balance: str = "sum_balance") -> DataFrame:
    """Accounts without a balance that were drawn on or paid nevertheless."""
    return sums.filter((F.col(balance) == 0) & ~((F.col("sum_drawn") == 0) & (F.col("sum_payment") == 0)))


def first_last(df: DataFrame, keys: Sequence[str], order: str, column: str) -> DataFrame:
    """Oldest and newest value per key and the movement between; larger order = older."""
    first, last = F.max_by(column, order), F.min_by(column, order)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_months"), first.alias("first"), last.alias("last"),
        F.round(last - first, 4).alias("movement"),
    )


def value_count_map(df: DataFrame, keys: Sequence[str], column: str, name: str = "counts") -> DataFrame:
    """Map value → count per group. Values are counted before they are gathered, so a
    group of any size contributes one entry per distinct value."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    return counted.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "_n")))).alias(name),
        F.count("*").alias("n_distinct"),
    )


def map_text(column: str) -> Column:
    return F.concat_ws(",", F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit(":"), e["value"])))
