"""Grouping operators: ordered lists, first rows, runs, top rows, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlume.sources.staging import staged


def ordered_concat(value: str, *order: str, separator: str = "|", unique: bool = False) -> Column:
    """Aggregate: a group's values in order, joined; with unique, each value where it first stands."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value].cast("string"))
    return F.array_join(F.array_distinct(items) if unique else items, separator)


def max_abs(value: str) -> Column:
    return F.max(F.abs(F.col(value)))


def first_max(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """The row with the greatest value of each group, of several the one with the least tie column (a whole number)."""
    best = F.max_by(F.struct(*df.columns), F.struct(F.col(value), -F.col(tie))).alias("_row")
    return df.groupBy(*keys).agg(best).select("_row.*")


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def run_ids(df: DataFrame, keys: list[str], order: list, value: str, name: str = "run_id") -> DataFrame:
    """Numbers the runs of equal values within each group, from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_changed", changed).withColumn(name, F.sum("_changed").over(w)).drop("_changed")


def conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Groups whose values differ."""
    return df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high")).where("low != high")


def single_value(value: str, tolerance: float = 0.0) -> Column:
    """Aggregate: a group's only value; an error where values differ by more than the tolerance."""
    low, high = F.min(value), F.max(value)
    return F.when(high - low <= tolerance, low).otherwise(F.raise_error(F.lit(f"conflicting values of {value}")))


def coverage_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: (key, side). As EXCEPT has it, a null is a key that both sides may have. One
    aggregate of both sides, and no join that sorts either."""
    sides = left.select(key, F.lit(1).alias("_side")).unionByName(right.select(key, F.lit(2).alias("_side")))
    met = sides.groupBy(key).agg(F.bit_or("_side").alias("_side")).where("_side < 3")
    return met.select(key, F.when(F.col("_side") == 1, "left").otherwise("right").alias("side"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def left_joined(base: DataFrame, tables: list[DataFrame], key: str) -> DataFrame:
    """Feature assembly: base with every table joined to it by key, and all new columns as double."""
    out = base
    for t in tables:
        out = out.join(t.select(key, *(F.col(c).cast("double").alias(c) for c in t.columns if c != key)), key, "left")
    return out


def aligned(df: DataFrame, names: list[str], key: str) -> DataFrame:
    """The key and these columns in this order; missing ones are null."""
    return df.select(key, *((F.col(n) if n in df.columns else F.lit(None)).cast("double").alias(n) for n in names))


def prefix_sums(df: DataFrame, keys: list[str], order: list, value: Column, name: str) -> DataFrame:
    """Sum of value over the rows before each one of its group."""
    return carried_sums(df.withColumn("_value", value), keys, order, {name: "_value"}).drop("_value")


def carried_sums(df: DataFrame, keys: list[str], order: list, sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """df with sums of columns (new name: column) over the rows before each one of its group, however large a group is.

    Rows are dealt out by range of (keys, order) and written; what a range adds to a group is summed once and carried
    to the group's later ranges, so a task sorts the rows of one range only. A null adds nothing; null keys are a
    group; the order should be one of whole rows, as equal ones are added up in any order.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "carried")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    each = dealt.groupBy("_part", *keys).agg(*(F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()))
    carry = each.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_carry_{n}") for n in sums))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(carry, same).withColumns({n: F.col(f"_carry_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    return joined.select(*df.columns, *sums)


def numbered(df: DataFrame, order, name: str = "row_id", parts: int | None = None) -> DataFrame:
    """Consecutive row numbers from 0 by a column or a list of columns, without one task that sorts all rows.

    Rows are dealt out by range, written, and numbered within each range; the sizes of the ranges, one number for
    each, give where a range begins.
    """
    spark = df.sparkSession
    order = order if isinstance(order, list) else [order]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    start = F.broadcast(spark.createDataFrame(starts, "_part int, _start long"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.join(start, "_part").withColumn(name, F.col("_start") + inside).drop("_part", "_start")


def pasted(left: DataFrame, right: DataFrame, left_order, right_order, parts: int | None = None) -> DataFrame:
    """Two tables side by side, first row beside first row: (row_id, left's columns, right's columns).

    Each side is numbered by its own order, so no task holds a table; the shorter one's columns are null in the rows
    that only the longer one has. Rows that are equal in the order follow each other in any order. An error where
    both sides have a column of one name.
    """
    both = sorted({c.lower() for c in left.columns} & {c.lower() for c in right.columns} | {"row_id"} & {c.lower() for c in left.columns + right.columns})
    if both:
        raise ValueError(f"pasted tables: rename {', '.join(both)}")
    a, b = (numbered(t, o, parts=parts) for t, o in ((left, left_order), (right, right_order)))
    return a.join(b, "row_id", "full")
