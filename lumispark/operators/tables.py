"""Operators on tables of any content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumispark.operators.selection import ranked_values


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Equi-join on all columns the two have in common."""
    shared = [c for c in left.columns if c in set(right.columns)]
    if not shared:
        raise ValueError("no column in common")
    return left.join(right, shared, how)


#: Rows of the right table in a part of with_and_without.
PART_ROWS = 1 << 20


def with_and_without(left: DataFrame, right: DataFrame, key: str, side: str, present: str, absent: str) -> DataFrame:
    """left with a column that says whether its key occurs in right (key); a null key doesn't.

    Both answers come from one merge join with the different keys, in parts whose number follows the rows
    of the larger table, so what a task holds doesn't grow with them, and no table is held for a broadcast."""
    keys = right.select(key).filter(F.col(key).isNotNull())
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-max(left.count(), keys.count()) // PART_ROWS))
    known = keys.repartition(parts, key).distinct().withColumn(side, F.lit(present))
    met = left.repartition(parts, key).join(known.hint("merge"), key, "left")
    return met.select(*left.columns, F.coalesce(F.col(side), F.lit(absent)).alias(side))


def union_all(*parts: DataFrame) -> DataFrame:
    """Rows of all parts by column name; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def factorize(df: DataFrame, column: str, code: str) -> DataFrame:
    """Adds the rank of the column's value among its distinct values, from 0; null for null."""
    codes = ranked_values(df, column, code).withColumn(code, F.col(code).cast("int"))
    return df.join(codes, column, "left").select(*df.columns, code)


def differs(column: Column, value: object) -> Column:
    """column <> value, with null counted as different."""
    return ~column.eqNullSafe(F.lit(value))


def fixed_sample(df: DataFrame, keys: list[str], many: int, seed: int = 0) -> DataFrame:
    """`many` rows without replacement, the same ones each time: the first by digest of their keys."""
    name = F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed)))
    return df.orderBy(F.md5(name), *keys).limit(many)


def matched_once(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of two file lists on a key: the first path of each key on either side.

    Raises if a key of either side has no partner. Both lists are of files, one row each."""
    one_left, one_right = (first_rows(d, [key], [F.col(c) for c in d.columns if c != key]) for d in (left, right))
    alone = one_left.join(one_right, key, "left_anti").select(key).unionByName(one_right.join(one_left, key, "left_anti").select(key)).limit(5).collect()
    if alone:
        raise ValueError(f"no partner for {[r[0] for r in alone]}")
    return one_left.join(one_right, key)


def file_key(name: Column) -> Column:
    """One normalised form of a file name: base name, lower case, + spelt out, tokens 2 to the last but two."""
    base = F.lower(F.element_at(F.split(name, "[/\\\\]"), -1))
    tokens = F.split(F.replace(base, F.lit("+"), F.lit("plus")), "_")
    return F.array_join(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 3, F.lit(0))), "_")
