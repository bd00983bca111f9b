"""Sorting, limits and set operations."""

from pyspark.sql import DataFrame, functions as F


def sort_stable(df: DataFrame, cols, key) -> DataFrame:
    """Total order: `key` breaks ties."""
    return df.orderBy(*cols, *([key] if isinstance(key, str) else key))


def top_n(df: DataFrame, cols, n) -> DataFrame:
    return df.orderBy(*cols).limit(n)


def union_all_by_name(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    cols = a.columns
    other = b.toDF(*[f"_b{i}" for i in range(len(cols))])
    same = [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(cols)]
    return a.distinct().join(other, same, "left_anti")


def key_intersection(a: DataFrame, b: DataFrame, key, value) -> DataFrame:
    """Keys present in both maps whose values differ."""
    left = a.select(F.col(key), F.col(value).alias(f"{value}_a"))
    right = b.select(F.col(key), F.col(value).alias(f"{value}_b"))
    return left.join(right, key).where(F.col(f"{value}_a") != F.col(f"{value}_b"))
