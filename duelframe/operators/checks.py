"""Data-quality checks. Each returns the violating rows; `raise_if_any` turns them into an error."""

from functools import reduce

from pyspark.sql import DataFrame, Observation, functions as F

from .aggs import mark_duplicates


class CheckFailed(ValueError):
    pass


def raise_if_any(violations: DataFrame, message="check failed", show=5) -> None:
    rows = violations.limit(show).collect()
    if rows:
        raise CheckFailed(f"{message}: {rows}")


def _counts(df, keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def exactly_n_per_key(df: DataFrame, keys, n=2) -> DataFrame:
    return _counts(df, keys).where(F.col("n") != n)


def at_most_n_per_key(df: DataFrame, keys, n) -> DataFrame:
    return _counts(df, keys).where(F.col("n") > n)


def row_count_preserved(before: DataFrame, after: DataFrame) -> DataFrame:
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    both = count(before, "n_before").withColumn("n_after", count(after, "n_after").scalar())
    return both.where("n_before <> n_after")


def no_nulls(df: DataFrame, cols) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in cols]))
    return counts.select(entries.alias("e")).select("e.column", "e.n_null").where("n_null > 0")


def functional_dependency(df: DataFrame, lhs, rhs) -> DataFrame:
    """Left-hand keys with more than one right-hand value."""
    return df.groupBy(*lhs).agg(F.count_distinct(*rhs).alias("n_values")).where("n_values > 1")


def not_all_null(df: DataFrame, cols) -> DataFrame:
    return df.where(reduce(lambda x, y: x & y, [F.col(c).isNull() for c in cols]))


def duplicates_explained(df: DataFrame, keys, flag) -> DataFrame:
    """Members of duplicated keys that the flag does not account for."""
    return mark_duplicates(df, keys, "_dup").where(F.col("_dup") & ~F.coalesce(F.col(flag), F.lit(False))).drop("_dup")


def cardinality_agreement(a: DataFrame, b: DataFrame, key) -> DataFrame:
    count = lambda df, name: df.agg(F.count_distinct(key).alias(name))
    return count(a, "n_a").withColumn("n_b", count(b, "n_b").scalar()).where("n_a <> n_b")


class RowsChanged(RuntimeError):
    """A lookup multiplied or dropped rows."""


class RowCounts:
    """Counts rows before and after lookups inside the job that runs them (observed metrics: no pass of their own, and no
    change of the plan). `verify`, after that job, raises for a lookup that did not keep its rows, which is one whose
    right side repeats a key."""

    def __init__(self):
        self._counted = []

    def _observe(self, df, observation):
        return df.observe(observation, F.count(F.lit(1)).alias("n"))

    def around(self, df: DataFrame, lookup, name="lookup") -> DataFrame:
        """`lookup(df)` with both counts observed."""
        before, after = Observation(), Observation()
        self._counted.append((name, before, after))
        return self._observe(lookup(self._observe(df, before)), after)

    def verify(self) -> dict:
        """{name: rows}."""
        found = {name: (before.get["n"], after.get["n"]) for name, before, after in self._counted}
        wrong = {name: n for name, n in found.items() if n[0] != n[1]}
        if wrong:
            raise RowsChanged(", ".join(f"{name}: {a} rows became {b}" for name, (a, b) in wrong.items()))
        return {name: n for name, (n, _) in found.items()}
