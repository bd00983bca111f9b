"""Arrays and nested documents -> rows."""

from pyspark.sql import Column, DataFrame, functions as F

from .text import _c, _lit_split

SNAPSHOT_SCHEMA = (
    "timestamp string, data array<struct<commence_time:string, home_team:string, away_team:string, "
    "bookmakers:array<struct<title:string, markets:array<struct<key:string, "
    "outcomes:array<struct<name:string, price:double>>>>>>>>"
)


def flatten_snapshots(df: DataFrame, col="data", schema=SNAPSHOT_SCHEMA) -> DataFrame:
    """Snapshot text -> one row per (timestamp, contest, bookmaker, market, outcome)."""
    return (
        df.select(F.from_json(F.col(col), schema).alias("s"))
        .select(F.col("s.timestamp").alias("timestamp"), F.explode("s.data").alias("c"))
        .select("timestamp", "c.commence_time", "c.home_team", "c.away_team", F.explode("c.bookmakers").alias("b"))
        .select("timestamp", "commence_time", "home_team", "away_team",
                F.col("b.title").alias("bookmaker_name"), F.explode("b.markets").alias("m"))
        .select("timestamp", "commence_time", "home_team", "away_team", "bookmaker_name",
                F.col("m.key").alias("market_name"), F.explode("m.outcomes").alias("o"))
        .select("timestamp", "commence_time", "home_team", "away_team", "bookmaker_name", "market_name",
                F.col("o.name").alias("outcome_name"), F.col("o.price").alias("price"))
    )


def ordered_names(a, b) -> Column:
    return F.struct(F.least(_c(a), _c(b)).alias("side"), F.greatest(_c(a), _c(b)).alias("opp"))


def prefix_sum_array(arr, n) -> Column:
    return F.aggregate(F.slice(_c(arr), F.lit(1), F.greatest(_c(n), F.lit(0))), F.lit(0), lambda acc, x: acc + x)


def split_sections(df: DataFrame, col, sep="\n## ") -> DataFrame:
    """One row per section behind a separator: the preamble is dropped, the first line is the title."""
    parts = _lit_split(F.col(col), sep)
    others = [c for c in df.columns if c != col]
    sections = df.select(*others, F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("section", "text"))
    return sections.select(
        *others, "section",
        F.substring_index("text", "\n", 1).alias("section_title"),
        F.when(F.contains(F.col("text"), F.lit("\n")),
               F.substring(F.col("text"), F.length(F.substring_index("text", "\n", 1)) + 2, F.length("text"))
               ).otherwise("").alias("section_body"),
    )


def interleave_split(arr) -> Column:
    """Even positions belong to the side, odd ones to the opponent."""
    return F.struct(
        F.filter(_c(arr), lambda x, i: i % 2 == 0).alias("side"),
        F.filter(_c(arr), lambda x, i: i % 2 == 1).alias("opp"),
    )


def round_rows(df: DataFrame, cols, cell_sep="_", round_sep="|") -> DataFrame:
    """Cells hold both sides per round (`a_b|c_d`): one row per side and round."""
    others = [c for c in df.columns if c not in cols]
    zipped = F.arrays_zip(*[_lit_split(F.col(c), round_sep).alias(c) for c in cols])
    rounds = df.select(*others, F.posexplode(zipped).alias("round", "cell"))
    sides = rounds.select(*others, (F.col("round") + 1).alias("round"), "cell", F.explode(F.array(F.lit(0), F.lit(1))).alias("side_no"))
    return sides.select(
        *others, "round", "side_no",
        *[F.get(_lit_split(F.col(f"cell.{c}"), cell_sep), F.col("side_no")).alias(c) for c in cols],
    )
