"""Parsers for messy text columns. Every function maps Columns to a Column and never raises on bad text."""

from pyspark.sql import Column, functions as F

# Outcome rules of the detailed method classifier.
KO_EXACT = ["tko/ko", "ko/tko", "ko", "submission (punches)", "submission (slam)"]
UNANIMOUS_EXACT = ["decision - unanimous", "unanimous decision", "decision"]
SPLIT_EXACT = ["split decision", "decision - split", "majority decision", "decision - majority"]
# Round formats that carry no list of lengths.
UNLIMITED_DEFAULT_MINUTES = "15"
UNLIMITED_ROUNDS = 50
NO_LIMIT_MINUTES = 999999


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit_split(c, sep):
    return F.split(c, r"\Q" + sep + r"\E")


def parse_x_of_y(c, sep="of") -> Column:
    """`10 of 20` -> struct(landed, attempted)."""
    parts = _lit_split(_c(c), sep)
    return F.struct(
        F.trim(F.get(parts, F.lit(0))).try_cast("int").alias("landed"),
        F.trim(F.get(parts, F.lit(1))).try_cast("int").alias("attempted"),
    )


def mmss_to_seconds(c, default=None) -> Column:
    parts = F.split(_c(c), ":")
    minutes = F.trim(F.get(parts, F.lit(0))).try_cast("int")
    seconds = F.trim(F.get(parts, F.lit(1))).try_cast("int")
    return F.when(F.contains(_c(c), F.lit(":")), minutes * 60 + seconds).otherwise(F.lit(default).cast("int"))


def id_from_url(c, marker, stop="/") -> Column:
    """Text after `marker` up to the next `stop`; null where the marker is absent."""
    after = F.get(_lit_split(_c(c), marker), F.lit(1))
    return F.get(_lit_split(after, stop), F.lit(0)) if stop else after


def dash_to_null(c) -> Column:
    return F.nullif(F.trim(_c(c)), F.lit("-")).try_cast("double")


def _number(c, pattern):
    return F.nullif(F.trim(F.regexp_extract(c, pattern, 1)), F.lit("")).try_cast("double")


def feet_inches(c, fallback=None) -> Column:
    """`5' 11"` -> 71; the fallback column is used where the first one does not parse."""
    total = _number(_c(c), "^([^']*)'") * 12 + _number(_c(c), "'(.*?)\"")
    return total if fallback is None else F.coalesce(total, feet_inches(fallback))


def weight_lbs(c) -> Column:
    return _number(_c(c), ",(.*?) lbs")


def reach_inches(c) -> Column:
    return F.nullif(F.regexp_replace(F.trim(_c(c)), '"$', ""), F.lit("")).try_cast("double")


def strip_arrows(c) -> Column:
    """Price text with movement arrows -> double."""
    return F.trim(F.translate(_c(c), "▲▼", "")).try_cast("double")


def classify_method(c, result) -> Column:
    """struct(outcome, sub_method). The last rule that applies wins, so the strongest rule is tested first."""
    raw = F.coalesce(F.lower(_c(c)), F.lit(""))
    is_sub = F.contains(raw, F.lit("submission")) | F.contains(raw, F.lit("sumission"))
    is_ko = F.startswith(raw, F.lit("ko (")) | F.startswith(raw, F.lit("tko")) | raw.isin(KO_EXACT)
    outcome = (
        F.when(F.contains(raw, F.lit("no contest")), "nc")
        .when(F.contains(raw, F.lit("dq")), "dq")
        .when(F.coalesce(_c(result) == "D", F.lit(False)), "draw")
        .when(F.startswith(raw, F.lit("technical decision")), "technical decision")
        .when(raw.isin(SPLIT_EXACT), "decision - split")
        .when(raw.isin(UNANIMOUS_EXACT), "decision - unanimous")
        .when(is_ko, "tko/ko")
        .when(is_sub, "submission")
        .otherwise("")
    )
    inside = F.coalesce(F.get(_lit_split(_c(c), "("), F.lit(1)), F.lit(""))
    return F.struct(outcome.alias("outcome"), F.when(is_sub, inside).otherwise("").alias("sub_method"))


def classify_method_v2(c) -> Column:
    """Four classes, the first rule that applies wins."""
    raw = F.trim(F.lower(F.coalesce(_c(c), F.lit("-"))))
    starts = lambda *heads: F.expr("false") if not heads else _any([F.startswith(raw, F.lit(h)) for h in heads])
    return (
        F.when(starts("submission", "sumission", "technical submission"), "submission")
        .when(starts("tko", "ko") | (raw == "could not continue"), "tko_ko")
        .when(F.contains(raw, F.lit("decision")), "decision")
        .otherwise("other")
    )


def _any(conditions):
    out = conditions[0]
    for condition in conditions[1:]:
        out = out | condition
    return out


def promotion_name(c, flag="ufc") -> Column:
    """struct(name, flagged): event title before `:` and `- `, without trailing digits."""
    title = F.trim(F.lower(F.coalesce(_c(c), F.lit(""))))
    head = F.trim(F.split_part(F.split_part(title, F.lit(":"), F.lit(1)), F.lit("- "), F.lit(1)))
    name = F.regexp_replace(head, "[0-9]+$", "")
    return F.struct(name.alias("name"), F.contains(name, F.lit(flag)).alias("flagged"))


def name_pair_split(c) -> Column:
    parts = F.split(_c(c), "  ")
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("side"), F.trim(F.get(parts, F.lit(1))).alias("opp"))


def contains_flag(c, s) -> Column:
    return F.contains(F.lower(F.trim(_c(c))), F.lit(s.lower())).cast("int")


def stance_clean(c) -> Column:
    stance = F.lower(F.trim(_c(c)))
    return F.when(stance.isin("southpaw", "switch"), stance).otherwise("orthodox")


def round_format_minutes(c) -> Column:
    """`3 Rnd (5-5-5)` -> [5, 5, 5]."""
    text = F.lower(F.trim(_c(c)))
    text = (
        F.when(text == "unlimited rnd", F.lit(f"unlimited rnd ({UNLIMITED_DEFAULT_MINUTES})"))
        .when(text == "no time limit", F.lit(f"1 round ({NO_LIMIT_MINUTES})"))
        .otherwise(text)
    )
    inside = F.nullif(F.regexp_extract(text, r"\(([^)]*)\)", 1), F.lit(""))
    lengths = F.transform(F.split(inside, "-"), lambda x: F.trim(x).try_cast("int"))
    repeated = F.array_repeat(F.trim(inside).try_cast("int"), UNLIMITED_ROUNDS)
    return F.when(F.startswith(text, F.lit("unlimited rnd")), repeated).otherwise(lengths)


def key_value_text(c, positions: dict, sep="\n") -> Column:
    """Fields at fixed positions of a separated text -> struct, blanks trimmed."""
    parts = _lit_split(_c(c), sep)
    return F.struct(*[F.trim(F.get(parts, F.lit(i))).alias(name) for name, i in positions.items()])


def prefixed_values(c, prefixes: dict, sep="\n") -> Column:
    """For each name, the text that follows its prefix in the first line starting with that prefix."""
    lines = F.transform(_lit_split(_c(c), sep), lambda x: F.trim(x))

    def value(prefix):
        hit = F.get(F.filter(lines, lambda x: F.startswith(x, F.lit(prefix))), F.lit(0))
        return F.trim(F.substring(hit, len(prefix) + 1, 1_000_000_000))

    return F.struct(*[value(prefix).alias(name) for name, prefix in prefixes.items()])


def suffix_flag(c, s) -> Column:
    return F.endswith(F.coalesce(_c(c), F.lit("")), F.lit(s))
