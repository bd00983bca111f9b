"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Only DataFrame functions. A text's words (lower case, letters and digits) give its five-word shingles; for every length
of template there are windows of as many shingles, one starting at each shingle, so that one of them is aligned with any
occurrence. A window and a template share a band if the least of their shingles in that band's order (a random constant
XORed onto the hashes) is the same. A window that holds the share `containment` of a template of m shingles has at least
the similarity s = x / (2m - x), x = ceil(containment * m), and there are as many bands as make the chance that all miss
at most `miss`; for whole occurrences s is 1 and every band hits. Templates are few and given by the caller; their
bands are a small table in the plan. Nothing is shuffled but the verified matches.

Defined results: null texts and texts of fewer than five words match nothing, as does a template of fewer; rows without a
match are not in the result; ties in containment go to the first word position; repeated rows are one row of the result
if their ids are equal; an empty table gives an empty result; other columns are not read.
"""

import math
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

SHINGLE, CONTAINMENT, MISS = 5, 0.8, 1e-4
# Windows of up to so many shingles are compared as columns.
LANES = 8
# The license statements that are looked for.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
}


def words_of(text: str) -> list:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def bands(shingles: int, containment: float, miss: float) -> int:
    """As many one-row bands as find a window of the least similarity a match can have with probability 1 - miss."""
    x = math.ceil(containment * shingles - 1e-9)
    s = x / (2 * shingles - x)
    return 1 if s >= 1 else math.ceil(math.log(miss) / math.log(1 - s))


def _template_table(spark, templates):
    """(license, shingles: array of hashes), hashed by the same expressions as texts."""
    rows = [(name, words_of(text)) for name, text in sorted(templates.items())]
    table = spark.createDataFrame([r for r in rows if len(r[1]) >= SHINGLE], "license string, words array<string>")
    return table.select("license", _hashes("words").alias("hashes")).select("license", F.array_distinct(_shingles("hashes")).alias("shingles"))


def _positions(values, size=1):
    """Where `size` elements of the array begin."""
    return F.when(F.size(values) >= size, F.sequence(F.lit(0), F.size(values) - size)).otherwise(F.array().cast("array<int>"))


def _shingles(words):
    """Hashes of the five-word shingles of an array of word hashes; fewer words have none."""
    return F.transform(_positions(words, SHINGLE), lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(SHINGLE)]))


def _hashes(words):
    return F.transform(words, lambda w: F.xxhash64(w))


def _order(band: int) -> int:
    """The constant whose XOR orders the hashes of a band."""
    x = (band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x ^= x >> 32
    return x - (1 << 64) if x >> 63 else x


def _retrieval(known, lengths, containment, miss, minimum):
    """(any band hit, names of the retrieved templates); `minimum(m, constant)` is a window's least hash in that order."""
    hit, retrieved = F.lit(False), []
    for m in lengths:
        own = [r for r in known if len(r.shingles) == m]
        for band in range(bands(m, containment, miss)):
            constant = _order(band)
            least: dict = {}
            for r in own:
                least.setdefault(min(h ^ constant for h in r.shingles), []).append(r.license)
            value = minimum(m, constant)
            hit = hit | F.coalesce(value.isin(list(least)), F.lit(False))
            retrieved += [F.when(value == F.lit(v), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")) for v, names in least.items()]
    return hit, F.array_distinct(F.flatten(F.array(*retrieved)))


def _short(rows, known, lengths, containment, miss):
    """Windows of up to LANES shingles: every position becomes a row with the shingles that follow, compared as columns."""
    lanes = [f"s{k}" for k in range(lengths[-1])]
    ahead = F.transform(_positions("s"), lambda i: F.struct(i.alias("at"), *[F.get("s", i + k).alias(lane) for k, lane in enumerate(lanes)]))
    placed = rows.select("id", F.inline(ahead))

    def minimum(m, constant):
        turned = [F.col(lane).bitwiseXOR(F.lit(constant)) for lane in lanes[:m]]
        return turned[0] if m == 1 else F.least(*turned)

    hit, retrieved = _retrieval(known, lengths, containment, miss, minimum)
    return placed.filter(hit).select("id", "at", F.array_compact(F.array(*lanes)).alias("window"), F.explode(retrieved).alias("license"))


def _long(rows, known, lengths, containment, miss):
    """Longer windows: least hashes of all windows by doubling their width; positions that no band hits become no rows."""
    made: dict = {}

    def minima(rows, m, constant):
        """Adds the column of least hashes of the windows of m shingles, the last ones cut short."""
        name = f"m{len(made)}"
        made[m, constant] = name
        rows = rows.withColumn(name, F.transform("s", lambda h: h.bitwiseXOR(F.lit(constant))))
        width = 1
        while width < m:
            step = min(width, m - width)
            rows = rows.withColumn(name, F.zip_with(F.col(name), F.slice(name, F.lit(step + 1), F.size(name)), lambda x, y: F.least(x, y)))
            width += step
        return rows

    for m in lengths:
        for band in range(bands(m, containment, miss)):
            rows = minima(rows, m, _order(band))
    at = _positions("s")
    hit = lambda i: _retrieval(known, lengths, containment, miss, lambda m, c: F.get(F.col(made[m, c]), i))
    rows = rows.withColumn("at", F.explode(F.filter(at, lambda i: hit(i)[0])))
    return rows.select("id", "at", F.slice("s", F.col("at") + 1, lengths[-1]).alias("window"), F.explode(hit(F.col("at"))[1]).alias("license"))


def scan(docs: DataFrame, templates: dict | None = None, id_col="doc_id", text_col="text", containment=CONTAINMENT, miss=MISS) -> DataFrame:
    """id, license, containment (the best of a window) and first_word (its first position) for each id and license found."""
    spark = settle(docs.sparkSession)
    known = _template_table(spark, TEMPLATES if templates is None else templates).collect()  # as many as the caller gave
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    rows = docs.select(F.col(id_col).alias("id"), _hashes(words).alias("hashes")).select("id", _shingles("hashes").alias("s"))
    found = []
    for way, fits in ((_short, lambda m: m <= LANES), (_long, lambda m: m > LANES)):
        own = [r for r in known if fits(len(r.shingles))]
        if own:
            found.append(way(rows, own, sorted({len(r.shingles) for r in own}), containment, miss))
    if not found:
        return rows.select(F.col("id").alias(id_col), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_word")).limit(0)
    candidates = reduce(DataFrame.unionByName, found)
    table = F.create_map(*[x for r in known for x in (F.lit(r.license), F.array(*map(F.lit, r.shingles)))])
    wanted = F.element_at(table, F.col("license"))
    held = F.size(F.array_intersect(F.slice("window", F.lit(1), F.size(wanted)), wanted)) / F.size(wanted)
    matches = candidates.withColumn("containment", held).filter(F.col("containment") >= containment - 1e-9)
    best = matches.groupBy("id", "license").agg(F.max(F.struct(F.col("containment"), -F.col("at"))).alias("best"))
    return best.select(F.col("id").alias(id_col), "license", F.col("best.containment").alias("containment"), (-F.col("best.col2")).alias("first_word"))
