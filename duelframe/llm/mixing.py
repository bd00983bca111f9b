"""Mixing sources to target weights by Sainte-Lague apportionment.

The corpus is cut into `blocks` equal-token blocks. Sources win blocks by the highest quotients target / (2k + 1), then
each source's shards win its blocks by their sizes: integer quotas. A shard lays its documents out in seeded order, as a
stream of words cut into blocks; whole passes and then blocks in seeded order are taken until its quota is met, the last
block only as far as the source's target needs. So every source meets its target to the word.

Only totals reach the driver: a row for each source and for each shard, of which there is one for about `shard_docs`
documents and at most `max_shards` more than sources. Rows stay in Spark; the only sorts are within shards.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, last; a null id is an id like
others; rows equal in id and size are interchangeable, their takes are dealt among them the same way in every run; an
empty table gives an empty result; other columns are not read by `mix` and kept by `apply_mix`.
"""

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from duelframe.session import materialize

from .common import WORD, settle

BLOCKS, SEED, REPEATS = 1 << 16, 17, 3
SHARD_DOCS, LEAST_SHARDS, MAX_SHARDS = 20_000, 1024, 200_000
WEIGHTS = (1, 2, 3)
BROADCAST_SOURCES = 50_000


def targets(sizes: list[int], weights: list[int], repeats: int = REPEATS) -> list[Fraction]:
    """Shares of the sum of all sizes by weight; what exceeds `repeats` times a source's size is shared anew among the
    others until none exceeds it."""
    rest, open_, found = Fraction(sum(sizes)), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        unit = sum(weights[i] for i in open_)
        over = {i for i in open_ if rest * weights[i] > unit * repeats * sizes[i]} if unit else set(open_)
        if not over:
            for i in open_:
                found[i] = rest * weights[i] / unit
            break
        for i in over:
            found[i] = Fraction(repeats * sizes[i])
        open_ -= over
        rest -= sum(found[i] for i in over)
    return found


def sainte_lague(weights: list, seats: int) -> list[int]:
    """Seats by the highest quotients weight / (2k + 1); of equal quotients the earlier party's. Starts near the result
    and then gives or takes seats one at a time, which ends at the same seats as awarding all."""
    total = sum(weights)
    if not total or seats <= 0:
        return [0] * len(weights)
    won = [int(Fraction(w) * seats / total + Fraction(1, 2)) for w in weights]
    spare = seats - sum(won)
    if spare > 0:
        heap = [(-Fraction(w) / (2 * k + 1), i) for i, (w, k) in enumerate(zip(weights, won))]
        heapq.heapify(heap)
        for _ in range(spare):
            i = heap[0][1]
            won[i] += 1
            heapq.heapreplace(heap, (-Fraction(weights[i]) / (2 * won[i] + 1), i))
    elif spare < 0:
        heap = [(Fraction(w) / (2 * k - 1), -i) for i, (w, k) in enumerate(zip(weights, won)) if k]
        heapq.heapify(heap)
        for _ in range(-spare):
            i = -heap[0][1]
            won[i] -= 1
            if won[i]:
                heapq.heapreplace(heap, (Fraction(weights[i]) / (2 * won[i] - 1), -i))
            else:
                heapq.heappop(heap)
    return won


def _takes(shard_sizes: list[int], block: int, quota: int, goal: int, repeats: int) -> list[int]:
    """Words each shard of a source takes: its blocks, then what is over or missing for the goal, a shard after another."""
    take = [min(q * block, repeats * size) for q, size in zip(sainte_lague(shard_sizes, quota), shard_sizes)]
    rest = goal - sum(take)
    for k, size in enumerate(shard_sizes):
        step = max(-take[k], min(rest, repeats * size - take[k]))
        # Spread small corrections: no shard gives or gets more than one block in a first pass.
        step = max(-block, min(block, step))
        take[k] += step
        rest -= step
    for k, size in enumerate(shard_sizes):
        step = max(-take[k], min(rest, repeats * size - take[k]))
        take[k] += step
        rest -= step
    return take


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, repeats=REPEATS, blocks=BLOCKS, seed=SEED) -> DataFrame:
    """id, size, source_size, target and taken (words the mix takes of the document, repeats counted) of every document."""
    spark = settle(docs.sparkSession)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), id_col).alias("h"))
    sized = materialize(sized, "mix-sizes")
    source_rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()  # a row for each source
    source_rows.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in source_rows]
    goals = targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))], repeats)
    total, count = sum(sizes), sum(r.docs for r in source_rows)
    block = max(1, total // blocks)
    shard_docs = max(1, min(SHARD_DOCS, -(-count // LEAST_SHARDS)), count // MAX_SHARDS)
    ways = [max(1, -(-r.docs // shard_docs)) for r in source_rows]
    table = spark.createDataFrame(
        [(r.source, k, w, int(r["size"]), float(g)) for k, (r, w, g) in enumerate(zip(source_rows, ways, goals))],
        "source string, source_no int, ways int, source_size long, target double")
    if len(source_rows) <= BROADCAST_SOURCES:  # a short row each; more of them are joined by shuffling
        table = F.broadcast(table)
    placed = sized.join(table, sized["source"].eqNullSafe(table["source"]), "left").drop("source")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("h", F.lit(seed)), F.col("ways")).cast("int"))
    shard_rows = placed.groupBy("source_no", "shard").agg(F.sum("size").alias("size")).collect()  # bounded: sources + count / shard_docs
    by_source: list[list] = [[] for _ in sizes]
    for r in sorted(shard_rows, key=lambda r: (r.source_no, r.shard)):
        by_source[r.source_no].append((r.shard, r["size"]))
    quotas = sainte_lague(goals, sum(round(g) for g in goals) // block)
    plan = []
    for k, shards in enumerate(by_source):
        words = [s for _, s in shards]
        for (shard, length), take in zip(shards, _takes(words, block, quotas[k], round(goals[k]), repeats)):
            plan.append((k, shard, length, take))
    plan = spark.createDataFrame(plan, "source_no int, shard int, words long, take long")
    order = Window.partitionBy("source_no", "shard").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = placed.withColumn("stop", F.sum("size").over(order)).withColumn("start", F.col("stop") - F.col("size"))
    # Blocks of a shard in seeded order; those up to the rest of the quota are taken, the last in part.
    passes = F.when(F.col("words") > 0, F.floor(F.col("take") / F.col("words"))).otherwise(F.lit(0)).cast("long")
    per_shard = plan.withColumn("passes", passes).withColumn("left_over", F.col("take") - F.col("passes") * F.col("words"))
    pieces = per_shard.filter("left_over > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / block).cast("long"))))
    pieces = pieces.withColumn("length", F.least(F.lit(block), F.col("words") - F.col("block") * block)).withColumn("bh", F.xxhash64(F.lit(seed), "source_no", "shard", "block"))
    drawn = Window.partitionBy("source_no", "shard").orderBy("bh", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = pieces.withColumn("upto", F.sum("length").over(drawn))
    got = F.least(F.col("length"), F.col("left_over") - F.col("upto") + F.col("length"))
    pieces = pieces.withColumn("got", got).filter("got > 0").select("source_no", "shard", "block", "got")
    chosen = pieces.groupBy("source_no", "shard").agg(F.map_from_entries(F.collect_list(F.struct("block", "got"))).alias("drawn"))
    laid = laid.join(per_shard.select("source_no", "shard", "passes"), ["source_no", "shard"], "left").join(chosen, ["source_no", "shard"], "left")

    def overlap(b):
        begin = b * F.lit(block)
        part = F.least(F.col("stop"), begin + F.element_at("drawn", b)) - F.greatest(F.col("start"), begin)
        return F.greatest(part, F.lit(0))

    spans = F.sequence(F.floor(F.col("start") / block).cast("long"), F.floor((F.col("stop") - 1) / block).cast("long"))
    parts = F.aggregate(F.filter(spans, lambda b: F.map_contains_key("drawn", b)), F.lit(0).cast("long"), lambda acc, b: acc + overlap(b))
    extra = F.when((F.col("size") > 0) & F.col("drawn").isNotNull(), parts).otherwise(F.lit(0))
    taken = F.col("passes") * F.col("size") + F.coalesce(extra, F.lit(0))
    return laid.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def apply_mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed=SEED, **settings) -> DataFrame:
    """The mixed documents, whole and in their own columns: each as often as the mix takes all of its words, the remaining
    fraction by a seeded draw. Documents without words, and those the mix does not take, go."""
    found = mix(docs, id_col, text_col, source_col, seed=seed, **settings)
    share = F.col("taken") / F.col("size")
    draw = F.pmod(F.xxhash64(F.lit(seed + 1), id_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(share) + F.when(draw < share - F.floor(share), 1).otherwise(0)
    wanted = found.filter("size > 0").select(F.col(id_col).alias("_id"), copies.cast("int").alias("_copies")).filter("_copies > 0")
    wanted = materialize(wanted.groupBy("_id").agg(F.max("_copies").alias("_copies")), "mix-copies")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_doc"))
    joined = rows.join(wanted, F.col("_doc").eqNullSafe(F.col("_id"))).filter(F.regexp_count(F.col(f"row.{text_col}"), F.lit(WORD)) > 0)
    return joined.select(F.explode(F.array_repeat("row", F.col("_copies"))).alias("row")).select("row.*")
