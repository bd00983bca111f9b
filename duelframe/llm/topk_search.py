"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become integer rows of (dimension, weight) postings. Candidates are dealt into groups, each task turning blocks
of its group into postings by dimension; queries come to every group in blocks of rows. For a block of queries, each
term in turn scatters weight times weight into a dense array of scores (queries x candidates of the block); partition
selection keeps the k best of each row, and a second pass merges the groups' bests. Every row is scored against every
query: nothing is pruned.

Defined results: a vector that is null, or holds a null or non-finite component, takes no part, nor does a row without an
id; a component that a shorter vector lacks, and an empty vector's, is 0; rows that repeat id and vector are one row, a
query meets no row of its own id, and another vector under a repeated id is a candidate or a query of its own; ties go to
the smaller id; scores that could leave 64 bits raise an error; fewer candidates than k give all of them; an empty
table gives an empty result; other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from duelframe.session import materialize

from .common import settle

SCALE, K, EVERY = 1024, 10, 100
QUERY_BLOCK, CANDIDATE_BLOCK = 256, 4096


def quantize(vectors: DataFrame, id_col="vec_id", vector_col="embedding", scale=SCALE) -> DataFrame:
    """(id, q): components as floor(scale * x) with x as double, of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    good = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v)).alias("q"))


class Postings:
    """By dimension: the rows with a weight there and the weights."""

    def __init__(self, ids: np.ndarray, rows: list):
        self.ids = ids
        lengths = np.array([len(r) for r in rows], np.int64)
        flat = np.concatenate([*rows, np.empty(0, np.int64)])
        owner = np.repeat(np.arange(len(rows)), lengths)
        dim = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) if len(rows) else flat
        keep = flat != 0
        flat, owner, dim = flat[keep], owner[keep], dim[keep]
        order = np.argsort(dim, kind="stable")
        flat, owner, dim = flat[order], owner[order], dim[order]
        dims, begins = np.unique(dim, return_index=True)
        ends = np.append(begins[1:], len(dim))
        self.terms = {int(d): (owner[b:e], flat[b:e]) for d, b, e in zip(dims, begins.tolist(), ends.tolist())}
        self.size = int(lengths.max()) if len(lengths) else 0
        self.most = int(np.abs(flat).max()) if len(flat) else 0
        if len(flat) and int(flat.min()) == -(1 << 63):
            raise OverflowError("a component leaves 63 bits")


def scores(queries: Postings, candidates: Postings) -> np.ndarray:
    """Dense scores (queries x candidates), accumulated a term at a time."""
    if queries.most * candidates.most * max(1, min(queries.size, candidates.size)) >= 1 << 63:
        raise OverflowError("inner products could leave 64 bits")
    out = np.zeros((len(queries.ids), len(candidates.ids)), np.int64)
    for dim, (rows, weights) in queries.terms.items():
        posting = candidates.terms.get(dim)
        if posting is None:
            continue
        at, values = posting
        if len(at) == out.shape[1]:
            out[rows] += weights[:, None] * values[None, :]
        else:
            out[np.ix_(rows, at)] += weights[:, None] * values[None, :]
    return out


def select(queries: Postings, candidates: Postings, k: int):
    """The k best candidates of each query, ties to the smaller id: (query row, candidate row, score)."""
    found = scores(queries, candidates)
    own = queries.ids[:, None] == candidates.ids[None, :]
    picked = []
    for r in range(len(queries.ids)):
        row = np.nonzero(~own[r])[0]
        if len(row) > k:
            # All that reach the k-th best score, then the order decides.
            bar = np.partition(found[r, row], len(row) - k)[len(row) - k]
            row = row[found[r, row] >= bar]
        order = np.lexsort((candidates.ids[row], -found[r, row]))[:k]
        picked.append((np.full(len(order), r), row[order], found[r, row[order]]))
    return (np.concatenate(side) for side in zip(*picked))


def _rows(batch):
    lists = batch.column("q")
    flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    return batch.column("id").to_numpy(), [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _search(k):
    """Rows of a group, candidates (kind 0) before queries (kind 1). Candidates stay as blocks of postings, a group's share;
    queries pass by in blocks."""
    def run(batches):
        group, blocks, ids, rows = None, [], [], []

        def close():
            if ids:
                blocks.append(Postings(np.array(ids, np.int64), rows))
            return [], []

        for batch in batches:
            table = pa.Table.from_batches([batch]).combine_chunks().to_batches()[0] if batch.num_rows else None
            if table is None:
                continue
            key = table.column("group").to_numpy() * 2 + table.column("kind").to_numpy()
            cuts = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = table.slice(a, b - a)
                part = pa.RecordBatch.from_arrays([part.column("id"), pa.array(part.column("q").to_pylist(), pa.list_(pa.int64()))], names=["id", "q"])
                now, kind = divmod(int(key[a]), 2)
                if now != group:
                    group, blocks, ids, rows = now, [], [], []
                found_ids, found_rows = _rows(part)
                if kind == 0:
                    for i, r in zip(found_ids.tolist(), found_rows):
                        ids.append(i)
                        rows.append(r)
                        if len(ids) == CANDIDATE_BLOCK:
                            ids, rows = close()
                    continue
                ids, rows = close()
                for at in range(0, len(found_ids), QUERY_BLOCK):
                    queries = Postings(found_ids[at:at + QUERY_BLOCK], found_rows[at:at + QUERY_BLOCK])
                    for block in blocks:
                        q, c, s = select(queries, block, k)
                        yield pa.RecordBatch.from_arrays([pa.array(queries.ids[q]), pa.array(block.ids[c]), pa.array(s), pa.array(part.column("q").take(pa.array(q + at)))], names=["query_id", "vec_id", "score", "q"])
    return run


def search(vectors: DataFrame, queries: DataFrame, k=K, group_rows=65_536, least_groups=12) -> DataFrame:
    """query_id, rank, vec_id, score: for each row (id, q) of `queries` the k best rows of `vectors` (id, q) of other ids.

    Each group holds about `group_rows` candidates at most, with at least `least_groups` groups; the queries are copied
    to each group, which is what an exhaustive search of a distributed table has to move."""
    spark = settle(vectors.sparkSession)
    vectors = materialize(vectors.dropDuplicates(["id", "q"]), "search-rows")
    groups = max(least_groups, -(-vectors.count() // group_rows))
    dealt = vectors.select(F.pmod(F.xxhash64("id", "q"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("kind"), "id", "q")
    copied = queries.dropDuplicates(["id", "q"]).select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("kind"), "id", "q")
    both = dealt.unionByName(copied).repartitionById(groups, "group").sortWithinPartitions("group", "kind")
    bests = both.mapInArrow(_search(k), "query_id long, vec_id long, score long, q array<long>")
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    merged = bests.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_table(vectors: DataFrame, id_col="vec_id", vector_col="embedding", every=EVERY, k=K, scale=SCALE) -> DataFrame:
    """The rows whose id is divisible by `every` as queries against all rows."""
    rows = materialize(quantize(vectors, id_col, vector_col, scale), "search-quantized")
    return search(rows, rows.filter(F.col("id") % every == 0), k)
