"""MinHash near-deduplication with tensored banding.

Two small collections of `side` keys, each of `rows` minhashes, are computed for every distinct shingle set; the
tables are all side * side pairs of a key of one and a key of the other, so 2 * side * rows minhashes serve side**2
tables of 2 * rows each. A pair of similarity s meets in some table with probability (1 - (1 - s**rows)**side)**2:
0.9999 at s = 0.8 with rows = 3, side = 14, and more often the more similar it is. Every link is confirmed on full sets.

Within a table's bucket, rows of different components meet. Rounds join what is alike at little cost: in the first each
row meets the bucket's least id, in the later ones its neighbour in an order that is another in every bucket and round;
after `orders` rounds over all buckets, further rounds visit the buckets of rows whose component has just changed, until
no component changes. Then every two rows of a bucket that are still of different components meet: a large bucket is cut
into blocks of about `block` rows, and every two blocks meet in a task of their own. A pair is possible if its sizes, and
its least possible difference by a parity sketch, allow a link; both bounds are exact. Of the possible pairs a block hands
on a spanning forest only, so that what leaves it is linear in its rows. The trees of these forests join to crowds, which
hold both rows of every possible pair; the full sets of a crowd meet once, in blocks again, and of the confirmed links
those that join two components leave the task, once more a forest. A bucket that is
itself very frequent is dealt into sub-buckets for the cheap rounds only, differently in every table; the blocks are those
of the whole bucket, so that its sub-buckets meet.

Defined results: a null or blank text has no shingles and is linked with nothing; equal shingle sets are linked; a row
without an id is never linked, its component is null and it stays; rows that share an id are one document; an empty
table gives an empty result; other columns are not read by `components` and kept by `keep_one`.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.session import materialize

from .common import WordHashes, parts, settle, shingle_hashes

SIZE, PERCENT, SIDE, ROWS, ORDERS, BLOCK = 2, 80, 14, 3, 3, 2000
# Cells of a set's parity sketch: one bit for each, whether the set has an odd number of members in it.
CELLS = 512
# Rows that are gathered before their pairs are made.
GATHERED = 5_000


def _sets(rows, shingle):
    """(row number, sorted distinct shingle hashes) of the batch's texts; words and shingles as in the contract."""
    cache = WordHashes()
    for batch in rows:
        texts = batch.column(1)
        found = [shingle_hashes(cache.of(t.as_py().encode().lower().split()), shingle) if t.is_valid else np.empty(0, np.uint64) for t in texts]
        yield batch.column(0), found


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _sketches(shingle, side, rows):
    coefficients = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, size=(2 * side * rows, 2), dtype=np.uint64)

    def run(batches):
        for ids, found in _sets(batches, shingle):
            sizes = np.array([len(s) for s in found], dtype=np.int64)
            full = np.nonzero(sizes)[0]
            keys = np.zeros((len(found), 2 * side), np.uint64)
            parity = np.zeros((len(found), CELLS // 8), np.uint8)
            if len(full):
                flat = np.concatenate([found[i] for i in full])
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                for k in range(2 * side):
                    joint = np.full(len(full), k, np.uint64)
                    for r in range(rows):
                        a, b = coefficients[k * rows + r]
                        joint = joint * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(flat * (a * np.uint64(2) + np.uint64(1)) + b, starts)
                        joint ^= joint >> np.uint64(32)
                    keys[full, k] = joint
                cell = np.repeat(np.arange(len(full)), sizes[full]) * CELLS + (flat & np.uint64(CELLS - 1)).astype(np.int64)
                odd = np.bincount(cell, minlength=len(full) * CELLS) & 1
                parity[full] = np.packbits(odd.reshape(len(full), CELLS).astype(np.uint8), axis=1)
            keys = keys.astype(np.int64)
            digests = pa.array([_digest(s) if len(s) else None for s in found], pa.binary())
            offsets = pa.array(np.arange(len(found) + 1) * side, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(keys[:, o:o + side].ravel())) for o in (0, side)]
            parities = pa.array([p.tobytes() for p in parity], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), digests, *lists, parities], names=["id", "n", "digest", "a", "b", "parity"])
    return run


def _full_sets(shingle):
    def run(batches):
        for ids, found in _sets(batches, shingle):
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])])
            values = np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
            digests = pa.array([_digest(s) if len(s) else None for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, digests, lists], names=["node", "digest", "items"])
    return run


def _shared(batches):
    """Rows sorted by key: those whose key another row has too."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        key = table.column("key").to_numpy()
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        more = table.column("more").to_numpy()
        wanted = same[:-1] | same[1:] | more
        # The last row waits for its next; if it has met an equal one it says so.
        yield from table.slice(0, len(key) - 1).filter(pa.array(wanted[:-1])).to_batches()
        held = table.slice(len(key) - 1)
        if wanted[-1]:
            held = held.set_column(held.schema.get_field_index("more"), held.schema.field("more"), pa.array([True]))
    if held is not None and held.column("more")[0].as_py():
        yield from held.to_batches()


def _meetings(percent, with_first):
    """Rows sorted by bucket and order: pairs of each row and the bucket's first (or its neighbour), of different components
    and of sizes that allow a link."""
    names = ("bucket", "node", "component", "n")

    def run(batches):
        lead = {c: np.empty(0, np.int64) for c in names}  # the row of the open bucket that the next ones meet
        for batch in batches:
            col = {c: np.concatenate([lead[c], batch.column(c).to_numpy()]) for c in names}
            size = len(col["bucket"])
            if not size:
                continue
            begins = np.ones(size, bool)
            begins[1:] = col["bucket"][1:] != col["bucket"][:-1]
            first = np.maximum.accumulate(np.where(begins, np.arange(size), 0))
            x = np.nonzero(~begins)[0]
            y = first[x] if with_first else x - 1
            less, most = np.minimum(col["n"][x], col["n"][y]), np.maximum(col["n"][x], col["n"][y])
            good = (col["component"][x] != col["component"][y]) & (100 * less >= percent * most)
            u, v = col["node"][x[good]], col["node"][y[good]]
            pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])
            last = first[-1] if with_first else size - 1
            lead = {c: col[c][last:last + 1] for c in names}
    return run


def _possible(col, parity, x, y, percent):
    """Of pairs of rows of a block: whether they are of different components, across blocks, and sizes and parities allow a
    link. Cells of different parity hold a member that only one set has, so their number is at most that of such members;
    a linked pair has at most (100 - percent) / (100 + percent) of both sizes of them."""
    n, m = col["n"][x], col["n"][y]
    good = (col["component"][x] != col["component"][y]) & ((col["p"][x] == col["q"][x]) | (col["own"][x] != col["own"][y]))
    good &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    u, v = x[good], y[good]
    near = np.bitwise_count(parity[u] ^ parity[v]).sum(1, dtype=np.int64) * (100 + percent) <= (n + m)[good] * (100 - percent)
    return u[near], v[near]


class _Forest:
    """Rows joined so far; `root` is flat after `settle`."""

    def __init__(self, labels):
        self.root = labels

    def settle(self):
        while True:
            after = self.root[self.root]
            if (after == self.root).all():
                return
            self.root = after

    def find(self, k):
        while self.root[k] != k:
            self.root[k] = self.root[self.root[k]]
            k = self.root[k]
        return k

    def join(self, u, v) -> bool:
        u, v = self.find(u), self.find(v)
        self.root[max(u, v)] = min(u, v)
        return u != v


def _lags(col):
    """(x, y) of all pairs of rows of equal (group, p, q), a distance after another; rows are sorted by it."""
    size = len(col["p"])
    begins = np.ones(size, bool)
    begins[1:] = (col["group"][1:] != col["group"][:-1]) | (col["p"][1:] != col["p"][:-1]) | (col["q"][1:] != col["q"][:-1])
    group, x, lag = np.cumsum(begins), np.arange(size), 0
    while len(x):
        lag += 1
        x = x[x + lag < size]
        x = x[group[x + lag] == group[x]]
        yield x, x + lag


def _gathered(meet):
    """Hands tables of whole (group, p, q) to `meet`; the last group of a table waits for its end."""
    def run(batches):
        held, wanted = None, GATHERED
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if len(held) < wanted:
                continue
            group = np.stack([held.column(c).to_numpy() for c in ("group", "p", "q")])
            other = np.nonzero((group != group[:, -1:]).any(0))[0]
            if len(other):
                yield from meet(held.slice(0, other[-1] + 1))
                held = held.slice(other[-1] + 1)
            wanted = len(held) + GATHERED
        if held is not None and len(held):
            yield from meet(held)
    return run


def _block(table):
    parity = np.frombuffer(b"".join(table.column("parity").to_pylist()), np.uint64).reshape(len(table), -1)
    return {c: table.column(c).to_numpy() for c in ("group", "p", "q", "own", "node", "component", "n")}, parity


def _links(u, v):
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])


def _forests(percent):
    """Rows of buckets: a spanning forest of the possible pairs of each two blocks. Pairs of rows that are in one tree
    already are passed over, both being in the crowd."""
    def meet(table):
        col, parity = _block(table)
        forest, found = _Forest(np.arange(len(table))), []
        for x, y in _lags(col):
            open_ = forest.root[x] != forest.root[y]
            if not open_.any():
                continue
            for u, v in zip(*(a.tolist() for a in _possible(col, parity, x[open_], y[open_], percent))):
                if forest.join(u, v):
                    found.append((u, v))
            forest.settle()
        if found:
            u, v = np.array(found).T
            yield _links(col["node"][u], col["node"][v])
    return _gathered(meet)


def _confirmed(percent):
    """Rows of crowds with their full sets: the links that join components, a spanning forest for each two blocks."""
    def meet(table):
        col, parity = _block(table)
        items = [x.values.to_numpy() for x in table.column("items")]
        # Rows of a component are joined from the start, within their own group and blocks.
        keys = np.stack([col[c] for c in ("group", "p", "q", "component")], 1)
        _, first, inverse = np.unique(keys, axis=0, return_index=True, return_inverse=True)
        forest, found = _Forest(first[inverse.ravel()].astype(np.int64)), []
        for x, y in _lags(col):
            open_ = forest.root[x] != forest.root[y]
            if not open_.any():
                continue
            for u, v in zip(*(a.tolist() for a in _possible(col, parity, x[open_], y[open_], percent))):
                if forest.find(u) != forest.find(v):
                    common = len(np.intersect1d(items[u], items[v], assume_unique=True))
                    if 100 * common >= percent * (len(items[u]) + len(items[v]) - common):
                        forest.join(u, v)
                        found.append((u, v))
            forest.settle()
        if found:
            u, v = np.array(found).T
            yield _links(col["node"][u], col["node"][v])
    return _gathered(meet)


def _in_blocks(rows: DataFrame, group: str, block: int) -> DataFrame:
    """Rows (group, node, component, n) once for each two blocks p <= q of their group that they belong to."""
    counts = rows.groupBy(group).agg(F.count("*").alias("met"), F.min("component").alias("least"), F.max("component").alias("most"))
    counts = counts.filter("least <> most").select(group, F.ceil(F.col("met") / block).cast("int").alias("blocks"))
    rows = rows.join(counts, group).withColumn("own", F.pmod(F.xxhash64(group, "node"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(F.col(group).alias("group"), F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "component", "n")
    return rows


def _crossed(placed: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """(u, v): links that join every two components with a link between rows of a bucket; `placed` has bucket, node,
    component, n."""
    spark = placed.sparkSession
    dealt = lambda rows: rows.repartition(parts(spark), "group", "p", "q").sortWithinPartitions("group", "p", "q", "node")
    parity = classes.select("node", "parity")
    met = _in_blocks(placed, "bucket", block).join(parity, "node")
    trees = materialize(dealt(met).mapInArrow(_forests(percent), "u long, v long").distinct(), "near-trees")
    if trees.isEmpty():
        return trees
    crowds = connect(trees).select("node", F.col("component").alias("crowd"))
    own = placed.select("node", "component", "n").distinct()
    rows = materialize(own.join(crowds, "node"), "near-crowds")
    rows = _in_blocks(rows, "crowd", block).join(parity, "node").join(sets, "node")
    return materialize(dealt(rows).mapInArrow(_confirmed(percent), "u long, v long"), "near-links")


def _tables(classes: DataFrame, hot_share: int, hot_least: int) -> DataFrame:
    """(key, whole, node, n): a row for each class and table; `key` is the bucket or, of a very frequent one, a sub-bucket, and
    `whole` then the bucket. At most side * hot_share first-side keys and side**2 * hot_share buckets can be frequent, so
    the lists of them are bounded whatever the input."""
    total = classes.count()
    hot_rows = max(hot_least, total // hot_share)
    sided = classes.select("node", "n", F.posexplode("a").alias("i", "ka"), "b")
    bucket = F.xxhash64("i", "j", "ka", "kb").alias("bucket")
    if total > hot_rows:
        hot = sided.groupBy("i", "ka").agg(F.count("*").alias("met")).filter(F.col("met") > hot_rows).select("i", "ka")
        crowded = sided.join(F.broadcast(hot), ["i", "ka"], "left_semi").select("i", "ka", F.posexplode("b").alias("j", "kb"))
        large = crowded.groupBy(bucket).agg(F.count("*").alias("met")).filter(F.col("met") > hot_rows)
        large = large.select("bucket", F.ceil(F.col("met") / hot_rows).cast("int").alias("ways"))
        paired = sided.select("node", "n", "i", "ka", F.posexplode("b").alias("j", "kb")).select("node", "n", bucket)
        paired = paired.join(F.broadcast(large), "bucket", "left")
    else:
        paired = sided.select("node", "n", "i", "ka", F.posexplode("b").alias("j", "kb")).select("node", "n", bucket, F.lit(None).cast("int").alias("ways"))
    split = F.col("ways").isNotNull()
    key = F.when(split, F.xxhash64("bucket", F.pmod(F.xxhash64("node", "bucket"), "ways"))).otherwise(F.col("bucket"))
    # A row alone in its sub-bucket has others in the whole one.
    return paired.select(key.alias("key"), F.when(split, F.col("bucket")).alias("whole"), "node", "n", split.alias("more"))


def connect(links: DataFrame) -> DataFrame:
    """(node, component) of every node of `links` (u, v): the least node it is connected with.

    Every round, each node tells its neighbours the least node it knows of (hooking) and follows its own pointer
    (jumping); labels only fall, so the loop ends when none has fallen. Each round is a written table."""
    edges = materialize(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "near-edges")
    labels = materialize(edges.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("component")), "near-labels")
    while True:
        told = edges.join(labels, F.col("v") == F.col("node")).select(F.col("u").alias("node"), "component")
        # The node a row points at learns of what the row's neighbours know; that joins whole trees at once.
        pointed = edges.join(labels, F.col("v") == F.col("node")).select("u", F.col("component").alias("heard")).groupBy("u").agg(F.min("heard").alias("heard"))
        hooked = labels.join(pointed, F.col("node") == F.col("u")).groupBy(F.col("component").alias("node")).agg(F.min("heard").alias("component"))
        lower = told.unionByName(hooked).unionByName(labels).groupBy("node").agg(F.min("component").alias("component"))
        jump = lower.select(F.col("node").alias("at"), F.col("component").alias("next"))
        after = lower.join(jump, F.col("component") == F.col("at"), "left").select("node", F.least("component", "next").alias("component"))
        after = materialize(after, "near-labels")
        changed = after.join(labels.withColumnRenamed("component", "before"), "node").filter(F.col("component") != F.col("before"))
        if changed.isEmpty():
            return after
        labels = after


def components(docs: DataFrame, id_col="doc_id", text_col="text", size=SIZE, percent=PERCENT, side=SIDE, rows=ROWS, orders=ORDERS, block=BLOCK, hot_share=2000, hot_least=20_000) -> DataFrame:
    """A row for each document: id, n_shingles, component_id (the least id reachable over links), kept."""
    spark = settle(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    info = materialize(base.mapInArrow(_sketches(size, side, rows), "id long, n long, digest binary, a array<long>, b array<long>, parity binary"), "near-sketches")
    classes = info.filter("digest is not null and id is not null").groupBy("digest").agg(
        F.min("id").alias("node"), F.any_value("n").alias("n"), F.any_value("a").alias("a"), F.any_value("b").alias("b"), F.any_value("parity").alias("parity"))
    classes = materialize(classes, "near-classes")
    tables = _tables(classes, hot_share, hot_least).repartition(parts(spark), "key").sortWithinPartitions("key")
    met = materialize(tables.mapInArrow(_shared, tables.schema).select("key", "whole", "node", "n"), "near-met")
    wanted = met.select("node").distinct()
    sets = base.join(wanted, base["id"] == wanted["node"], "left_semi").mapInArrow(_full_sets(size), "node long, digest binary, items array<long>")
    sets = sets.join(classes.select("digest", F.col("node").alias("own")), "digest").filter("own = node").select("node", "items")
    sets = materialize(sets, "near-sets")
    labels, round_no = None, 0
    left = sets.select(F.col("node").alias("u"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("v"), F.col("items").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    linked = F.lit(100) * common >= F.lit(percent) * (F.size("x") + F.size("y") - common)
    visited = met

    def placed_in(rows, key, *more):
        component = F.col("node") if labels is None else F.coalesce("component", "node")
        rows = rows if labels is None else rows.join(labels, "node", "left")
        return rows.select(key.alias("bucket"), "node", component.alias("component"), "n", *more)

    def confirmed(pairs):
        return materialize(pairs.join(left, "u").join(right, "v").filter(linked).select("u", "v"), "near-links")

    def joined(links):
        """The labels that `links` and the labels so far make."""
        if labels is None:
            return connect(links)
        return connect(links.unionByName(labels.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))))

    while True:
        order = F.col("node") if round_no == 0 else F.xxhash64("node", "key", F.lit(round_no))
        placed = placed_in(visited, F.col("key"), order.alias("order"))
        placed = placed.repartition(parts(spark), "bucket").sortWithinPartitions("bucket", "order", "node")
        pairs = placed.mapInArrow(_meetings(percent, round_no == 0), "u long, v long").distinct()
        new = confirmed(pairs)
        round_no += 1
        if round_no >= orders and new.isEmpty():
            break
        before, labels = labels, joined(new)
        if round_no >= orders:
            moved = labels if before is None else labels.join(before.withColumnRenamed("component", "before"), "node", "left").filter(
                F.col("component") != F.coalesce("before", "node"))
            touched = met.join(moved.select("node"), "node", "left_semi").select("key").distinct()
            visited = met.join(touched, "key", "left_semi")
    new = _crossed(placed_in(met, F.coalesce("whole", "key")), classes, sets, percent, block)
    if not new.isEmpty():
        labels = joined(new)
    ends = classes.select("digest", "node")
    if labels is None:
        ends = ends.select("digest", F.col("node").alias("component"))
    else:
        ends = ends.join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    found = info.select("id", "n", "digest").join(ends, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", **settings) -> DataFrame:
    """The documents of which `components` keeps one for each component, whole."""
    gone = components(docs, id_col, text_col, **settings).filter("not kept").select(F.col(id_col).alias("_gone"))
    gone = materialize(gone.distinct(), "near-gone")
    return docs.join(gone, docs[id_col] == F.col("_gone"), "left_anti")
