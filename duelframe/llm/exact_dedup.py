"""Exact deduplication through an extendible-hash index on shared files.

Every text has a 63-bit key. The index is a directory of slots, one for each prefix of the key of the directory's depth,
that point to buckets, which are prefixes of at most that depth; the directory starts at the depth an even spread would
need and doubles while a bucket holds more than `bucket_rows` distinct keys. Owner tasks each take a run of neighbouring
buckets, packed by the keys these hold, so a crowded stretch of keys, whose buckets are split, is spread over owners. An
owner reads its buckets and texts in key order, puts every text into its bucket, chains the different texts of a key and
compares them byte by byte; a text outside its bucket raises. Documents find their bucket through the directory's slots and
their text within the bucket. Copies meet their like first inside the reading task, so a group of copies costs an owner a
row for each reading task, not for each copy. What the driver holds is a number for each of RUNS stretches of an owner.
Directory and entries lie in the folder of spark.checkpoint.dir. The directory is as deep as its fullest stretch of keys
needs; hashed keys keep that within a few doublings of the start.

Defined results: a null text counts as empty; empty texts are equal; a null id ranks below every id, so a group of
null ids has a null keep_id; rows repeating id and text carry the same verdict in `membership` and are one row in
`keep_one`; an empty table gives an empty result; other columns, whatever their names, ride along inside a struct.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from duelframe.session import materialize

from .common import parts, settle

BUCKET_ROWS = 1024
KEY_BITS = 63
# Stretches of the directory weighed for each owner.
RUNS = 16


@dataclass
class Index:
    keys: DataFrame        # id, key, sha, slot: a row for each document
    directory: DataFrame   # slot, prefix, depth, keys: a row for each slot, with the bucket it points to
    entries: DataFrame     # bucket, depth, key, chain, sha, keep_id, group_size: a row for each distinct text


def _key(text, bits):
    return F.shiftrightunsigned(F.xxhash64(text), 64 - bits)


@dataclass
class Directory:
    buckets: DataFrame  # prefix, depth, keys: a row for each bucket
    depth: int          # of the directory: the deepest bucket's
    bits: int

    def slots(self) -> DataFrame:
        """The doubled directory: a bucket has a slot for each prefix of the directory's depth that begins with its own."""
        below = F.lit(self.depth) - F.col("depth")
        first = F.call_function("shiftleft", F.col("prefix"), below)
        last = first + F.call_function("shiftleft", F.lit(1).cast("long"), below) - 1
        return self.buckets.select(F.explode(F.sequence(first, last)).alias("slot"), "prefix", "depth", "keys")

    def slot_of(self, key):
        return F.shiftright(key, self.bits - self.depth)

    def first_key(self):
        return F.call_function("shiftleft", F.col("prefix"), F.lit(self.bits) - F.col("depth"))

    def owners(self, tasks: int) -> list[int]:
        """The first key of each owner: runs of neighbouring buckets, packed so that owners hold about as many keys."""
        runs = self.buckets.select(self.first_key().alias("first"), "keys").repartitionByRange(tasks * RUNS, "first")
        weighed = runs.groupBy(F.spark_partition_id().alias("run")).agg(F.min("first").alias("first"), F.sum("keys").alias("keys"))
        weighed = sorted((r["first"], r["keys"]) for r in weighed.collect())
        total, held, first = sum(n for _, n in weighed), 0, []
        for start, n in weighed:
            if not first or held * tasks >= total * len(first):
                first.append(start)
            held += n
        return first or [0]


def grow_directory(keys: DataFrame, bits: int, bucket_rows: int) -> Directory:
    """The directory of all distinct keys. Only full buckets are counted again when it doubles."""
    distinct = keys.select("key").distinct()
    depth = min(bits, max(0, distinct.count() // bucket_rows).bit_length())
    done, open_keys = None, distinct
    while True:
        prefix = F.shiftright("key", bits - depth)
        sizes = open_keys.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("keys")).withColumn("depth", F.lit(depth))
        sizes = materialize(sizes, "dedup-slots").select("prefix", "depth", "keys")
        fits = sizes if depth >= bits else sizes.filter(F.col("keys") <= bucket_rows)
        done = fits if done is None else done.unionByName(fits)
        full = sizes.filter(F.col("keys") > bucket_rows)
        if depth >= bits or full.isEmpty():
            return Directory(done, depth, bits)
        open_keys = open_keys.withColumn("prefix", prefix).join(full.select("prefix"), "prefix", "left_semi").select("key")
        depth += 1


def _better(a, b):
    """Of two ids the larger; null is the least."""
    return a is not None and (b is None or a > b)


def _merge(table: pa.Table, rows: range, ids: list, counts: list) -> list[tuple[int, int]]:
    """(row that stays, copies) for each distinct text among `rows`, which share a key; equal means equal bytes."""
    chain: dict[bytes, list] = {}
    texts = table.column("body")
    for r in rows:
        body = texts[r].as_buffer().to_pybytes()
        found = chain.get(body)
        if found is None:
            chain[body] = [r, counts[r]]
        else:
            found[1] += counts[r]
            if _better(ids[r], ids[found[0]]):
                found[0] = r
    return [tuple(chain[body]) for body in sorted(chain)]


def _set(table: pa.Table, name: str, values: list) -> pa.Table:
    field = table.schema.field(name)
    return table.set_column(table.schema.get_field_index(name), field, pa.array(values, field.type))


def _emit(table: pa.Table, winners: list[tuple[int, int]]) -> pa.Table:
    return _set(table.take(pa.array([w[0] for w in winners], pa.int64())), "copies", [w[1] for w in winners])


def _combine(batches):
    """Inside one reading task: equal texts of a batch become one row; texts seen to repeat are held back to the end,
    up to a bound in bytes, so that a large group of copies leaves the task as a few rows."""
    held, held_bytes, limit = {}, 0, 32 << 20
    for batch in batches:
        table = pa.Table.from_batches([batch])
        ids, keys, counts = (table.column(c).to_pylist() for c in ("id", "key", "copies"))
        groups: dict[int, list[int]] = {}
        for r, key in enumerate(keys):
            groups.setdefault(key, []).append(r)
        out = []
        for key, rows in groups.items():
            merged = [(rows[0], counts[rows[0]])] if len(rows) == 1 else _merge(table, rows, ids, counts)
            for row, n in merged:
                body = table.column("body")[row].as_buffer().to_pybytes() if n > 1 or key in held else None
                old = held.get((key, body)) if body is not None and key in held else None
                if old is not None:
                    old[1] += n
                    if _better(ids[row], old[2]):
                        old[0], old[2] = _emit(table, [(row, n)]), ids[row]
                elif n > 1 and held_bytes + len(body) < limit:
                    held[(key, body)] = [_emit(table, [(row, n)]), n, ids[row]]
                    held[key] = True
                    held_bytes += 2 * len(body) + 200
                else:
                    out.append((row, n))
        if out:
            yield from _emit(table, out).combine_chunks().to_batches()
    for entry in held.values():
        if entry is not True:
            yield from _emit(entry[0], [(0, entry[1])]).to_batches()


def _chain(batches):
    """In an owner task, rows sorted by key: one row for each distinct text of a key, numbered along the chain. Only the
    texts of one key are held, and of those one copy each."""
    open_rows = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if open_rows is not None:
            table = pa.concat_tables([open_rows, table]).combine_chunks()
        open_rows, done = _closed(table, last=False)
        yield from done
    if open_rows is not None:
        yield from _closed(open_rows, last=True)[1]


def _closed(table: pa.Table, last: bool):
    ids, keys, counts = (table.column(c).to_pylist() for c in ("id", "key", "copies"))
    winners, chain, start = [], [], 0
    for r in range(1, len(keys) + 1):
        if r < len(keys) and keys[r] == keys[start]:
            continue
        merged = [(start, counts[start])] if r - start == 1 else _merge(table, range(start, r), ids, counts)
        if r == len(keys) and not last:
            return _emit(table, merged), _numbered(table, winners, chain)
        winners += merged
        chain += range(len(merged))
        start = r
    return None, _numbered(table, winners, chain)


def _numbered(table, winners, chain):
    if not winners:
        return []
    return _set(_emit(table, winners), "chain", chain).combine_chunks().to_batches()


def _placed(batches, bits):
    """In an owner task, buckets and texts in key order: every text gets the bucket before it, bucket rows go."""
    bucket, depth = -1, 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        opens = table.column("chain").to_numpy() < 0
        at = np.maximum.accumulate(np.where(opens, np.arange(len(opens)), -1))
        buckets, depths = (np.where(at >= 0, table.column(c).to_numpy()[at], carried) for c, carried in (("bucket", bucket), ("depth", depth)))
        keys = table.column("key").to_numpy()
        if (buckets < 0).any() or ((keys >> (bits - depths)) != buckets).any():
            raise RuntimeError("a text lies outside the buckets of the directory")
        bucket, depth = int(buckets[-1]), int(depths[-1])
        texts = pa.array(~opens)
        table = _set(_set(table, "bucket", buckets), "depth", depths).filter(texts)
        yield from table.combine_chunks().to_batches()


def _owners(docs, id_col, text_col, bits, directory: Directory, whole_rows):
    """A row for each distinct text, made by owner tasks over runs of buckets: bucket, depth, key, chain, id, copies, body (and row)."""
    tasks = parts(docs.sparkSession)
    first = np.array(directory.owners(tasks), dtype=np.int64)
    body = F.coalesce(F.col(text_col), F.lit(""))
    none = [F.lit(0).alias("owner"), F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("depth")]
    rows = docs.select(
        F.col(id_col).alias("id"), _key(body, bits).alias("key"), F.lit(1).cast("long").alias("copies"), F.lit(0).alias("chain"),
        body.cast("binary").alias("body"), *none, *([F.struct("*").alias("row")] if whole_rows else []),
    )
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema])  # bucket rows have no id, body or row
    known = {"key": directory.first_key(), "chain": F.lit(-1), "bucket": F.col("prefix"), "depth": F.col("depth"), "owner": F.lit(0), "copies": F.lit(0).cast("long")}
    buckets = directory.buckets.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])

    def routed(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            owner = np.searchsorted(first, table.column("key").to_numpy(), side="right") - 1
            yield from _set(table, "owner", np.maximum(owner, 0)).combine_chunks().to_batches()

    met = rows.mapInArrow(lambda batches: routed(_combine(batches)), schema).unionByName(buckets.mapInArrow(routed, schema))
    mine = met.repartitionById(len(first), F.col("owner")).sortWithinPartitions("key", "chain")
    return mine.mapInArrow(lambda batches: _chain(_placed(batches, bits)), schema)


def _hash_keys(docs, id_col, text_col, bits):
    body = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), _key(body, bits).alias("key"), F.unhex(F.sha2(body, 256)).alias("sha"))


def build_index(docs: DataFrame, id_col="doc_id", text_col="text", bucket_rows=BUCKET_ROWS, bits=KEY_BITS) -> Index:
    """The written index over all documents. `bits` shortens the keys, which makes chains longer (for tests)."""
    settle(docs.sparkSession)
    keys = materialize(_hash_keys(docs, id_col, text_col, bits), "dedup-keys")
    directory = grow_directory(keys, bits, bucket_rows)
    texts = _owners(docs, id_col, text_col, bits, directory, False)
    sha = F.unhex(F.sha2("body", 256)).alias("sha")
    entries = texts.select("bucket", "depth", "key", "chain", sha, F.col("id").alias("keep_id"), F.col("copies").alias("group_size"))
    slots = materialize(directory.slots(), "dedup-directory")
    keys = keys.withColumn("slot", directory.slot_of("key"))
    return Index(keys, slots, materialize(entries, "dedup-entries"))


def membership(docs: DataFrame, id_col="doc_id", text_col="text", bucket_rows=BUCKET_ROWS, bits=KEY_BITS) -> DataFrame:
    """A row for each document: id, keep_id, group_size, kept, text_sha256. The largest id of equal texts stays."""
    index = build_index(docs, id_col, text_col, bucket_rows, bits)
    found = index.keys.join(index.directory.select("slot", F.col("prefix").alias("bucket")), "slot", "left")
    joined = found.join(index.entries.select("bucket", "key", "sha", "keep_id", "group_size"), ["bucket", "key", "sha"], "left")
    return joined.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", bucket_rows=BUCKET_ROWS, bits=KEY_BITS) -> DataFrame:
    """The documents that stay, whole and with all their columns; owner tasks emit them, no second join of the texts."""
    settle(docs.sparkSession)
    keys = docs.select(_key(F.coalesce(F.col(text_col), F.lit("")), bits).alias("key"))
    directory = grow_directory(keys, bits, bucket_rows)
    return _owners(docs, id_col, text_col, bits, directory, True).select("row.*")
